import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from palimpsest.llm import sentencepieces as sp

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def texts(n, seed=1):
    rng = random.Random(seed)
    pool = ["a", "b", " ", "▁", "\n", "\t", "é", "ß", "你", "🙂", "\x00", "the", "ing", "Ａ", "ﬁ", "  ", "tion", ".", ",", "<s>", "</s>", "<unk>", "<0x0A>"]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_codec_equals_the_library():
    codec, library = sp.MergeCodec(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for t in [*texts(1500), "x" * 5000, "ab " * 2000, "", " ", "▁"]:
        ids = library.encode(t, add_eos=True)
        assert codec.encode(t) == ids
        assert codec.decode(ids) == library.decode(ids)
        assert codec.round_trip(t) == (len(ids), " ".join(map(str, ids)), library.decode(ids))


def test_bounded_memory_keeps_results():
    codec, library = sp.MergeCodec(MODEL, 6), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for t in texts(200, 2):
        assert codec.encode(t) == library.encode(t, add_eos=True)
        codec.round_trip(t)
    assert len(codec.known) <= 6 and len(codec.atoms) <= 3


def test_documents(docs_of):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(i, t) for i, t in enumerate(texts(60, 3))] + [(900, None), (901, ""), (None, "some text"), (5, "again"), (5, "again")]
    df = docs_of([(*r, 3) for r in rows], ", n_tokens int")
    got = sorted((tuple(r) for r in sp.encode_documents(df, MODEL).collect()), key=repr)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_eos=True)
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert got == sorted(want, key=repr)
    full = {r.doc_id: (r.token_ids, r.decoded) for r in sp.encode_documents(df, MODEL, texts=True).collect()}
    assert full[901] == ([2], "") and full[900] == ([2], "")
    assert sp.encode_documents(df.limit(0), MODEL).collect() == []


def test_a_difference_stops_the_job():
    codec = sp.MergeCodec(MODEL)
    with pytest.raises(ValueError):
        codec.check("text", "1 2", "text")


def test_other_rules_are_refused():
    import public_tokenizers
    import sentencepiece

    from palimpsest.llm import sentencepieces as sp

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")).serialized_model_proto()
    sp.refuse_other_rules(model)
    extra = lambda n, body: bytes([n << 3 | 2, len(body)]) + body  # noqa: E731  a later field replaces an earlier one
    for bad in (extra(3, b"\x12\x02ab\x20\x00"), extra(3, b""), extra(3, b"\x18\x00\x20\x00"), extra(2, b"\x18\x01"), extra(2, b"")):
        try:
            sp.refuse_other_rules(model + bad)
        except ValueError:
            continue
        raise AssertionError(bad)
