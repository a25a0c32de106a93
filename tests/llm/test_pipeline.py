"""The pipeline against plain Python, stage by stage on what the stage before kept."""
import hashlib
import itertools
import re
import string
from collections import Counter

import public_tokenizers
import sentencepiece

import corpus_pipeline as cp
from palimpsest.llm.common import table
from palimpsest.llm.toxicity import Settings
from tests.llm.test_toxicity import plain_query

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def without_common_lines(docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    n = Counter(k for t in docs.values() for k in {key(x) for x in (t or "").split("\n")} - {""})
    out = {}
    for d, t in docs.items():
        kept = [x for x in (t or "").split("\n") if n[key(x)] < 10]
        out[d] = t if len(kept) == len((t or "").split("\n")) else "\n".join(kept)
    return out


def one_of_each_group(docs):
    sets = {}
    for d, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[d] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    low = {d: d for d in docs}

    def root(d):
        while low[d] != d:
            d = low[d]
        return d

    for a, b in itertools.combinations(sorted(docs), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            low[y] = x
    return {d: t for d, t in docs.items() if root(d) == d}


def uncontaminated(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {tuple(w[i:i + 10]) for w in map(words, items) if w for i in range(max(1, len(w) - 9))}
    sizes = {len(x) for x in windows}
    hit = lambda w: any(tuple(w[i:i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    return {d: t for d, t in docs.items() if not hit(words(t))}


def test_pipeline_against_brute_force(spark):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in cp.run(spark, SF).collect()}
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    labels = [(r.doc_id, r.quality, r.toxic) for r in table(spark, SF, "labels").collect()]
    scores = {d: score for d, _, score, _ in plain_query(sorted(docs.items()), labels, Settings())}
    kept = {d: t for d, t in docs.items() if scores[d] < 0.5}
    kept = uncontaminated(one_of_each_group(without_common_lines(kept)), [r.text for r in table(spark, SF, "benchmark").collect()])
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for d, t in kept.items():
        ids = model.encode(t or "", add_eos=True, num_threads=1)
        want[d] = (len(ids), sha(" ".join(map(str, ids))), sha(model.decode(ids)))
    assert 0 < len(want) < len(docs)
    assert got == want


EXTRA = ("score", "items", "n_dropped", "kept_text", "component_id", "row", "_text", "class")


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated rows and ids, empty and long texts, columns with the names that operators use."""
    clean = [(i, f"clean words of document {i} go on for some while without harm {i * 7}", "en", "s", 1) for i in range(40)]
    toxic = [(100 + i, f"vermin scoundrel wretch vermin scoundrel you {i} wretch", "en", "s", 1) for i in range(40)]
    odd = [(None, None, None, None, None), (None, "a row without an id", None, "s", 1), (200, None, "en", None, None), (201, "", "en", "s", 0), (202, " \n\n", None, "s", 3),
           (203, "said twice by one row", "en", "s", 1), (203, "said twice by one row", "en", "s", 1), (203, "the same id with another text", "en", "s", 1),
           (204, "long " + "word " * 60_000, "en", "s", 1), (205, "one two three four five six seven eight nine ten", "en", "s", 1)]
    odd += [(300 + i, f"shared line\nown line {i} of row {i}", "en", "s", 1) for i in range(12)]
    odd += [(400 + i, "a copy " + " ".join(f"w{k}" for k in range(40)), "en", "s", 1) for i in range(3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in EXTRA)
    rows = [(*r, *range(len(EXTRA))) for r in clean + toxic + odd]
    sf_dir = str(tmp_path)
    spark.createDataFrame([(i, 1, int(i >= 100)) for i in (*range(40), *range(100, 140))], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None)], "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema).repartition(3)
    docs.write.parquet(f"{sf_dir}/documents.parquet")

    def ids(df):
        return Counter(r.doc_id for r in df.collect())

    out = cp.drop_toxic(spark, docs, sf_dir)
    assert out.columns == docs.columns and ids(out) == Counter(r[0] for r in clean + odd)
    out = cp.drop_common_lines(spark, docs, sf_dir)
    assert out.columns == docs.columns and ids(out) == ids(docs)
    texts = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert texts[300] == ("own line 0 of row 0", 19) and texts[200] == (None, None) and texts[201] == ("", 0) and texts[202] == (" \n\n", 3)
    out = cp.keep_one_of_each_group(spark, docs, sf_dir)
    gone = ids(docs) - ids(out)
    assert out.columns == docs.columns and {401, 402} <= set(gone) and 400 not in gone and not set(gone) & {None, 203, 201, 200}
    out = cp.drop_contaminated(spark, docs, sf_dir)
    assert out.columns == docs.columns and ids(docs) - ids(out) == Counter([205])
    assert ids(cp.to_pieces(spark, docs, sf_dir)) == ids(docs)
    assert all(r[3:] == tuple(range(len(EXTRA))) for r in cp.drop_common_lines(spark, docs, sf_dir).select("doc_id", "text", "n_chars", *EXTRA).collect())
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).collect() == [], name
    assert cp.run(spark, sf_dir).count() > 50


def test_workers_hold_no_words_and_texts_travel_once(spark):
    """Python workers go on to other stages, whose memory they share."""
    import pyarrow as pa

    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(50)], "doc_id long, text string").repartition(4)
    assert cp.to_pieces(spark, docs, SF).count() == 50

    def left(batches):
        import gc

        from palimpsest.llm.sentencepieces import MergeCodec

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(x.known) + len(x.atoms) for x in gc.get_objects() if isinstance(x, MergeCodec))])], names=["n"])

    assert docs.mapInArrow(left, "n long").groupBy().max("n").first()[0] == 0
    for out in (cp.drop_toxic(spark, docs, SF), cp.drop_contaminated(spark, docs, SF)):
        assert "_text" not in out._jdf.queryExecution().optimizedPlan().toString()
