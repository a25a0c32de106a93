import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from palimpsest.llm import language_id as li


def brute_bits(train, alphabet, text, depth=3):
    """Code length of bytes by the definition: a tree of counts, escapes to shorter contexts."""
    tree = defaultdict(Counter)
    for t in train:
        s = [0] * depth + [alphabet.get(b, 0) for b in t]
        for i in range(depth, len(s)):
            for o in range(depth + 1):
                tree[tuple(s[i - o : i])][s[i]] += 1
    s = [0] * depth + [alphabet.get(b, 0) for b in text]
    bits = 0.0
    for i in range(depth, len(s)):
        for o in range(depth, -2, -1):
            if o == -1:
                bits += math.log2(len(alphabet) + 1)
                break
            c = tree.get(tuple(s[i - o : i]))
            if not c:
                continue
            total, kinds = sum(c.values()), len(c)
            if c[s[i]]:
                bits -= math.log2(c[s[i]] / (total + kinds))
                break
            bits -= math.log2(kinds / (total + kinds))
    return bits


def test_code_lengths_by_definition(docs_of):
    rng = random.Random(1)
    make = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 60)))
    rows = [(i, make("ab c") if i % 2 else make("xyé "), "aa" if i % 2 else "xx") for i in range(60)]
    model = li.learn(docs_of(rows, ", lang string"))
    assert model.languages == ["aa", "xx"]
    alphabet = {b: int(model.symbol[b]) for b in range(256) if model.symbol[b]}
    values = [make("abxyéq \n").encode() for _ in range(40)] + [b"a", b"\xff\xfe"]
    got = li.code_lengths(model, values)
    for k, name in enumerate(model.languages):
        train = [t.encode() for _, t, n in rows if n == name]
        want = [brute_bits(train, alphabet, v) for v in values]
        assert np.allclose(got[:, k], want, rtol=1e-4, atol=1e-2)


def test_chunks_do_not_matter(docs_of, monkeypatch):
    rows = [(i, "some words here " * (i + 1) if i % 2 else "altri testi qui " * (i + 1), "en" if i % 2 else "it") for i in range(20)]
    model = li.learn(docs_of(rows, ", lang string"))
    values = [t.encode() for _, t, _ in rows]
    whole = li.code_lengths(model, values)
    monkeypatch.setattr(li, "CHUNK", 37)
    assert np.allclose(whole, li.code_lengths(model, values))


def test_held_out_accuracy_and_edges(docs_of):
    rng = random.Random(2)
    lexicon = {"en": ["the", "house", "with", "which", "ing"], "de": ["das", "haus", "mit", "welche", "ung"], "fr": ["la", "maison", "avec", "quelle", "été"]}
    rows = [(i, " ".join(rng.choice(lexicon[n]) + rng.choice("aeiou") for _ in range(rng.randint(3, 30))), n) for i, n in enumerate(list(lexicon) * 150)]
    docs = docs_of([(*r, "und") for r in rows], ", lang string, lang_pred string")
    model = li.learn(docs.where(li.fold_bucket("doc_id", 4) != 2))
    got = {r.doc_id: r for r in li.predict(docs, model).collect()}
    held = [(got[i].lang_pred == n) for i, _, n in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 50 and sum(held) / len(held) > 0.98
    odd = docs_of([(1, None), (2, ""), (3, "123 !?\n"), (None, "das haus mit"), (4, "x" * 200_000), (4, "y")])
    seen = {(r.doc_id, r.lang_pred, 0 <= r.score <= 1) for r in li.predict(odd, model).collect()}
    assert {(1, "und", True), (2, "und", True), (3, "und", True), (None, "de", True)} <= seen and len(seen) >= 5
    assert li.predict(odd.limit(0), model).collect() == []
    assert [r.lang_pred for r in li.predict(odd.where("doc_id = 4"), None).collect()] == ["und", "und"]


def test_no_labels(docs_of):
    assert li.learn(docs_of([(1, "a", None), (2, None, "en")], ", lang string")) is None
