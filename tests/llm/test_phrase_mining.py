import os
import random
import re
import string
from collections import Counter

import duckdb
import pytest

from palimpsest.llm import phrase_mining as pm

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, least, longest=5, share=100, k=2000):
    """Every count, cut and containment by its definition."""
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    key = (lang, tuple(words[i:i + size]))
                    f[key] = f.get(key, 0) + 1
    found = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    out = {}
    for (lang, p), a in found.items():
        inside = lambda q: any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731, B023
        if any(g == lang and len(q) > len(p) and 100 * b >= share * a and inside(q) for (g, q), b in found.items()):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:c]] * f[lang, p[c:]]), c, f[lang, p[:c]], f[lang, p[c:]]) for c in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, v in out.items() for i, (s, a, p, left, right) in enumerate(sorted(v)[:k], 1))


def results(spark, rows, least, **more):
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    return sorted(tuple(r) for r in pm.mine_phrases(df, least, **more).collect())


def prose(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "Étude", "b\x01", "b", "c", "d.e", "f\tg", "h!", "\x0c"] + [f"r{i}" for i in range(30)]
    passage = "one two three four five six"
    return [(rng.choice(["en", "fr", None]), " ".join(rng.choices(words, [9] * 12 + [1] * 30, k=80)) + (f" {passage}" if i % 3 else f", {passage} new york.")) for i in range(n)]


@pytest.mark.parametrize("seed, more", [(1, {}), (2, {"longest": 3}), (3, {"k": 7}), (4, {"share": 50}), (5, {"longest": 2})])
def test_against_brute_force(spark, seed, more):
    rows = prose(seed)
    want = brute(rows, 6, **more)
    assert results(spark, rows, 6, **more) == want and len(want) > 10


@pytest.mark.parametrize("bound", ["MOST_WORDS", "MOST_KNOWN"])
def test_bounds_of_tasks_change_nothing(spark, monkeypatch, bound):
    """Words that are gathered and remembered in small lots give the same counts (the bounds are read where the job is made)."""
    rows = prose(6) + [("en", " ".join(t for _, t in prose(8)))]
    monkeypatch.setattr(pm, bound, 40)
    assert results(spark, rows, 6) == brute(rows, 6)


def test_segments(monkeypatch):
    monkeypatch.setattr(pm, "SEGMENT", 40)
    text = "".join(random.Random(9).choices("ab É,.\n\t\x0b", k=3000))
    whole = [w for words in pm.segments(text) for w in words]
    assert sum(1 for _ in pm.segments(text)) > 50
    assert [p.split() for p in b" ".join(whole).split(pm.BREAK)] == [p.split() for p in text.encode().translate(pm.SEEN_AS).split(b"\n")]


def test_walk_keeps_prefixes_apart():
    """Words that sort before the blank must not part the pointers of a prefix."""
    pointers = Counter({b"a b c ": 2, b"a b\x01 c ": 3, b"a b c d ": 4, b"a b c\x01 d ": 5, b"a b cc ": 1})
    rows = sorted(("en", p, n) for p, n in pointers.items())
    assert list(pm.grown(iter(rows), 2)) == [("en", b"a b\x01 c", 3), ("en", b"a b c\x01 d", 5), ("en", b"a b c\x01", 5), ("en", b"a b c d", 4), ("en", b"a b c", 6)]


def test_odd_rows(spark):
    rows = [("en", None), (None, ""), ("und", "x y z"), (None, "X y Z"), ("", "x y"), ("", "x y"), ("en", "a a a a a a a"), ("en", " . \t,"), ("fr", "p q " * 200_000), ("en", "a a a a a a a")]
    assert results(spark, rows, 2) == brute(rows, 2)
    assert results(spark, [], 2) == []
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows[:8]], "lang string, text string, n int, phrase string, a int")
    assert sorted(tuple(r) for r in pm.mine_phrases(df, 2).collect()) == brute(rows[:8], 2)


def test_sums_beyond_64_bits(spark):
    phrases = spark.createDataFrame([("en", "", 4 * 10**17), ("en", "a", 3 * 10**14), ("en", "b", 2 * 10**14), ("en", "a b", 10**14 + 1)], "lang string, phrase string, n long")
    row = pm.scored_phrases(phrases).first()
    assert row["score"] == 1000 * (10**14 + 1) * 4 * 10**17 // (3 * 10**14 * 2 * 10**14)


def test_sql(spark):
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    duckdb.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(duckdb.execute(pm.ORACLE).fetchall())
    assert sorted(tuple(r) for r in pm.op11_phrases(spark, sf).collect()) == want and len(want) > 5
