import math
import os
import random
import re
import string
from collections import Counter

import duckdb
import pytest

from palimpsest.llm import ranked_search as rs

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute(docs, items, k=10):
    """All pairs, by the definition of the score."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in counts if c]
    n, total = len(held), sum(x for *_, x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked, scored = Counter(terms(text)), []
        for row, (d, c, size) in enumerate(held):
            m = 100 - 75 + ((75 * size * n) // total)
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, row, d))
        out += [(item, r, x[4], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def results(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    return sorted((tuple(r) for r in rs.ranked_search(d, i, **more).collect()), key=repr)


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 60)))) for i in range(n)]
    items = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 25)))) for i in range(25)]
    docs += [(1000 + i, items[i % 7][1]) for i in range(60)]  # copies of items, so that thresholds are high and tie
    return docs, items


@pytest.mark.parametrize("seed, k, block_bytes", [(1, 10, 1 << 23), (2, 3, 200), (3, 1, 1 << 23), (4, 400, 1 << 23)])
def test_against_brute_force(spark, seed, k, block_bytes):
    docs, items = corpus(seed)
    assert results(spark, docs, items, k=k, block_bytes=block_bytes) == brute(docs, items, k)


def test_pairs_are_dealt_in_small_lots(monkeypatch, spark):
    """The same rows whatever the number of pairs that a task holds at a time."""
    docs, items = corpus(5)
    block = rs.Block.of(list(enumerate(t for _, t in items)))
    import numpy as np
    import pyarrow as pa

    place = {t: i for i, t in enumerate(block.terms)}
    rows = [sorted((place[t], c) for t, c in rs.term_counts(t).items() if t in place) for _, t in docs]
    block.w = np.arange(len(block.terms), dtype=np.int64) + 1
    posts = rs.Postings(block, np.full(len(rows), 50), pa.array([[t for t, _ in r] for r in rows], pa.list_(pa.int32())), pa.array([[c for _, c in r] for r in rows], pa.list_(pa.int32())))
    most = np.zeros(len(block.terms), np.int64)
    np.maximum.at(most, posts.tid, posts.impact)
    block.ordered(most, np.zeros_like(most))
    block.threshold = np.array([np.sort(posts.scores(np.arange(len(rows)), np.full(len(rows), i)))[-10] for i in range(len(items))])
    block.pruned(most)
    assert (block.gen_end < block.first[1:]).any() and (block.near_end < block.first[1:]).any()
    owner = block.owner()
    gen = np.flatnonzero(np.arange(len(block.tid)) < block.gen_end[owner])
    gen = gen[np.argsort(block.tid[gen], kind="stable")]
    ptr = np.searchsorted(block.tid[gen], np.arange(len(block.terms) + 1))
    seen = []
    for lot in (1, 50, 1 << 18):
        monkeypatch.setattr(rs, "MOST_PAIRS", lot)
        seen.append(sorted((int(r), int(i), int(s)) for a, b, c in posts.found((ptr, owner[gen], block.times[gen]), np.diff(ptr)) for r, i, s in zip(a, b, c)))
    assert seen[0] == seen[1] == seen[2]
    want = [(r, i, int(posts.scores(np.array([r]), np.array([i]))[0])) for r in range(len(rows)) for i in range(len(items))]
    assert seen[0] == [x for x in want if x[2] >= block.threshold[x[1]] and x[2] > 0]


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " ,."), (4, "É é e E"), (4, "É é e E"), (None, "e e e"), (5, "long " * 200_000 + "end"), (6, "A_b-c d9"), (7, "e")]
    items = [(1, "e É"), (1, "e É"), (2, None), (None, "LONG end"), (3, "!"), (4, "b b c nowhere"), (5, "d9 e " * 50)]
    assert results(spark, docs, items) == brute(docs, items)
    assert results(spark, [], items) == [] and results(spark, docs, []) == [] and results(spark, docs, [(1, None)]) == []
    assert rs.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "?")], "item_id long, text string")).columns == ["item_id", "rank", "doc_id", "score"]


def test_clashing_columns(spark):
    docs, items = corpus(6, 40)
    d = spark.createDataFrame([(*r, 1, 2, "x") for r in docs], "doc_id long, text string, doc int, n int, item_id string")
    i = spark.createDataFrame([(*r, 1, 2) for r in items], "item_id long, text string, doc_id int, item int")
    assert sorted((tuple(r) for r in rs.ranked_search(d, i).collect()), key=repr) == brute(docs, items)


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = "".join(random.Random(1).choices("abÉ ,_", k=5000))
    whole = rs.term_counts(text)
    monkeypatch.setattr(rs, "PIECE", 3)
    assert rs.term_counts(text) == whole == Counter(t.encode() for t in terms(text))


def test_sql(spark):
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    for t in ("documents", "benchmark"):
        duckdb.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert sorted(tuple(r) for r in rs.op13_ranked_search(spark, sf).collect()) == sorted(duckdb.execute(rs.ORACLE).fetchall())
