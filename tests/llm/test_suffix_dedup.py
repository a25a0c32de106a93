import hashlib
import random

import numpy as np

from palimpsest.llm import suffix_dedup as sd


def brute(rows):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        mark = bytearray(len(b))
        for i in range(len(b) - sd.LENGTH + 1):
            w = b[i : i + sd.LENGTH]
            if w in seen:
                mark[i : i + sd.LENGTH] = b"\1" * sd.LENGTH
            seen.add(w)
        kept = bytes(x for x, m in zip(b, mark) if not m)
        spans = sum(1 for i in range(len(b)) if mark[i] and (i == 0 or not mark[i - 1]))
        out[d] = (len(b), sum(mark), spans, hashlib.sha256(kept).hexdigest())
    return out


def results(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove_repeats(df).collect()}


def passages(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab cdefé") for _ in range(rng.randint(80, 400))) for _ in range(8)]
    rows = []
    for i in range(n):
        t = ""
        for _ in range(rng.randint(0, 5)):
            b = rng.choice(base)
            a = rng.randint(0, len(b))
            t += b[a : a + rng.randint(0, 300)] if rng.random() < 0.6 else "".join(rng.choice("abc") for _ in range(rng.randint(0, 150)))
        if rng.random() < 0.1:
            t = rng.choice(["a", "ab", "abc"]) * rng.randint(40, 200)
        rows.append((i * 7 % n, t if rng.random() > 0.03 else None))
    return rows


def test_against_brute_force(docs_of):
    rows = passages(1, 211)
    assert results(docs_of(rows)) == brute(rows)


def test_long_text_in_pieces(docs_of, monkeypatch):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    rows = [(1, long), (2, "x" + long[5_000:9_000] + "y" + long[100:220]), (3, long)]
    assert results(docs_of(rows)) == brute(rows)
    monkeypatch.setattr(sd, "STRIDE", 777)
    entries = [e for batch in docs_of(rows).coalesce(1).selectExpr("doc_id", "cast(0 as long) as th", "text").toArrow().to_batches() for e in sd.batch_entries(batch, np.empty(0, np.uint64))]
    assert sum((e[3] & 127).sum() for e in entries) == sum(len(t.encode()) - 99 for _, t in rows)


def test_anchor_with_many_surroundings(docs_of, monkeypatch):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(130))
    noise = lambda: "".join(rng.choice("stuvwxyz ") for _ in range(rng.randint(60, 90)))
    rows = [(i, noise() + passage + noise()) for i in range(150)]
    hot = sd.hot_anchors(docs_of(rows).selectExpr("doc_id as d", "cast(0 as long) as th", "text"))
    assert len(hot) > 0
    assert results(docs_of(rows)) == brute(rows)


def test_edges(docs_of, spark):
    assert sd.remove_repeats(docs_of([(1, "a")]).limit(0)).collect() == []
    rng = random.Random(4)
    text = "".join(rng.choice("abcdef") for _ in range(300))
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, text[:99])]
    got = sorted((r.doc_id if r.doc_id is not None else 99, r.n_bytes, r.n_removed) for r in sd.remove_repeats(docs_of([(*r, 7) for r in rows], ", spans int")).collect())
    assert got == [(1, 300, 0), (1, 300, 0), (2, 0, 0), (3, 0, 0), (4, 99, 0), (99, 300, 300)]


def test_levels_merge_geometrically():
    rng = np.random.default_rng(5)
    levels, gone = sd.SuffixLevels(), 0
    values = rng.integers(0, 500, 2000).astype(np.uint64)
    for k in range(0, 2000, 50):
        at = np.arange(k, k + 50)
        gone += len(levels.add(values[k : k + 50], values[k : k + 50], 5000 - at, at)[0])
        sizes = [len(x[0]) for x in levels.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
    fp, _, doc, _ = levels.entries()
    assert len(fp) + gone == 2000 and len(np.unique(fp)) == len(fp)
    assert all(doc[fp == v][0] == 5000 - np.flatnonzero(values == v).max() for v in np.unique(values))


def test_rows_of_one_id_or_none_are_told_apart(docs_of, spark):
    """Rows whose hashes agree in their last 24 bits, without an id or with the same: each keeps its own spans."""
    from pyspark.sql import functions as F

    texts = spark.range(20_000).select(F.concat(F.sha2(F.col("id").cast("string"), 256), F.repeat(F.lit("q"), (150 * (F.col("id") % 2)).cast("int")), F.sha2(F.concat(F.lit("x"), "id"), 256)).alias("text"))
    clash = texts.groupBy(F.xxhash64("text").bitwiseAND(0xFFFFFF).alias("th")).agg(F.collect_list("text").alias("texts")).where("size(texts) > 1").collect()
    assert len(clash) > 3
    for doc_id in (None, 4):
        rows = texts.select(F.lit(doc_id).cast("long").alias("doc_id"), "text")
        placed = [r.text for r in sd.keyed_rows(rows, "doc_id", "text").orderBy("d", "th").collect()]
        want = brute(list(enumerate(placed)))
        got = [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove_repeats(rows).collect()]
        assert sorted(got) == sorted(want.values())
