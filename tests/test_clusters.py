"""Clusterings, threads and merges against the sequential pass."""
import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import clusters, graph

T0 = datetime.datetime(2024, 1, 1)


def greedy(nodes, edges, most=None):
    """One seed after the other, as the pass is defined."""
    around = {}
    for a, b, stale in edges:
        if not stale:
            around.setdefault(a, set()).add(b)
            around.setdefault(b, set()).add(a)
    concepts = {i for i, kind, stale in nodes if kind == "concept" and not stale}
    taken, out = set(), []
    for seed in sorted(concepts, key=lambda i: (-len(around.get(i, ())), i)):
        if most is not None and len(out) >= most:
            break
        if seed in taken:
            continue
        level, seen, cluster = [seed], set(), []
        for _ in range(3):
            after = []
            for x in level:
                if x in seen or x in taken:
                    continue
                seen.add(x)
                if x in concepts:
                    cluster.append(x)
                    taken.add(x)
                after += [y for y in around.get(x, ()) if y not in seen]
            level = after
        if len(cluster) >= 2:
            out.append((seed, frozenset(cluster)))
    return out


def grouped(rows):
    out = {}
    for a, b in rows:
        out.setdefault(a, set()).add(b)
    return {(a, frozenset(b)) for a, b in out.items()}


@pytest.mark.parametrize("seed, n, m, most", [(1, 40, 30, None), (2, 60, 120, None), (3, 80, 70, 4), (4, 30, 28, 1)])
def test_concept_clusters(spark, seed, n, m, most):
    rng = random.Random(seed)
    nodes = [(f"n{i:02}", rng.choice(["concept", "concept", "file"]), rng.choice([None, False, False, False, True])) for i in range(n)]
    edges = [(rng.choice(nodes)[0], rng.choice(nodes)[0], rng.choice([None, False, False, True])) for _ in range(m)]
    if seed == 4:
        edges = [(f"n{i:02}", f"n{i + 1:02}", False) for i in range(n - 1)]  # a path: seeds depend on each other in a chain
    got = clusters.concept_clusters(spark.createDataFrame(nodes, "id string, type string, stale boolean"), spark.createDataFrame(edges, "src string, dst string, stale boolean"), most)
    assert grouped((r.seed, r.id) for r in got.collect()) == set(greedy(nodes, edges, most))


def test_concept_clusters_of_a_hub_and_of_nothing(spark):
    nodes = spark.range(2001).select(F.col("id"), F.lit("concept").alias("type"), F.lit(False).alias("stale"))
    hub = spark.range(1, 2001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"), F.lit(False).alias("stale"))
    assert clusters.concept_clusters(nodes, hub).groupBy("seed").count().collect() == [(0, 2001)]
    assert clusters.concept_clusters(nodes, hub.limit(0)).collect() == []


def passes(facts, lessons, most=None):
    rows = {}
    for i, fact in sorted(facts):
        for t in re.split(r"\s+", (fact or "").lower()):
            if len(t) > 3:
                rows.setdefault(t, set()).add(i)
    for i, tags in sorted(lessons):
        for t in tags or ():
            rows.setdefault(t.lower(), set()).add(i)
    terms, seen, out = [t for t in rows if len(rows[t]) >= 2], set(), []
    for t in terms:
        if most is not None and len(out) >= most:
            break
        if t in seen:
            continue
        near = [u for u in terms if u not in seen and u != t and len(rows[t] & rows[u]) / len(rows[t] | rows[u]) > 0.3]
        seen |= {t, *near}
        if near:
            out.append((t, frozenset([t, *near])))
    return set(out)


@pytest.mark.parametrize("seed, most", [(1, None), (2, 3), (3, None)])
def test_term_clusters(spark, seed, most):
    rng = random.Random(seed)
    words = [f"term{i}" for i in range(25)] + ["ab", "É́term"]
    facts = [(f"f{i:02}", rng.choice([None, " ".join(rng.choices(words, k=rng.randint(0, 8)))])) for i in range(40)]
    lessons = [(f"l{i:02}", rng.choice([None, [], ["Term1", "x"], ["x", "TERM2", "y"]])) for i in range(10)]
    got = clusters.term_clusters(spark.createDataFrame(facts, "id string, fact string"), spark.createDataFrame(lessons, "id string, tags array<string>"), most)
    want = passes(facts, lessons, most)
    assert grouped((r.leader, r.term) for r in got.collect()) == want and want


def test_leaders_along_a_chain(spark):
    pairs = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r.id: r.leader for r in clusters.leaders(pairs, spark.range(61)).collect()}
    assert got == {i: i - i % 2 for i in range(61)}
    assert clusters.leaders(pairs.limit(0), spark.range(0)).collect() == []


def thread_of(rows):
    held, out = {i: (p, t) for i, p, t in rows}, {}
    for i in held:
        path, at = [], i
        while True:
            parent, own = held[at]
            if own is not None or parent not in held:
                out[i] = own if own is not None else (None if at == i else at)
                break
            if at in path:
                out[i] = min(path[path.index(at):])
                break
            path.append(at)
            at = parent
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_threads(spark, seed):
    rng = random.Random(seed)
    rows = [(f"m{i:03}", rng.choice([None, "gone", f"m{rng.randrange(80):03}", f"m{max(0, i - 1):03}"]), rng.choice([None] * 9 + ["own"])) for i in range(80)]  # with circles
    df = spark.createDataFrame(rows, "id string, reply_to string, thread_id string")
    assert {r.id: r.thread_id for r in clusters.threads(df).collect()} == thread_of(rows)


def test_deep_threads_and_circles(spark):
    rows = [(i, i - 1 if i else None, None) for i in range(300)] + [(1000 + i, 1000 + (i + 1) % 37, None) for i in range(37)] + [(2000, 1005, None), (3000, 3000, None)]
    df = spark.createDataFrame(rows, "id long, reply_to long, thread_id long")
    got = {r.id: r.thread_id for r in clusters.threads(df).collect()}
    assert got == {**{i: 0 for i in range(1, 300)}, 0: None, **{1000 + i: 1000 for i in range(37)}, 2000: 1000, 3000: 3000}
    assert clusters.threads(df.limit(0)).collect() == []


def words(t):
    return {w for w in re.split(r"\s+", t.lower()) if len(w) > 2}


def collapse(rows, keep, cap):
    by, out, moved = {}, {}, {}
    for r in rows:
        if r["deleted"]:
            out[r["id"]] = dict(r)
            continue
        by.setdefault((r["project"] or "", ",".join(sorted(c.lower() for c in r["concepts"]))), []).append(dict(r))
    last = lambda r: r["last_reinforced_at"] or r["created_at"]
    for some in by.values():
        some.sort(key=lambda r: (-r["reinforcements"], -r["confidence"], -last(r).timestamp(), r["id"]))
        stay, go = some[:keep], some[keep:]
        said = {r["id"]: r["content"] for r in some}
        for o in go:
            def like(s):
                a, b = words(said[s["id"]]), words(o["content"])
                return len(a & b) / len(a | b) if a and b else float(said[s["id"]].strip().lower() == o["content"].strip().lower())
            best = max(stay, key=lambda s: (like(s), -stay.index(s)))
            moved[o["id"]] = best["id"]
            best["reinforcements"] += o["reinforcements"]
            best["confidence"] = max(best["confidence"], o["confidence"])
            if o["last_reinforced_at"] and (not best["last_reinforced_at"] or o["last_reinforced_at"] > best["last_reinforced_at"]):
                best["last_reinforced_at"] = o["last_reinforced_at"]
            best["source_memory_ids"] = best["source_memory_ids"] + o["source_memory_ids"]
            best["source_lesson_ids"] = list(dict.fromkeys(best["source_lesson_ids"] + o["source_lesson_ids"]))
        for s in stay:
            if s["id"] in moved.values():
                s["source_memory_ids"] = list(dict.fromkeys(s["source_memory_ids"][::-1]))[:cap][::-1]
            out[s["id"]] = s
    return out, moved


@pytest.mark.parametrize("seed", [1, 2])
def test_insights_collapse(spark, seed):
    rng = random.Random(seed)
    pick = lambda k: rng.sample([f"s{i}" for i in range(12)], k)
    rows = [{"id": f"i{i:02}", "project": rng.choice([None, "p"]), "concepts": rng.choice([["A", "b"], ["B", "a"], ["c"]]), "content": " ".join(rng.choices(["alpha", "beta", "gamma", "of"], k=rng.randint(1, 4))),
             "confidence": rng.choice([0.2, 0.5, 0.9]), "reinforcements": rng.randint(0, 3), "created_at": T0 + datetime.timedelta(days=rng.randint(0, 5)),
             "last_reinforced_at": rng.choice([None, T0 + datetime.timedelta(days=rng.randint(0, 9))]), "source_memory_ids": pick(rng.randint(0, 4)), "source_lesson_ids": pick(rng.randint(0, 2)), "deleted": rng.random() < 0.1}
            for i in range(40)]
    kinds = ("id string, project string, concepts array<string>, content string, confidence double, reinforcements int, created_at timestamp, last_reinforced_at timestamp, "
             "source_memory_ids array<string>, source_lesson_ids array<string>, deleted boolean")
    after, merged = clusters.collapse_insights(spark.createDataFrame(rows, kinds), keep=3, most_sources=6)
    want, moved = collapse(rows, 3, 6)
    names = list(rows[0])
    assert {r.id: r.merged_into for r in merged.collect()} == moved and moved
    assert {r.id: r.asDict() for r in after.collect()} == {k: {n: v[n] for n in names} for k, v in want.items()}
    refs = spark.createDataFrame([("e1", next(iter(moved))), ("e2", "other"), ("e3", None)], "e string, insight_id string")
    assert {r.e: r.insight_id for r in clusters.remap(refs, merged, "insight_id").collect()} == {"e1": next(iter(moved.values())), "e2": "other", "e3": None}


def test_connected(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    want = {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert {r.node: r.component for r in graph.connected(spark.createDataFrame(edges, "src int, dst int")).collect()} == want
