"""Hybrid and smart search: what is done with the legs, in plain Python, and pages of scopes that rank low."""
import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import hybrid, lexical

NOW = datetime.datetime(2024, 1, 1)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


@pytest.fixture(scope="module")
def store(spark):
    rng = random.Random(1)
    docs = [(i, rng.choice(["s1", "s2", "s3"]), NOW - datetime.timedelta(days=rng.randint(0, 400)), rng.choice(["a", "b"]), " ".join(rng.choices(WORDS, k=rng.randint(3, 9)))) for i in range(70)]
    records = spark.createDataFrame(docs, "id long, session_id string, ts timestamp, kind string, body string")
    index = lexical.build_index(records, "id", {"body": 1.0})
    vectors = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(0, 70, 2)]
    asked = spark.createDataFrame([(1, "alpha beta theta"), (2, "kappa zeta"), (3, "nowhere")], "query_id long, text string")
    qv = spark.createDataFrame([(1, [1.0, 0.5, 0.0, 0.2]), (3, [0.0, 1.0, 1.0, 0.0])], "query_id long, embedding array<double>")
    nodes = spark.createDataFrame([("n1", "Alpha"), ("n2", "Beta"), ("n3", "Gamma")], "node string, name string")
    edges = spark.createDataFrame([("n1", "n2", 0.8), ("n2", "n3", 0.5)], "src string, dst string, weight double")
    entities = spark.createDataFrame([(1, "alpha"), (2, "gamma")], "query_id long, entity string")
    sources = spark.createDataFrame([(f"n{1 + i % 3}", i) for i in range(0, 70, 5)], "node string, id long")
    return dict(docs={d[0]: d for d in docs}, records=records, index=index, vectors=spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), asked=asked, qv=qv, tied=(nodes, edges, entities, sources))


def by_query(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.doc_id, r.score))
    return {q: [d for d, _ in sorted(v, key=lambda x: (-x[1], x[0]))] for q, v in out.items()}


def expected(found, docs, k, cap=3, weights=hybrid.WEIGHTS, boost=None):
    ranks = {name: by_query(df) for name, df in found.items()}
    out = {}
    for q in {q for r in ranks.values() for q in r}:
        total = weights["lexical"] + sum(weights[n] for n in ranks if n != "lexical" and ranks[n].get(q))
        score = {}
        for n, r in ranks.items():
            for i, d in enumerate(r.get(q, []), 1):
                score[d] = score.get(d, 0) + weights[n] / (60 + i) / total
        score = {d: round(s * (boost or {}).get(d, 1), 9) for d, s in score.items()}
        order, first, rest, n = sorted(score, key=lambda d: (-score[d], d)), [], [], {}
        for d in order:
            s = docs[d][1]
            n[s] = n.get(s, 0) + 1
            (first if n[s] <= cap else rest).append(d)
        pool = (first + rest)[:max(k, 20)]
        age = lambda d: (NOW - docs[d][2]).days
        aged = {d: round(score[d] * (1 if age(d) <= 0 else 0.6 + 0.4 * 0.5 ** (age(d) / 180)), 9) for d in pool}
        words = {d: {w for w in docs[d][4].split() if len(w) > 2} for d in pool}
        final = {}
        for d in sorted(pool, key=lambda d: (-docs[d][2].timestamp(), d)):
            caps = [0.99 * final[o] for o in final if docs[o][2] > docs[d][2] and words[o] and words[d] and len(words[o] & words[d]) >= 0.5 * len(words[o] | words[d])]
            final[d] = min([aged[d], *caps])
        final = {d: round(s, 9) for d, s in final.items()}
        out[q] = [(d, final[d]) for d in sorted(final, key=lambda d: (-final[d], d))][:k]
    return out


def results(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, r.score))
    return out


@pytest.mark.parametrize("k, with_scope", [(5, False), (30, True)])
def test_three_legs(spark, store, k, with_scope):
    allowed = store["records"].where("session_id <> 's1'").select("id") if with_scope else None
    found = hybrid.legs(store["index"], store["asked"], 100, 20, allowed, store["vectors"], store["qv"], store["tied"])
    assert set(found) == {"lexical", "vector", "graph"} and all(df.count() for df in found.values())
    if with_scope:
        assert not any(store["docs"][d][1] == "s1" for df in found.values() for ds in by_query(df).values() for d in ds)
    got = results(hybrid.hybrid_search(found, store["records"], F.lit(NOW), k))
    want = expected(found, store["docs"], k)
    assert {q: [d for d, _ in v] for q, v in got.items()} == {q: [d for d, _ in v] for q, v in want.items()}
    assert all(a[1] == pytest.approx(b[1], abs=2e-9) for q in want for a, b in zip(got[q], want[q]))


def test_a_query_without_vectors_shares_out_its_weights(spark, store):
    found = hybrid.legs(store["index"], store["asked"], vectors=store["vectors"], asked=store["qv"])
    got = hybrid.fused(found)
    best = got.where("query_id = 2").orderBy(F.desc("score"), "doc_id").first()
    assert best.score == pytest.approx(1 / 61, abs=1e-9)
    boosted = hybrid.fused(found, boosts=spark.createDataFrame([(best.doc_id, 2.0)], "id long, boost double"))
    assert boosted.where(f"query_id = 2 AND doc_id = {best.doc_id}").first().score == pytest.approx(2 / 61, abs=2e-9)


def test_fusion_of_magnitudes(spark, store):
    found = hybrid.legs(store["index"], store["asked"], 10, vectors=store["vectors"], asked=store["qv"])
    got = {(r.query_id, r.doc_id): r.score for r in hybrid.norm_fused(found).collect()}
    lex = {(r.query_id, r.doc_id): r.score for r in found["lexical"].collect()}
    vec = {(r.query_id, r.doc_id): r.score for r in found["vector"].collect()}
    for q, d in got:
        mine = [s for (x, _), s in lex.items() if x == q]
        spread = (max(mine) - min(mine) or 1) if mine else 1
        want = (0.4 * (lex[q, d] - min(mine)) / spread if (q, d) in lex else 0) + (0.6 * (vec[q, d] + 1) / 2 if (q, d) in vec else 0)
        assert got[q, d] == pytest.approx(want / (1.0 if any(x == q for x, _ in vec) else 0.4), abs=2e-9)


def test_a_scope_below_the_depth_still_fills_its_page(spark):
    """150 better hits of another project don't shorten the page of a small one."""
    rows = [(i, "big", NOW, "a", "alpha alpha alpha") for i in range(150)] + [(1000 + i, "small", NOW, "a", f"alpha {' '.join(WORDS[1:])} own{i}") for i in range(4)]
    records = spark.createDataFrame(rows, "id long, session_id string, ts timestamp, kind string, body string")
    index = lexical.build_index(records, "id", {"body": 1.0})
    asked = spark.createDataFrame([(1, "alpha")], "query_id long, text string")
    small = records.where("session_id = 'small'").select("id")
    found = hybrid.legs(index, asked, allowed=small)
    assert {d for d in results(hybrid.hybrid_search(found, records, F.lit(NOW), 10))[1] for d in [d[0]]} == {1000, 1001, 1002, 1003}


def test_smart_search(spark, store):
    found = hybrid.legs(store["index"], store["asked"], vectors=store["vectors"], asked=store["qv"], tied=store["tied"])
    lessons = spark.createDataFrame([(1, i, 1.0 - i / 100) for i in range(15)], "query_id long, id long, score double")
    got = hybrid.smart_search(found, store["records"], F.lit(NOW), 12, {"lesson": lessons, "fact": lessons.where("id < 2")}).collect()
    kinds = {}
    for r in got:
        kinds.setdefault((r.query_id, r.kind), []).append((r.rank, int(r.id)))
    assert sorted(kinds[1, "lesson"]) == [(i + 1, i) for i in range(10)] and sorted(kinds[1, "fact"]) == [(1, 0), (2, 1)]
    # above the floor: near the best lexical score, or a lexical hit whose vector is close; newer ones stand above those they repeat
    lex = {r.doc_id: r.score for r in found["lexical"].where("query_id = 1").collect()}
    vec = {r.doc_id: r.score for r in found["vector"].where("query_id = 1").collect()}
    order = [d for d, _ in expected(found, store["docs"], 120)[1]]
    kept = [d for d in order if lex.get(d, 0) >= max(3.5, 0.5 * max(lex.values())) or lex.get(d, 0) > 0 and vec.get(d, 0) >= 0.3]
    terms = {d: set(re.findall(r"[a-z]{3,}", store["docs"][d][4])) for d in kept}
    shadows = {}
    for d in kept:
        newer = sorted((o for o in kept if store["docs"][o][2] > store["docs"][d][2] and store["docs"][o][3] == store["docs"][d][3] and len(terms[o] & terms[d]) >= max(2, 0.3 * min(len(terms[o]), len(terms[d])))),
                       key=lambda o: (-store["docs"][o][2].timestamp(), o))
        if newer:
            shadows.setdefault(newer[0], []).append(d)
    want = list(kept)
    for d in kept:
        if d in shadows:
            o = min(shadows[d])
            if want.index(o) < want.index(d):
                want.remove(d)
                want.insert(want.index(o), d)
    assert [d for _, d in sorted(kinds[1, "record"])] == want[:12]
