"""Pairs of files and edges of observations are dealt over parts that grow with the rows."""
import itertools
import random
from collections import Counter, defaultdict

from palimpsest.operators import graph, mining


def test_pairs_over_growing_parts_equal_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(mining, "PART", 20)
    rng = random.Random(5)
    rows = [(s, rng.randrange(12)) for s in range(60) for _ in range(5)] + [(99, f) for f in range(80)] + [(1, None), (None, 1)]
    got = mining.co_change_pairs(spark.createDataFrame(rows, "s long, f long"), "s", "f")
    files = defaultdict(set)
    for s, f in rows:
        if s is not None and f is not None:
            files[s].add(f)
    n = Counter(p for fs in files.values() for p in itertools.combinations(sorted(fs)[:50], 2))
    assert sorted(map(tuple, got.collect())) == sorted((*p, c) for p, c in n.items() if c >= 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    deals = [int(x.split("), REPARTITION_BY_NUM")[0].rsplit(", ", 1)[1]) for x in plan.splitlines() if "REPARTITION_BY_NUM" in x]
    assert max(deals) > 8  # more parts than the default width, as there are more pairs than fit it

    edges = graph.heuristic_edges(spark.createDataFrame(rows, "o long, f long").selectExpr("o", "f AS c", "f % 3 AS g"), "o", "c", "g")
    want = Counter()
    for o in {o for o, _ in rows}:
        mine = [f for x, f in rows if x == o and f is not None and o is not None]
        first = lambda v: sorted({str(x) for x in v})[:12]
        want.update(sorted(itertools.product(first(mine), first([f % 3 for f in mine])))[:12])
    assert sorted(tuple(r)[:3] for r in edges.collect()) == sorted((*e, c) for e, c in want.items())


def test_all_pairs_of_wide_sessions_equal_plain_loops(spark, monkeypatch):
    """Some files lie in more wide sessions than a rule needs, others in fewer; none is left out."""
    rng = random.Random(6)
    rows = [(s, f) for s in range(7) for f in rng.sample(range(120), 90 if s < 5 else 60)] + [(s, rng.randrange(140)) for s in range(10, 150) for _ in range(8)] + [(1, None), (None, 1), (1, 5), (1, 5)]
    files = defaultdict(set)
    for s, f in rows:
        if s is not None and f is not None:
            files[s].add(f)
    n = Counter(p for fs in files.values() for p in itertools.combinations(sorted(fs), 2))
    df = spark.createDataFrame(rows, "s long, f long")
    for wide, least in ((20, 4), (20, 1), (70, 3), (70, 9), (500, 4)):
        monkeypatch.setattr(mining, "WIDE", wide)
        want = sorted((*p, c) for p, c in n.items() if c >= least)
        assert sorted(map(tuple, mining.all_co_change_pairs(df, "s", "f", least).collect())) == want, (wide, least)
    assert mining.all_co_change_pairs(df.limit(0), "s", "f").count() == 0


def test_rules_of_a_session_with_many_files(spark, tmp_path):
    """Four orders of 60 suppliers: pairs beyond the first 50 are rules too, in Spark as in SQL."""
    import duckdb

    from palimpsest.plans import activity

    spark.createDataFrame([(o, s) for o in range(4) for s in range(60)], "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([("error", "Oops", 1), ("error", "oops", 2), ("error", "OOPS", 2), ("view", "oops", 3)], "event_type string, props string, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, activity.rule_generation(spark, str(tmp_path)).collect()))
    assert len(got) == 60 * 59 // 2 + 1 and ("When 58 changes, check 59 (4 sessions)", 4) in got
    con = duckdb.connect()
    for name in ("lineitem", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == sorted(con.execute(activity.ORACLES["rule_generation"]).fetchall())
