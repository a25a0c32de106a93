"""The lexical index: plans, dates and pairs of characters, and batches of changes against rebuilt indexes."""
import datetime
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import lexical
from palimpsest.plans import retrieval

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def asked(spark):
    return spark.createDataFrame([(1, "alpha theta"), (2, "zeta gamma nowhere"), (3, "the of")], "query_id long, text string")


def found(index, queries):
    return sorted(tuple(r) for r in lexical.search(index, queries, 50).collect())


def check(spark, index, live):
    """The index answers as one that is built from the live documents, and knows the same frequencies."""
    fresh = lexical.build_index(table(spark, sorted(live.items())))
    mine = index.index()
    assert (mine.n, mine.average) == (fresh.n, pytest.approx(fresh.average) if fresh.average is not None else None)
    words = lambda i: sorted(tuple(r) for r in i.vocabulary.select("term", "df", "stem").collect())
    assert words(mine) == words(fresh)
    assert found(mine, asked(spark)) == found(fresh, asked(spark))


def test_changes_equal_a_rebuilt_index(spark):
    rng = random.Random(1)
    live, index = {}, lexical.MutableIndex(spark, fanout=3)
    check(spark, index, live)
    for step in range(7):
        batch = {rng.randrange(40): " ".join(rng.choices(WORDS, k=rng.randint(0, 9))) for _ in range(12)}
        index.add(table(spark, list(batch.items())))
        live |= batch
        if step % 2:
            gone = rng.sample(range(50), 10)
            index.remove(spark.createDataFrame([(g,) for g in gone], "doc_id long"))
            live = {k: v for k, v in live.items() if k not in gone}
        if step in (1, 4, 6):
            check(spark, index, live)
    assert len(index.segments) < 5 and max(s["level"] for s in index.segments) >= 1
    again = lexical.MutableIndex.restore(spark, index.path)
    assert (again.version, again.segments, again.dead) == (index.version, index.segments, index.dead)
    check(spark, again, live)
    index.clear()
    check(spark, index, {})


def test_odd_batches(spark):
    index = lexical.MutableIndex(spark)
    index.remove(spark.createDataFrame([(1,)], "doc_id long"))
    index.add(table(spark, []))
    index.add(table(spark, [(1, "alpha"), (1, "beta"), (None, "gamma"), (2, None), (3, "")]))  # of one id the last text stays
    check(spark, index, {1: "beta", 2: None, 3: ""})
    index.add(table(spark, [(1, "beta"), (1, "beta")]))
    index.remove(spark.createDataFrame([(2,), (2,), (None,), (9,)], "doc_id long"))
    check(spark, index, {1: "beta", 3: ""})
    index.remove(spark.createDataFrame([(1,), (3,)], "doc_id long"))
    check(spark, index, {})
    index.add(table(spark, [(1, "theta alpha")]))
    check(spark, index, {1: "theta alpha"})


def test_a_failed_change_leaves_the_version_before(spark):
    index = lexical.MutableIndex(spark)
    index.add(table(spark, [(1, "alpha"), (2, "theta")]))
    with pytest.raises(Exception):
        index.add(table(spark, [(1, "beta"), (3, "zeta")]).withColumn("text", F.raise_error(F.lit("stop"))))
    check(spark, lexical.MutableIndex.restore(spark, index.path), {1: "alpha", 2: "theta"})


def test_search_does_not_shuffle_postings(spark):
    """Only the asked terms and the hits are exchanged; the join with postings is a broadcast of terms."""
    sf = "/root/testdata/sf0.001"
    index = retrieval.document_index(spark, sf)
    hits = lexical.search(index, retrieval.asked(spark, sf), 10, prefix=True)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and plan.count("BroadcastHashJoin") >= 2


def test_dates_and_pairs_of_characters(spark):
    rows = [(1, "meeting about budgets", datetime.datetime(2024, 5, 3)), (2, "meeting", datetime.datetime(2024, 5, 4)), (3, "東京都の天気", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ts timestamp")
    index = lexical.build_index(docs, dates="ts", cjk=True)
    assert index.n == 3 and {r.term for r in index.frequency.collect()} >= {"@2024-05-03", "@05-04", "東京", "京都"}
    assert index.average == pytest.approx((3 + 1 + 5) / 3)  # dates don't lengthen a document
    q = spark.createDataFrame([(1, "meeting on 3 May 2024"), (2, "京都")], "query_id long, text string")
    got = [tuple(r)[:2] for r in lexical.search(index, q, 5, dates=True, cjk=True).orderBy("query_id", F.desc("score")).collect()]
    assert got == [(1, 1), (1, 2), (2, 3)]


def test_the_index_of_a_directory_follows_its_files(spark, tmp_path):
    path = str(tmp_path)
    table(spark, [(1, "alpha")]).write.parquet(f"{path}/documents.parquet")
    assert retrieval.document_index(spark, path).n == 1
    table(spark, [(1, "alpha"), (2, "beta")]).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    assert retrieval.document_index(spark, path).n == 2
    assert retrieval.document_index(spark, path) is retrieval.document_index(spark, path)


def test_frequencies_without_an_index(spark, monkeypatch):
    rows = [(1, "alpha beta alpha"), (2, "beta"), (3, None), (4, "alpha beta"), (4, "beta alpha"), (4, "beta"), (None, "gamma"), (None, "gamma")]
    want = lexical.build_index(table(spark, rows)).frequency.collect()
    monkeypatch.setattr(lexical, "postings", None)
    assert sorted(map(tuple, lexical.term_frequency(table(spark, rows)).collect())) == sorted(map(tuple, want)) == [("alpha", 2), ("beta", 4), ("gamma", 1)]


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hits_meet_in_the_bucket_of_their_document(spark):
    """No exchange by query and document: only the best hits of each bucket are dealt."""
    index = lexical.build_index(table(spark, [(i, "alpha theta " + WORDS[i % 10] + "x") for i in range(40)]))
    plan = executed(lexical.search(index, asked(spark), 10))
    assert "hashpartitioning(query_id" in plan and not [x for x in plan.splitlines() if "hashpartitioning" in x and "doc_id" in x]


def test_texts_are_dealt_before_they_are_cut(spark):
    plan = executed(lexical.postings(table(spark, [(1, "alpha beta")]), "doc_id", {"text": 1.0}))
    assert "split(" in plan and "split(" not in plan[plan.rindex("Exchange hashpartitioning"):]


def test_prefix_terms_come_once_however_many_queries_ask(spark):
    terms = spark.createDataFrame([(q, "al", 1.0, 1) for q in range(5)], "query_id long, term string, w double, df long")
    frequency = spark.createDataFrame([("al", 3), ("alpha", 2), ("beta", 1)], "term string, df long")
    assert [r.asDict() for r in lexical.prefix_expansions(terms, frequency).collect()] == [{"query_term": "al", "term": "alpha", "df": 2}]


def test_dead_documents_are_dropped_by_their_ids_alone(spark):
    """The postings of live documents need no exchange while the ids of dead ones are small, however long their texts were."""
    index = lexical.MutableIndex(spark)
    index.add(table(spark, [(i, " ".join(f"word{i}x{k}" for k in range(400))) for i in range(60)]))
    index.remove(spark.createDataFrame([(i,) for i in range(20)], "doc_id long"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16384")
    try:
        live = index._live("postings")
        assert "SortMergeJoin" not in executed(live) and "BroadcastHashJoin" in executed(live)
        assert live.select("doc_id").distinct().count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
