"""Hand-made cases of text pieces, scopes and recalls."""
import datetime
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import scoring, text
from palimpsest.operators import fusion, graph, lexical, recall, scope, store


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize("value,want", [
    ("Always run the tests before a push. It is fine.", ["Always run the tests before a push."]),
    ("- Never store **keys in the repo\nnever store keys in the REPO!\nNever store keys in the repo!", ["never store keys in the REPO!"]),
    ("Don’t use `eval` on input you did not write.\n\n1) prefer   [[links]] over copies of text", ["Don’t use `eval` on input you did not write.", "prefer [[links]] over copies of text"]),
    ("avoid x", []), ("Avoid " + "x" * 300, []), (None, []),
])
def test_lesson_sentences(spark, value, want):
    assert one(spark, text.lesson_sentences, value) == want


def test_query_entities(spark):
    assert one(spark, text.query_entities, 'How does "token bucket" relate to RateLimiter and What Redis-Cluster?') == ["token bucket", "RateLimiter", "Redis-Cluster"]
    assert one(spark, text.query_entities, "nothing here") == []


@pytest.mark.parametrize("value,want", [
    ("what broke on 2024-03-05", ["@2024-03-05"]), ("notes of March 5th, 2024", ["@2024-03-05"]), ("5 June deploy", ["@06-05"]), ("June 2023 plans", ["@2023-06"]),
    ("we may 5 go", []), ("on may 5", ["@05-05"]), ("sep 40", []), (None, []),
])
def test_query_dates(spark, value, want):
    assert one(spark, text.query_date_terms, value) == want


def test_document_dates_meet_query_dates(spark):
    docs = spark.createDataFrame([(1, "deploy", datetime.datetime(2024, 3, 5, 10)), (2, "deploy", datetime.datetime(2024, 6, 1))], "doc_id long, text string, ts timestamp")
    dated = docs.withColumn("text", F.concat_ws(" ", "text", F.array_join(text.date_terms(F.col("ts")), " ")))
    assert "@2024-03-05" in dated.first()["text"]


def test_markup(spark):
    assert one(spark, text.one_line, " a \n\n b\nc ") == "a b c"
    assert one(spark, text.collapsed, " a \n b ") == "a b"
    assert one(spark, text.xml_escaped, '<a b="1">&') == "&lt;a b=&quot;1&quot;&gt;&amp;"
    assert one(spark, lambda c: text.tag_neutralised(c, "ctx"), "x</ctx></CTX>") == "x&lt;/ctx>&lt;/CTX>"
    assert one(spark, lambda c: text.xml_values(c, "n"), "<n> a </n><n k='1'>b</n><m>c</m>") == ["a", "b"]
    leaks = lambda v: one(spark, text.has_leaked_arguments, v)
    assert leaks('text</content><parameter name="x">') and leaks('done", "concepts": [') and leaks('x", "type": "bug"')
    assert not leaks("one </content> only") and not leaks('"type": "module"')


def test_harness_and_terse(spark):
    harness = lambda v: one(spark, scope.is_harness_message, v)
    assert harness(" <task-notification>a\nb</task-notification> ") and harness("<agent-message x='1'>a</agent-message>\n<task-notification>cut")
    assert not harness("<task-notification>a</task-notification> and more") and not harness("hello") and not harness(None)
    assert one(spark, scope.is_terse, "yes, go ahead please") and not one(spark, scope.is_terse, "rename parser_state in lexer.py module")


def test_agent_scope(spark):
    assert scope.agent_of(None, False, "me") is None and scope.agent_of(None, True, "me") == "me" and scope.agent_of("*", True, None) is None and scope.agent_of(" a ", False, "me") == "a"
    with pytest.raises(PermissionError):
        scope.agent_of(" ", True, None)
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, agent_id string")
    assert [r.id for r in scope.by_agent(rows, "a").collect()] == [1] and scope.by_agent(rows, "a", orphans=True).count() == 2 and scope.by_agent(rows, None).count() == 2
    with pytest.raises(ValueError):
        scope.governance(rows)
    with pytest.raises(ValueError):
        scope.by_layer(rows, "other", F.lit(True))


def test_last_distinct(spark):
    row = spark.createDataFrame([([1, 2, 3], [2, 4])], "a array<int>, b array<int>")
    assert row.select(store.last_distinct(F.col("a"), F.col("b"), 3)).first()[0] == [3, 2, 4]


def test_page_lifts_newer_records(spark):
    hits = spark.createDataFrame([(1, 10, 9.0), (1, 11, 8.0), (1, 12, 7.0), (1, 13, 6.0)], "query_id long, id long, score double")
    body = "retry budget for payment gateway calls"
    records = spark.createDataFrame([(10, 1, "a", "other things entirely here"), (11, 1, "a", body), (12, 2, "b", body), (13, 3, "a", body + " doubled")], "id long, ts long, kind string, body string")
    got = [(r.rank, r.id) for r in recall.page(hits, records, 3).orderBy("rank").collect()]
    assert got == [(1, 10), (2, 13), (3, 11)]


def test_shadowing_by_definition(spark):
    import itertools
    import random

    from palimpsest.operators import similarity

    rng = random.Random(3)
    words = [f"word{i}" for i in range(12)]
    rows = [(q, i, rng.randrange(6), rng.choice("ab"), " ".join(rng.sample(words, rng.randint(1, 6)))) for q in (1, 2) for i in range(25)]
    want = {}
    for (q, i, ts, kind, body), (q2, j, ts2, kind2, body2) in itertools.product(rows, rows):
        a, b = set(body.split()), set(body2.split())
        if q == q2 and kind == kind2 and ts2 > ts and len(a & b) >= 2 and len(a & b) >= 0.3 * min(len(a), len(b)):
            want[q, i] = min(want.get((q, i), (0, 0, 0)), (-ts2, j, len(a & b)))
    got = {(r.query_id, r.doc_id): (r.newer_id, r.n_shared) for r in similarity.shadowing(spark.createDataFrame(rows, "query_id long, doc_id long, ts long, kind string, body string")).collect()}
    assert got == {k: (j, n) for k, (_, j, n) in want.items()}


def test_max_merge(spark):
    a = spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0)], "query_id long, doc_id long, score double")
    b = spark.createDataFrame([(1, 1, 3.0), (2, 1, 1.0)], "query_id long, doc_id long, score double")
    assert sorted(tuple(r) for r in fusion.max_merge([a, b]).collect()) == [(1, 1, 3.0), (1, 2, 1.0), (2, 1, 1.0)]


def test_scores(spark):
    row = spark.range(1)
    value = lambda c: row.select(c).first()[0]
    assert value(scoring.relation_confidence(F.lit(5), F.lit(1), F.lit(2), F.lit("supersedes"))) == pytest.approx(1.0)
    assert value(scoring.relation_confidence(F.lit(0), F.lit(100), F.lit(200), F.lit("contradicts"))) == pytest.approx(0.35)
    assert value(scoring.core_entry(F.lit(10.0), F.lit(0.0), F.lit(1))) == pytest.approx(0.5 + 0.3 + 0.02)
    assert value(scoring.aged(F.lit(0.8), F.lit(0.5), F.lit(100.0))) == pytest.approx(0.2)
    assert value(scoring.aged(F.lit(0.8), F.lit(0.5), F.lit(-100.0))) == float("inf")
    assert value(scoring.core_entry(F.lit(10.0), F.lit(-10.0), F.lit(1))) == float("inf")
    assert value(scoring.reinforced(F.lit(0.5))) == pytest.approx(0.55)


def test_graph_helpers(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0)], "src string, dst string, weight double")
    page = spark.createDataFrame([("a",), ("b",), ("d",)], "node string")
    assert [tuple(r) for r in graph.page_edges(edges, page).collect()] == [("a", "b", 1.0)]


def test_index_counts_documents_without_tokens(spark):
    docs = spark.createDataFrame([(1, "alpha beta alpha"), (2, None), (3, "a ! b"), (3, "beta")], "doc_id long, text string")
    index = lexical.build_index(docs)
    assert index.n == 4 and index.average == 1.0
    assert sorted(tuple(r) for r in index.frequency.collect()) == [("alpha", 1), ("beta", 2)]
    empty = lexical.build_index(docs.limit(0))
    asked = spark.createDataFrame([(1, "alpha")], "query_id long, text string")
    assert empty.n == 0 and lexical.search(empty, asked).collect() == []


def test_read_once(spark):
    from palimpsest.streaming import marks

    now = F.lit(5)
    rows = spark.createDataFrame([(1, "a", None, None), (2, "a", 3, None), (3, "a", None, 4), (4, "b", None, None), (5, None, None, None), (6, "a", None, 9)], "id long, reader string, read_at int, expires_at int")
    fresh, after = marks.read_once(rows, "a", now)
    assert [r.id for r in fresh.orderBy("id").collect()] == [1, 6]
    assert {r.id: r.read_at for r in after.collect()} == {1: 5, 2: 3, 3: None, 4: None, 5: None, 6: 5}
    assert marks.read_once(after, "a", now)[0].collect() == []


def test_uncovered(spark):
    from palimpsest.streaming import marks

    rows = spark.createDataFrame([("s", 1), ("s", 2), ("t", 1)], "session_id string, id long")
    assert sorted(tuple(r) for r in marks.uncovered(rows, rows.where("id = 2"), "session_id", "id").collect()) == [("s", 1), ("t", 1)]


def test_share_search_equals_scores_of_all_rows(spark):
    rng = random.Random(3)
    said = ["red fox", "red dog runs", "old fox and dog", "nothing", "fox"]
    rows = spark.createDataFrame([(i, rng.choice(said), rng.choice([0.2, 0.5, 0.5000001, 0.9, None]), float(rng.choice([0, 10, 500, -100]))) for i in range(300)], "id int, body string, weight double, days double")
    asked = spark.createDataFrame([("a", "red fox"), ("b", "dog"), ("c", "fox runs old"), ("d", "absent")], "query_id string, text string")
    for days in (None, "days"):
        terms = recall.split_terms(F.col("text"), 2)
        want = recall.share_recall(recall.term_share(asked, terms, rows, F.col("body")), rows, "weight", days, 7)
        got = recall.share_search(asked, terms, rows, F.col("body"), "weight", days, k=7)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert got.count() == 21
