"""Small hand-made cases of operators that SQL doesn't check, and of sources and streams."""
import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import scoring, text
from palimpsest.operators import fusion, graph, lexical, lifecycle, ordered, similarity
from palimpsest.sources import bundles, transcripts
from palimpsest.streaming import ingest


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "x int"
    row = tuple(v for _, v in values.values()) or (0,)
    return spark.createDataFrame([row], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("word,root", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("hopping", "hop"), ("sized", "size"),
                                       ("happy", "happi"), ("relational", "relat"), ("is", "is"), ("testing", "test"), ("falling", "fall"), ("configuration", "configur")])
def test_stem(word, root):
    assert text.stem(word) == root


def test_synonyms_are_symmetric():
    pairs = set(text.synonym_pairs())
    assert {(b, a) for a, b in pairs} == pairs and (text.stem("database"), "db") in pairs


def test_tokens(spark):
    assert one(spark, text.tokens(F.col("t")), t=("string", "foo-bar a_b c]d X")) == ["foo", "bar", "a_b", "c]d"]
    assert one(spark, text.tokens(F.col("t")), t=("string", None)) == []
    assert one(spark, text.cjk_tokens(F.col("t")), t=("string", "abc 東京都 x")) == ["abc", "東京", "京都"]


def test_jaccard(spark):
    def score(a, b):
        return one(spark, text.jaccard(text.word_set(F.col("a")), text.word_set(F.col("b")), F.col("a"), F.col("b")), a=("string", a), b=("string", b))

    assert score("abc def ghi", "abc def xyz") == 0.5 and score("go", "go") == 1 and score("AI", "ML") == 0


def test_scrub(spark):
    dirty = "<private>mine</private> key AKIA" + "A" * 16 + " at http://me:secretword@host/ token=" + "z" * 24
    clean = one(spark, text.scrub(F.col("t")), t=("string", dirty))
    assert "mine" not in clean and "AKIA" not in clean and "secretword" not in clean and "zzzz" not in clean and "@host/" in clean


def test_chunks():
    assert text.chunks(None) == [] and text.chunks("a\n\nb") == ["a\n\nb"]
    parts = text.chunks(" ".join(f"word{i}" for i in range(900)))
    assert all(0 < len(p) <= 1200 for p in parts) and parts[0].startswith("word0 ") and parts[-1].endswith("word899")
    assert text.chunks("one\n\nHEADING\nbody") == ["one", "HEADING\nbody"]
    assert max(map(len, text.chunks("x" * 5000))) <= 1200


def test_formulas(spark):
    assert one(spark, scoring.bm25(F.lit(1.0), F.lit(1), F.lit(1), F.lit(3), F.lit(1.0))) == pytest.approx(0.980829, abs=1e-6)
    now = F.lit("2024-06-29").cast("timestamp")
    assert one(spark, scoring.recency(F.lit("2024-01-01").cast("timestamp"), now)) == pytest.approx(0.8)
    assert one(spark, scoring.recency(F.lit("2025-01-01").cast("timestamp"), now)) == 1.0
    assert one(spark, scoring.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(math.sqrt(0.5))
    assert one(spark, scoring.salience(F.lit("bug"), F.lit(0.0), F.lit(0))) == 0.7
    assert one(spark, scoring.periodic_decay(F.lit(0.8), F.lit(2))) == pytest.approx(0.648)


def test_fusion(spark):
    a = spark.createDataFrame([(1, 7, 9.0)], "query_id int, doc_id int, score double")
    b = spark.createDataFrame([(1, 8, 9.0), (1, 7, 8.0)], "query_id int, doc_id int, score double")
    none = a.limit(0)
    got = {r.doc_id: r.score for r in fusion.reciprocal_rank_fusion({"lexical": (a, 0.4), "vector": (b, 0.6), "graph": (none, 0.3)}).collect()}
    assert got[7] == pytest.approx(0.4 / 61 + 0.6 / 62, abs=1e-9)


def test_diversify(spark):
    rows = [(1, f"A{i}", "a", 10.0 - i) for i in range(1, 6)] + [(1, "B6", "b", 1.0)]
    got = fusion.diversify(spark.createDataFrame(rows, "query_id int, doc_id string, s string, score double"), 5, "s").orderBy("rank").collect()
    assert [r.doc_id for r in got] == ["A1", "A2", "A3", "A4", "B6"]


def test_near_twin_chain(spark):
    rows = [(1, i, 10 - i, ["abc", "def"], float(i)) for i in (1, 2, 3)]
    got = fusion.near_twin_cap(spark.createDataFrame(rows, "query_id int, doc_id int, ts int, words array<string>, score double")).orderBy("doc_id").collect()
    assert [round(r.score, 6) for r in got] == [1.0, 0.99, 0.9801]


def test_lift_shadowing(spark):
    rows = [(1, "a", 1, None), (1, "b", 2, None), (1, "c", 3, "a")]
    got = fusion.lift_shadowing(spark.createDataFrame(rows, "query_id int, doc_id string, rank int, shadows string")).orderBy("rank").collect()
    assert [r.doc_id for r in got] == ["c", "a", "b"]


def test_twins(spark):
    rows = [(1, ["a", "b", "c"]), (2, ["a", "b", "d"]), (3, ["x", "y"]), (4, None), (5, [])]
    got = similarity.twins(spark.createDataFrame(rows, "id int, words array<string>")).collect()
    assert [(r.id_a, r.id_b, r.similarity) for r in got] == [(1, 2, 0.5)]


def test_stemmed_search_finds_synonyms(spark):
    docs = spark.createDataFrame([(1, "the database was migrated"), (2, "nothing here"), (3, None)], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "db")], "query_id int, text string")
    assert [r.doc_id for r in lexical.stemmed_search(docs, asked).collect()] == [1]


def test_packing(spark):
    hits = spark.createDataFrame([(1, 1, "a", 5), (1, 2, "b", 8), (1, 3, "c", 3)], "q int, rank int, item string, tokens int")
    assert [(r.item, r.used) for r in ordered.greedy_pack(hits, "q", "rank", "item", "tokens", 9).collect()] == [("a", 5), ("c", 3)]
    turns = spark.createDataFrame([(1, i, n) for i, n in enumerate([3, 3, 9, 2, 2])] + [(2, 0, 50)], "s int, turn int, tokens int")
    got = ordered.chunk_pack(turns, "s", "turn", "tokens", 8).orderBy("s", "turn").collect()
    assert [r.chunk for r in got] == [0, 0, 1, 2, 2, 0]


def test_dedup_ttl(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("k", at(s), s) for s in (0, 200, 299, 300, 500, 700)] + [("m", at(10), 1)]
    got = ordered.dedup_ttl(spark.createDataFrame(rows, "k string, ts timestamp, i int"), ["k"], "ts", "i").collect()
    assert sorted((r.k, r.i) for r in got) == [("k", 0), ("k", 300), ("k", 700), ("m", 1)]


def test_cheapest_paths(spark):
    edges = spark.createDataFrame([("a", "b", 0.1), ("a", "c", 1.0), ("c", "b", 1.0), ("b", "d", 1.0)], "src string, dst string, weight double")
    start = spark.createDataFrame([("a",)], "node string")
    got = {r.node: (r.cost, r.hops) for r in graph.cheapest_paths(edges, start, 2).collect()}
    assert got["b"] == (2.0, 2) and got["c"] == (1.0, 1) and got["a"] == (0.0, 0)


def test_store_operations(spark):
    rows = spark.createDataFrame([(1, 5, "x"), (2, 6, "y")], "id int, n int, t string")
    patched = lifecycle.patch(rows, F.col("id") == 1, sets={"t": F.lit("z")}, adds={"n": 2}).orderBy("id").collect()
    assert [tuple(r) for r in patched] == [(1, 7, "z"), (2, 6, "y")]
    merged = lifecycle.upsert(rows, spark.createDataFrame([(2, 9, "w"), (3, 1, "v")], rows.schema), "id").orderBy("id").collect()
    assert [r.n for r in merged] == [5, 9, 1]
    assert bundles.import_rows(rows, rows.limit(0), "id", "skip").count() == 2
    with pytest.raises(ValueError):
        bundles.import_rows(rows, rows, "id", "other")


def test_bundle_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a\nb", None), (2, None, 3)], "id long, t string, n long")
    bundles.export_bundle({"m": rows}, f"{tmp_path}/b")
    back = bundles.read_bundle(spark, f"{tmp_path}/b", {"m": "id long, t string, n long"})["m"]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    bundles.snapshot({"m": rows}, f"{tmp_path}/s", 1)
    assert bundles.restore(spark, f"{tmp_path}/s", 1, ["m"])["m"].count() == 2
    pages = bundles.delta_pages(spark.range(1000).withColumn("u", F.lit(1)), F.lit(0), "id", "u", page_bytes=1000)
    assert pages.count() == 1000 and pages.agg(F.max("page")).first()[0] > 5


def test_transcripts(spark, tmp_path):
    lines = [{"type": "user", "sessionId": "s", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": "hi"}}, "broken",
             {"type": "assistant", "sessionId": "s", "message": {"role": "assistant", "content": [{"type": "text", "text": "yes"}, {"type": "tool_use", "id": "c1", "name": "Read", "input": {"path": "a"}}]}},
             {"type": "user", "sessionId": "s", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "c1", "content": "out", "is_error": True}]}}]
    (tmp_path / "t.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    parts = transcripts.read_transcripts(spark, str(tmp_path))
    got = parts.orderBy("at").collect()
    assert [r.kind for r in got] == ["text", "text", "tool_use", "tool_result"] and len({r.ts for r in got}) == 1
    calls = transcripts.calls_with_results(parts).collect()
    assert [(c.tool_name, c.output, c.is_error) for c in calls] == [("Read", "out", True)]


def test_graph_source(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "a", "label": "A"}, {"id": "b", "label": "B"}], "links": [{"source": "a", "target": "b"}, {"source": "a", "target": "zz"}]}))
    nodes, edges, dangling = transcripts.read_graph(spark, str(tmp_path / "g.json"))
    assert (nodes.count(), edges.count(), dangling.count()) == (2, 1, 1)


def events(path, rows):
    path.mkdir(exist_ok=True)
    (path / "e.json").write_text("\n".join(json.dumps(dict(zip(("session_id", "hook_type", "ts", "data"), r))) for r in rows) + "\nnot json\n")
    return str(path)


def test_stream_dedups_and_lands(spark, tmp_path):
    row = ("s", "post_tool_use", "2024-01-01T00:00:00Z", json.dumps({"tool_name": "Edit", "tool_input": {"file_path": "a.py"}}))
    path = events(tmp_path / "in", [row, row, ("s", "prompt_submit", "2024-01-01T00:00:05Z", "{}")])
    rows = ingest.deduplicated(ingest.observations(ingest.hook_stream(spark, path)))
    ingest.land(rows, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("ts").collect()
    assert [(r.type, r.files) for r in got] == [("file_edit", ["a.py"]), ("conversation", [])]


def test_stream_follow_ups_and_buffers(spark, tmp_path):
    path = events(tmp_path / "in", [("s", "h", f"2024-01-01T00:00:{x:02d}Z", "{}") for x in (0, 10, 50)] + [("t", "h", "2024-01-01T00:00:05Z", "{}")])
    stream = ingest.observations(ingest.hook_stream(spark, path))
    for name, rows in (("follow", ingest.follow_ups(stream)), ("buffer", ingest.buffered(stream, most=2))):
        rows.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r.session_id, r.follow_up) for r in spark.table("follow").collect()) == [("s", False), ("s", False), ("s", True), ("t", False)]
    assert ("s", 2) in [(r.session_id, r.n) for r in spark.table("buffer").collect()]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "word")], "query_id int, text string")
    assert lexical.search(docs, asked).count() == 0 and lexical.search(docs, asked, prefix=True).count() == 0
    assert similarity.twins(spark.createDataFrame([], "id int, words array<string>")).count() == 0


def test_vector_search_many_takes_any_queries(spark):
    from palimpsest.operators import vector

    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, [0.0, 1.0, 0.0])], "vec_id long, embedding array<double>")
    asked = [(q, [1.0, 0.1] if q % 2 else [0.1, 1.0, 0.0]) for q in range(2 * vector.MAX_QUERIES + 5)] + [(-1, None)]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    got = vector.vector_search_many(docs, queries, k=1).collect()
    assert sorted((r.query_id, r.doc_id) for r in got) == [(q, 1 if q % 2 else 4) for q, v in asked if v]
    assert vector.vector_search_many(docs, queries.limit(0), k=1).collect() == []
