"""Functions without a query of their own, on hand-made rows, and contexts of prompts."""
import datetime
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import context, graph, scope, vector
from palimpsest.sources import bundles
from palimpsest.streaming import ingest

T0 = datetime.datetime(2024, 1, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_file_nodes_merge(spark):
    nodes = spark.createDataFrame([("n1", "file", "/w/app/src/a.ts", T0), ("n2", "file", "src/a.ts", T0 + datetime.timedelta(days=1)), ("n3", "file", "./b.ts", T0), ("n4", "file", "/w/app/b.ts", T0 - datetime.timedelta(days=1)),
                                   ("n5", "concept", "src/a.ts", T0)], "node string, type string, name string, created_at timestamp")
    edges = spark.createDataFrame([("n1", "n5", "uses", 0.5), ("n2", "n5", "uses", 0.9), ("n1", "n2", "same", 1.0), ("n3", "n1", "near", 0.1)], "src string, dst string, type string, weight double")
    roots = spark.createDataFrame([("/w",), ("/w/app/",)], "root string")
    kept, moved = graph.merged_file_nodes(nodes, edges, roots)
    # src/a.ts has its canonical name and stays; of the two b.ts none has, so the oldest does
    assert rows(kept.select("node", "name")) == [("n2", "src/a.ts"), ("n4", "b.ts"), ("n5", "src/a.ts")]
    assert rows(moved.select("src", "dst", "type", "weight")) == [("n2", "n5", "uses", 0.9), ("n4", "n2", "near", 0.1)]
    kept, _ = graph.merged_file_nodes(nodes.drop("created_at"), edges, roots)
    assert rows(kept.select("node")) == [("n2",), ("n3",), ("n5",)]


def test_expansion_of_hits(spark):
    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.9)], "src string, dst string, weight double")
    sources = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 4)], "node string, id long")
    hits = spark.createDataFrame([(7, 1), (8, 9)], "query_id long, id long")
    assert rows(graph.expand_hits(edges, hits, sources, 1)) == [(7, 2, round(0.5 / 3, 9)), (7, 3, round(0.5 / 3, 9))]
    assert rows(graph.expand_hits(edges, hits, sources, 2)) == [(7, 2, round(0.5 / 3, 9)), (7, 3, round(0.5 / 3, 9)), (7, 4, 0.125)]


def test_keyword_nodes_and_stale_marks(spark):
    nodes = spark.createDataFrame([("a", "Auth flow", {}), ("b", "x", {"k": "uses AUTH"}), ("c", "y", None)], "node string, name string, properties map<string, string>")
    edges = spark.createDataFrame([("a", "c"), ("c", "b"), ("c", "c")], "src string, dst string")
    hits, at = graph.keyword_nodes(nodes, edges, "auth")
    assert [r.node for r in hits.orderBy("node").collect()] == ["a", "b"] and rows(at) == [("a", "c"), ("c", "b")]
    sources = spark.createDataFrame([("a", "s1"), ("b", "s2"), ("a", "s2")], "node string, source string")
    gone = spark.createDataFrame([("s1",), ("s1",)], "source string")
    assert rows(graph.stale_by_source(nodes.select("node"), sources, gone)) == [("a", True), ("b", False), ("c", False)]


def test_chunk_families_scrubbing_and_normal_forms(spark):
    old = spark.createDataFrame([("p", 0), ("p", 1), ("q", 0)], "parent_id string, chunk int")
    assert rows(vector.replace_family(old, spark.createDataFrame([("p", 9)], "parent_id string, chunk int"))) == [("p", 9), ("q", 0)]
    df = spark.createDataFrame([("key sk-proj-abcdefghijklmnopqrstuvwxyz0123", "e\u0301", None)], "a string, b string, c string")
    got = scope.scrubbed(df, "a", "c").select("a", "c", text.nfc(F.col("b")).alias("b")).first()
    assert "abcdefghij" not in got.a and got.c is None and got.b == "é"


def test_markdown_export(spark, tmp_path):
    df = spark.createDataFrame([("k1", "Title", "Body", 3)], "key string, title string, body string, n int")
    bundles.export_markdown(df, str(tmp_path / "out"), "key", "title", "body", ["n"])
    files = list((tmp_path / "out").glob("key=k1/*.txt"))
    assert len(files) == 1 and files[0].read_text() == "---\nn: 3\n---\n# Title\n\nBody\n"


def test_session_windows_of_a_stream(spark, tmp_path):
    events = spark.createDataFrame([("s", T0), ("s", T0 + datetime.timedelta(hours=5)), ("s", T0 + datetime.timedelta(hours=12)), ("t", T0 + datetime.timedelta(days=3))], "session_id string, ts timestamp")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.session_windows(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("closed_sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert rows(spark.table("closed_sessions").select("session_id", "first_at", "n")) == [("s", T0, 2), ("s", T0 + datetime.timedelta(hours=12), 1)]


def test_entities_of_questions(spark):
    asked = [("Where did Postgres fail after May with \"slow query\" and 'Not This'?", ["slow query", "Postgres", "Not", "This"]), ("what about Go", ["Go"]), (None, []), ("About Between X1.y", ["X1.y"])]
    df = spark.createDataFrame(asked, "q string, want array<string>")
    for r in df.select("q", "want", text.query_entities(F.col("q")).alias("got")).collect():
        assert r.got == [w for w in r.want if w not in ("Not", "This")], r.q


def plain_prompt(prompt, hits, summaries, seen, most):
    if sum(any(c.isalnum() for c in w) for w in (prompt["text"] or "").split()) < 3:
        return None
    mine = sorted((h for h in hits if h["prompt_id"] == prompt["prompt_id"] and h["session_id"] != prompt["session_id"]), key=lambda h: (-h["score"], h["id"]))
    if not mine:
        return None
    given = {r for s, r in seen if s == prompt["session_id"]}
    floor = max(5, 0.5 * mine[0]["score"])
    units, used = [], set()
    for h in mine:
        if h["score"] < floor or not h["narrative"] or f"summary:{h['session_id']}" in given or f"{h['kind']}:{h['id']}" in given:
            continue
        s = summaries.get(h["session_id"])
        covered = bool(h["kind"] == "observation" and s and s["decisions"] and s["covered_through"] and h["ts"] <= s["covered_through"])
        key = f"s:{h['session_id']}" if covered else f"r:{h['kind']}:{h['id']}"
        if key not in used:
            used.add(key)
            units.append((key, h, s if covered else None))
    units = units[:most]
    if not units:
        return None
    oldest = min((s["decided_at"] for _, _, s in units if s), default=None)
    dated = [(s["decided_at"] if s else h["ts"], key, h, s) for key, h, s in units if s or oldest and h["kind"] == "memory" and h["ts"] > oldest]
    rest = [(key, h) for key, h, s in units if not s and not (oldest and h["kind"] == "memory" and h["ts"] > oldest)]
    lines, ids, opened = [], [], False
    for _, key, h, s in sorted(dated, key=lambda d: (-d[0].timestamp(), d[1])):
        if not s:
            lines.append(h["narrative"][:400])
            ids.append(key[2:])
            continue
        if not opened:
            lines.append(context.SETTLED)
            opened = True
        lines += [f'Session "{s["title"]}" ({s["decided_at"]:%Y-%m-%d}):', *[f"- {d}" for d in s["decisions"][:10]]]
        ids.append(f"summary:{h['session_id']}")
    for key, h in rest:
        lines.append(h["narrative"][:400])
        ids.append(key[2:])
    return "\n".join(["<memory-relevant-context>", *lines, "</memory-relevant-context>"]), len(units), ids


@pytest.mark.parametrize("seed, most", [(1, 3), (2, 5), (3, 1)])
def test_prompt_context(spark, seed, most):
    rng = random.Random(seed)
    day = lambda: T0 + datetime.timedelta(days=rng.randint(0, 60), seconds=rng.randint(0, 9999))
    prompts = [{"prompt_id": i, "session_id": f"s{i % 4}", "text": rng.choice(["fix the login bug", "go on", "? ! a b", "please add a test"])} for i in range(12)]
    summaries = {f"s{i}": {"title": f"title {i}", "decisions": [f"rule {i}.{j}" for j in range(rng.choice([0, 2, 12]))], "covered_through": rng.choice([None, day(), day()]), "decided_at": day()} for i in range(6)}
    hits = [{"prompt_id": p["prompt_id"], "id": f"h{p['prompt_id']}-{j}", "session_id": f"s{rng.randint(0, 7)}", "kind": rng.choice(["memory", "observation", "observation"]), "ts": day(),
             "narrative": rng.choice(["x" * 500, f"said {j}", "", None]), "score": float(rng.choice([2, 4, 6, 8, 9, 12]))} for p in prompts for j in range(8)]
    seen = [(f"s{rng.randint(0, 3)}", rng.choice([f"summary:s{rng.randint(0, 6)}", f"{h['kind']}:{h['id']}"])) for h in rng.sample(hits, 20)]
    got = context.prompt_context(
        spark.createDataFrame(prompts, "prompt_id int, session_id string, text string"), spark.createDataFrame(hits, "prompt_id int, id string, session_id string, kind string, ts timestamp, narrative string, score double"),
        spark.createDataFrame([{"session_id": k, **v} for k, v in summaries.items()], "session_id string, title string, decisions array<string>, covered_through timestamp, decided_at timestamp"),
        spark.createDataFrame(seen, "session_id string, ref string"), most)
    found = {r.prompt_id: (r.context, r.n_units, r.ids) for r in got.collect()}
    want = {p["prompt_id"]: plain_prompt(p, hits, summaries, seen, most) for p in prompts}
    assert found == {k: v for k, v in want.items() if v} and found


def test_terms_with_punctuation_inside(spark):
    from palimpsest.operators import recall

    asked = spark.createDataFrame([(1, ["v1.2", "see"]), (2, ["a\\Eb"]), (3, ["1.2"])], "query_id int, terms array<string>")
    texts = spark.createDataFrame([(1, "See v1.2 now"), (2, "v1x2 seen"), (3, "a\\e b")], "id int, t string")
    got = recall.term_share(asked, F.col("terms"), texts, F.col("t"), starts=True)
    assert rows(got.select("query_id", "id", "matched")) == [(1, 1, 2), (1, 2, 1)]
