"""The change feed with replays, slots and sweeps, Markdown files."""
import datetime
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import slots
from palimpsest.sources import markdown
from palimpsest.streaming.changes import ChangeFeed

KINDS = "id string, value int, note string"
T0 = datetime.datetime(2024, 1, 1)


def feed(spark, path, **more):
    return ChangeFeed(spark, path, "id", "at", ["value", "note"], KINDS, gone="gone", **more)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, at int, value int, note string, gone boolean")


def one_by_one(batches):
    """(state, changes) when each batch's last row of a key is set against what was there."""
    state, out = {}, []
    for n, rows in enumerate(batches):
        last = {}
        for k, at, value, note, gone in rows:
            mine = (at, not gone, value if value is not None else -1, note or "")
            if k is not None and (k not in last or mine > last[k][0]):
                last[k] = (mine, None if gone else (value, note))
        for k, (_, new) in last.items():
            old = state.get(k)
            if old != new:
                out.append((n, k, "insert" if old is None else "delete" if new is None else "update", old, new))
            state.pop(k, None)
            if new is not None:
                state[k] = new
    return state, sorted(out, key=repr)


def made(seed, n=14):
    rng = random.Random(seed)
    return [[(rng.choice(["a", "b", "c", "d", "e", None]), 10 * i + j, rng.choice([1, 2, None]), rng.choice(["x", None]), rng.random() < 0.2) for j in range(rng.randint(0, 6))] for i in range(n)]


def found(f):
    plain = lambda r: tuple(r) if r is not None else None
    state = {r.id: plain(r.now) for r in f.state().collect()}
    return state, sorted(((r.batch, r.id, r.op, plain(r.old), plain(r.new)) for r in f.changes().collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_feed_with_replayed_batches(spark, tmp_path, seed):
    batches, f, seen = made(seed), feed(spark, str(tmp_path / "feed"), every=3), []
    f.on((F.col("op") == "update") & (F.col("new.value") > F.col("old.value")), lambda rows, n: seen.append((n, sorted(r.id for r in rows.collect()))))
    want = one_by_one(batches)
    for n, rows in enumerate(batches):
        f.apply(frame(spark, rows), n)
        if n % 4 == 2:
            f.apply(frame(spark, rows), n)  # delivered again
    assert found(f) == want
    grown = {}
    for n, k, op, old, new in want[1]:
        if op == "update" and None not in (old[0], new[0]) and new[0] > old[0]:
            grown.setdefault(n, []).append(k)
    assert {n: ids for n, ids in seen} == {n: sorted(ids) for n, ids in grown.items()}
    assert f._batches("base") and f.changes(after=12).where("batch <= 12").count() == 0
    assert found(feed(spark, str(tmp_path / "feed"))) == want  # another driver goes on from the files


def test_feed_of_a_stream(spark, tmp_path):
    batches = [b for b in made(3, 5) if b]
    source = tmp_path / "in"
    source.mkdir()
    f = feed(spark, str(tmp_path / "feed"))
    schema = "id string, at int, value int, note string, gone boolean"
    for rows in batches:
        frame(spark, rows).coalesce(1).write.mode("append").json(str(source))
        stream = spark.readStream.schema(schema).json(str(source)).writeStream.foreachBatch(f.apply).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start()
        stream.awaitTermination()
    assert found(f) == one_by_one(batches)


def test_a_feed_without_batches(spark, tmp_path):
    f = feed(spark, str(tmp_path / "feed"))
    assert f.state().count() == f.changes().count() == 0
    f.apply(frame(spark, []), 0)
    assert f.state().count() == f.changes().count() == 0


def cut(text, limit, head):
    if len(text) <= limit:
        return text
    if head:
        if text[limit] == "\n":
            return text[:limit]
        at = text.rfind("\n", 0, limit + 1)
        return text[:at] if at > 0 else text[:limit]
    start = len(text) - limit
    if text[start - 1] == "\n":
        return text[start:]
    at = text.find("\n", start)
    return text[at + 1:] if 0 <= at < len(text) - 1 else text[start:]


def test_lines_are_cut_whole(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choices("abé\n", [4, 4, 1, 3], k=rng.randint(0, 14))), rng.randint(1, 9)) for _ in range(300)] + [(None, 3)]
    df = spark.createDataFrame(rows, "t string, n int")
    for r in df.select("t", "n", slots.head_lines(F.col("t"), F.col("n")).alias("h"), slots.tail_lines(F.col("t"), F.col("n")).alias("e")).collect():
        assert (r.h, r.e) == ((cut(r.t, r.n, True), cut(r.t, r.n, False)) if r.t is not None else (None, None)), (r.t, r.n)


def test_slots(spark):
    rows = [("global", None, "a", "shared a", True), ("global", None, "b", " shared b ", True), ("global", None, "c", "not pinned", False), ("project", "p", "b", "own b", True), ("project", "q", "d", " \n", True), ("project", "r", "e", "hidden", True)]
    df = spark.createDataFrame(rows, "scope string, project string, label string, content string, pinned boolean")
    seen = slots.visible(df, spark.createDataFrame([("p",), ("q",)], "project string"))
    assert sorted((r.project, r.label, r.content) for r in seen.collect()) == [("p", "a", "shared a"), ("p", "b", "own b"), ("p", "c", "not pinned"), ("q", "a", "shared a"), ("q", "b", " shared b "), ("q", "c", "not pinned"), ("q", "d", " \n")]
    assert {r.project: r.content for r in slots.pinned_text(seen).collect()} == {"p": "# pinned slots\n\n## a\nshared a\n\n## b\nown b\n", "q": "# pinned slots\n\n## a\nshared a\n\n## b\nshared b\n"}
    edits = spark.createDataFrame([("one\ntwo", "three"), (None, "x"), ("", "y")], "c string, m string")
    assert [r.v for r in edits.select(slots.appended(F.col("c"), F.col("m"), 9).alias("v")).collect()] == ["two\nthree", "x", "y"]


def test_sweeps(spark):
    now = T0 + datetime.timedelta(hours=25)
    rows = [("old", T0, None), ("new", now, None), ("none", None, None), ("ends", now, now), ("later", T0, now + datetime.timedelta(seconds=1))]
    df = spark.createDataFrame(rows, "id string, at timestamp, ends timestamp")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(slots.expired(df, "at", F.lit(now), 86400)) == ["later", "old"]
    assert ids(slots.expired(df, "at", F.lit(now), 86400, "ends")) == ["ends", "old"]
    assert ids(slots.expired(df, "at", F.lit(now), 0)) == []


def lines_of(memories, summary, budget):
    out = [markdown.HEADER, ""] + (["## Project Summary", *summary.split("\n"), ""] if summary else []) + ["## Key Memories", ""]
    for m in sorted(memories, key=lambda m: (-m[4], m[0])):
        if len(out) >= budget - 2:
            break
        out.append("### " + m[2])
        for x in m[3].split("\n"):
            if len(out) >= budget - 1:
                break
            out.append(x)
        out.append("")
    return "\n".join(out[:budget])


@pytest.mark.parametrize("budget", [3, 12, 40, 500])
def test_memory_files(spark, tmp_path, budget):
    rng = random.Random(6)
    memories = [(i, rng.choice("pq"), f"title {i}", "\n".join(f"line {i} {j}" for j in range(rng.randint(1, 9))), rng.choice([1.0, 2.0, 3.0])) for i in range(25)]
    summaries = [("p", "about p\nmore"), ("q", None), ("r", "no memories")]
    df = spark.createDataFrame(memories, "id int, project string, title string, content string, strength double")
    files = markdown.memory_files(df, spark.createDataFrame(summaries, "project string, summary string"), budget)
    got = {r.project: r.body for r in files.collect()}
    assert got == {p: lines_of([m for m in memories if m[1] == p], s, budget) for p, s in summaries}
    if budget == 500:  # whole: it can be read back
        for p, body in got.items():
            (tmp_path / f"{p}.md").write_text(body)
        back = markdown.read_memory_files(spark, str(tmp_path))
        assert {(r.project, r.title, r.content) for r in markdown.file_memories(back).collect()} == {(m[1], m[2], m[3]) for m in memories}
        assert {r.project: r.content for r in markdown.file_sections(back).where("section = 'Project Summary'").collect()} == {"p": "about p\nmore", "r": "no memories"}
        changed = df.where("id <> 3").withColumn("content", F.when(F.col("id") == 4, F.lit("else")).otherwise(F.col("content")))
        todo = markdown.to_sync(changed, back, markdown.file_memories(back))
        assert sorted((r.action, r.title) for r in todo.collect()) == [("add", "title 3"), ("change", "title 4")]


def test_sections_of_odd_files(spark):
    df = spark.createDataFrame([("a", "## x\n1\n## x\n2\n##no\n ##  no"), ("b", None), ("c", ""), ("d", "top\n## \nlost\n## y")], "project string, body string")
    assert sorted(tuple(r) for r in markdown.file_sections(df).collect()) == [("a", "x", "2\n##no\n ##  no"), ("d", "y", "")]
