"""Write paths for batches of arrivals that may replace or confirm each other.

Arrivals are decided in their order, each on what those before it left, so that a batch
gives what saving its rows one by one gives.  Only rows that share a wording or are alike
can meet: links between wordings are contracted to components, and each component is folded
in order as a stream, of which a task holds the live records only.  A repeated wording is one node
of the links however often it arrives.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from palimpsest.functions import text
from palimpsest.operators import graph, similarity
from palimpsest.sources.shared import freed, written

KINDS = ("pattern", "preference", "architecture", "bug", "workflow", "fact", "rule")


BLANKS = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def trimmed(value: Column) -> Column:
    """Without the white space of Unicode at both ends."""
    return F.btrim(value, F.lit(BLANKS))


def wording(content: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the trimmed, lower-cased text."""
    return F.substring(F.sha2(F.lower(trimmed(content)), 256), 1, 16)


def alike(words: set, content: str, other_words: set, other: str) -> float:
    """Shared share of two word sets; where one is empty, 1 for texts that agree up to white space, else 0."""
    if not words or not other_words:
        return 1.0 if content.split() == other.split() else 0.0
    shared = len(words & other_words)
    return shared / (len(words) + len(other_words) - shared)


def numbered(rows: DataFrame) -> DataFrame:
    """Rows (content, project, global) written with a number ``_row``, their wording, and hashes of what makes a node and of the word set."""
    rows = rows.withColumns({"wording": wording(F.col("content")), "_words": F.sort_array(text.word_set(F.col("content"))), "_row": F.monotonically_increasing_id()})
    return written(rows.withColumns({"_key": F.xxhash64("wording", "project", "global"), "_set": F.when(F.size("_words") > 0, F.xxhash64("_words"))}).drop("_words"), "rows")


def grouped_by_likeness(rows: DataFrame, least: float) -> DataFrame:
    """(_row, component, alone): numbered rows (wording, former, project, global, content) that can meet have the same component; ``alone``: no other has it.

    Nodes are distinct wordings in a project.  Edges join equal wordings (``former`` is another one that a row answers to),
    equal word sets, and word sets whose likeness is ``least`` at least, of one project or where one has none.
    Only keys of rows are exchanged here.
    """
    nodes = rows.groupBy("_key").agg(F.min("_row").alias("_node"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("wording", "project", "global", "_set")], F.collect_set("former").alias("formers"))
    nodes = freed(written(nodes, "wordings"))
    said = nodes.select("_node", F.explode(F.array_distinct(F.concat(F.array("wording"), "formers"))).alias("said"))
    firsts = said.groupBy("said").agg(F.min("_node").alias("dst"))
    same = said.join(firsts, "said").select(F.col("_node").alias("src"), "dst")
    sets = nodes.where("_set IS NOT NULL")
    # one node stands for a set within a project
    heads = written(sets.groupBy("_set", "project", "global").agg(F.min("_node").alias("head")), "heads")
    mine = sets.join(heads, (sets["_set"] == heads["_set"]) & sets["project"].eqNullSafe(heads["project"]) & (sets["global"] == heads["global"])).select(F.col("_node").alias("src"), F.col("head").alias("dst"))
    met = rows.select(F.col("_row").alias("id"), F.col("global").alias("group"), "project", "content")
    near = similarity.ties(met, least, "project", heads.select(F.col("head").alias("id")), text.word_set(F.col("content")))
    parts = written(graph.connected(reduce(DataFrame.unionByName, [same, mine, near]).where("src <> dst")), "parts")
    placed = nodes.select("_key", "_node", "n").join(parts, F.col("_node") == F.col("node"), "left")
    placed = placed.select("_key", F.coalesce("component", "_node").alias("component"), (F.col("component").isNull() & (F.col("n") == 1)).alias("alone"))
    return freed(written(rows.select("_row", "_key").join(placed, "_key").select("_row", "component", "alone"), "components"))


def numbers(kind: pa.DataType) -> pa.DataType:
    """The type with integers for times, also inside a struct."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, numbers(f.type)) for f in kind])
    return pa.int64() if pa.types.is_timestamp(kind) else kind


def folded(rows: DataFrame, order: list[str], columns: list[str], decider: Callable[[], object], schema: str, late: dict[str, Column] | None = None) -> DataFrame:
    """Rows that ``decider()`` objects give for each component: ``take(row)`` for its rows in order, then ``end()``.

    Times are numbers of microseconds for the decider, which only passes them on.  Columns of ``late`` are made after the rows are dealt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream() -> Iterator[dict]:
            for batch in batches:
                names = batch.schema.names
                for at in range(0, batch.num_rows, 500):
                    values = [c.cast(numbers(c.type)).to_pylist() for c in batch.slice(at, 500).columns]
                    for row in zip(*values):
                        yield dict(zip(names, row))

        def out() -> Iterator[tuple]:
            for _, group in groupby(stream(), key=lambda r: r["component"]):
                decide = decider()
                for row in group:
                    yield from decide.take(row)
                yield from decide.end()

        held = []
        for row in out():
            held.append(row)
            if len(held) >= 1000:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    def packed(held: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in held], numbers(f.type)).cast(f.type) for f in kinds], schema=kinds)

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    dealt = rows.select("component", *columns).repartition("component").sortWithinPartitions("component", *order)
    return written(dealt.withColumns(late or {}).mapInArrow(run, schema), "decided")


def folded_in_lots(rows: DataFrame, components: DataFrame, order: list[str], columns: list[str], decider: Callable[[], object], schema: str, late: dict[str, Column]) -> DataFrame:
    """``folded`` for the numbered rows of ``components`` (_row, component), lot by lot."""
    done, k = [], similarity.lots(components.count())
    for lot in range(k):
        some = components.where(F.pmod(F.xxhash64("component"), F.lit(k)) == lot).select(F.col("_row").alias("id"), "component")
        mine = similarity.picked(rows.select(F.struct(*columns).alias("_r"), F.col("_row").alias("id")), some).join(some, "id").select("component", "_r.*")
        done.append(freed(folded(mine, order, columns, decider, schema, late)))
    return reduce(DataFrame.unionByName, done)


# ---------------------------------------------------------------- memories

MEMORY = "id string, content string, type string, project string, global boolean, strength int, version int, parent_id string, is_latest boolean, created_at timestamp, updated_at timestamp"


class Remembering:
    """Decides arrivals against the live memories of a component."""

    def __init__(self, above: float):
        self.above, self.live, self.changed = above, {}, set()

    def take(self, row: dict) -> Iterator[dict]:
        row["words"], row["dates"] = set(row["words"]), set(row["dates"])
        if row["stored"]:
            self.live[row["id"]] = row
            return
        fits = [m for m in self.live.values() if m["global"] == row["global"] and (m["project"] is None or row["project"] is None or m["project"] == row["project"])]
        same = min((m for m in fits if m["project"] == row["project"] and m["wording"] == row["wording"]), key=lambda m: m["id"], default=None)
        if same:
            same["strength"] = min(10, same["strength"] + 1)
            same["type"] = row["type"] if row["type"] in KINDS else same["type"]
            same["updated_at"] = row["at"]
            self.changed.add(same["id"])
            yield {"arrival": row["id"], "action": "reinforce", "target": same["id"]}
            return
        near = [(-alike(row["words"], row["content"], m["words"], m["content"]), m["id"], m) for m in fits if not (row["dates"] and m["dates"] and row["dates"].isdisjoint(m["dates"]))]
        best = min((n for n in near if -n[0] > self.above), default=None, key=lambda n: n[:2])
        new = row | {"strength": 7, "version": 1, "parent_id": None, "is_latest": True, "created_at": row["at"], "updated_at": row["at"], "type": row["type"] if row["type"] in KINDS else "fact"}
        if best:
            old = self.live.pop(best[1])
            new |= {"version": (old["version"] or 1) + 1, "parent_id": old["id"]}
            yield self.written(old | {"is_latest": False})
        self.live[new["id"]] = new
        self.changed.add(new["id"])
        yield {"arrival": row["id"], "action": "supersede" if best else "insert", "target": best[1] if best else None}

    def written(self, m: dict) -> dict:
        names = ("_row", "type", "strength", "version", "parent_id", "is_latest", "created_at", "updated_at")
        return {"memory": {k: m[k] for k in names}}

    def end(self) -> Iterator[dict]:
        for m in self.live.values():
            if m["id"] in self.changed:
                yield self.written(m)


def remember(memories: DataFrame, arrivals: DataFrame, above: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """The memories after a batch of arrivals in order of (at, id), and (arrival, action, target) of each arrival.

    ``memories`` has the columns of ``MEMORY``, ``arrivals`` id, content, type, project, global, at.  Contents are
    scrubbed first.  Of the latest memories whose project is the arrival's or none (or any,
    if the arrival has none) and that are global if it is:

    * one of the same project and wording is reinforced;
    * else the most alike above 0.7 is superseded, unless both name dates and share none; the smallest id on a tie;
    * else the arrival is inserted.

    Blank contents, contents with tool markup, and arrivals that have a project and are global are rejected.
    """
    clean = lambda c: text.nfc(text.scrub(F.col(c)))
    asked = arrivals.select("id", clean("content").alias("content"), "type", F.nullif(trimmed(F.col("project")), F.lit("")).alias("project"),
                            F.coalesce("global", F.lit(False)).alias("global"), F.col("at").cast("timestamp").alias("at"))
    reason = (F.when(F.coalesce(trimmed(F.col("content")), F.lit("")) == "", "reject: content is required")
              .when(text.has_leaked_arguments(F.col("content")), "reject: content has tool markup").when(F.col("global") & F.col("project").isNotNull(), "reject: project and global"))
    asked = asked.withColumn("reason", reason)
    stored = memories.where("is_latest").select(
        F.lit(True).alias("stored"), "id", "content", "type", "project", F.coalesce("global", F.lit(False)).alias("global"), F.lit(None).cast("timestamp").alias("at"),
        F.col("strength").cast("int").alias("strength"), F.col("version").cast("int").alias("version"), "parent_id", "is_latest", "created_at", "updated_at")
    every = numbered(stored.unionByName(asked.withColumn("stored", F.lit(False)), allowMissingColumns=True).withColumn("former", F.lit(None).cast("string")))
    rows = every.where("reason IS NULL").withColumn("_late", ~F.col("stored"))
    components = grouped_by_likeness(rows, above)
    columns = ["_row", "stored", "id", "content", "type", "project", "global", "at", "strength", "version", "parent_id", "is_latest", "created_at", "updated_at", "wording", "_late"]
    words = text.word_set(F.col("content"))
    late = {"words": words, "dates": text.iso_dates(F.col("content")), "content": F.when(F.size(words) == 0, F.col("content"))}  # the decider compares contents without words only
    state = "_row long, type string, strength int, version int, parent_id string, is_latest boolean, created_at timestamp, updated_at timestamp"
    done = folded_in_lots(rows, components.where("NOT alone"), ["_late", "at", "id"], columns, lambda: Remembering(above), f"arrival string, action string, target string, memory struct<{state}>", late)
    same = rows.select("_row", "id", "content", "project", "global")
    met = same.join(done.where("memory IS NOT NULL").select("memory.*"), "_row")
    alone = rows.where("NOT stored").join(components.where("alone").select("_row"), "_row")
    kind = F.when(F.col("type").isin(*KINDS), F.col("type")).otherwise("fact")
    new = alone.select("_row", "id", "content", "project", "global", kind.alias("type"), F.lit(7).alias("strength"), F.lit(1).alias("version"), F.lit(None).cast("string").alias("parent_id"),
                       F.lit(True).alias("is_latest"), F.col("at").alias("created_at"), F.col("at").alias("updated_at"))
    changed = met.unionByName(new).drop("_row")
    more = [c for c in memories.columns if c not in changed.columns]
    changed = changed.join(memories.select("id", *more), "id", "left") if more else changed
    after = memories.join(changed.select("id"), "id", "left_anti").unionByName(changed.select(*[F.col(c).cast(t).alias(c) for c, t in memories.dtypes]))
    none = F.lit(None).cast("string").alias("target")
    actions = done.where("arrival IS NOT NULL").select("arrival", "action", "target").unionByName(alone.select(F.col("id").alias("arrival"), F.lit("insert").alias("action"), none)).unionByName(
        every.where("reason IS NOT NULL").select(F.col("id").alias("arrival"), F.col("reason").alias("action"), none))
    return after, actions


# ---------------------------------------------------------------- lessons

LESSON = ("id string, content string, context string, confidence double, reinforcements int, project string, tags array<string>, deleted boolean, "
          "created_at timestamp, last_reinforced_at timestamp, updated_at timestamp")


class Saving:
    """Decides arriving lessons against the live lessons of a component."""

    def __init__(self, least: float):
        self.least, self.live, self.changed = least, {}, set()

    def take(self, row: dict) -> Iterator[dict]:
        row["words"] = set(row["words"])
        if row["stored"]:
            self.live[row["id"]] = row
            return
        held = self.live.get(row["wording"])
        if held is None:
            near = ((-alike(row["words"], row["content"], m["words"], m["content"]), m["id"]) for m in self.live.values() if m["project"] is None or m["project"] == row["project"])
            best = min((n for n in near if -n[0] >= self.least), default=None)
            held = self.live[best[1]] if best else None
        if held is None:
            given = row["confidence"]
            self.live[row["wording"]] = row | {"id": row["wording"], "context": (row["context"] or "").strip(), "confidence": given if given is not None and 0 <= given <= 1 else 0.5,
                                               "reinforcements": 0, "tags": row["tags"] or [], "deleted": False, "created_at": row["at"], "last_reinforced_at": None, "updated_at": row["at"]}
            self.changed.add(row["wording"])
            yield {"arrival": row["id"], "action": "created", "target": row["wording"]}
            return
        restated = held["content"] != row["content"]
        held |= {"confidence": min(1.0, held["confidence"] + 0.1 * (1 - held["confidence"])), "reinforcements": held["reinforcements"] + 1, "last_reinforced_at": row["at"], "updated_at": row["at"]}
        said = row["context"] or ""
        if restated:
            held |= {"content": row["content"], "words": row["words"], "context": said.strip() or held["context"], "tags": list(dict.fromkeys([*(held["tags"] or []), *(row["tags"] or [])]))}
        elif said and not held["context"]:
            held["context"] = said
        self.changed.add(held["id"])
        yield {"arrival": row["id"], "action": "restated" if restated else "strengthened", "target": held["id"]}

    def end(self) -> Iterator[dict]:
        names = [f.split()[0] for f in LESSON.split(", ")]
        for m in self.live.values():
            if m["id"] in self.changed:
                yield {"lesson": {k: m[k] for k in names}}


def lesson_save(lessons: DataFrame, arrivals: DataFrame, known_projects: DataFrame | None = None, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """The lessons after a batch of arrivals in order of (at, id), and (arrival, action, target) of each arrival.

    ``lessons`` has the columns of ``LESSON``, ``arrivals`` id, content, context, confidence, project, tags, at.  A
    lesson keeps the id of its first wording.  An arrival with that wording, whatever became of the text since,
    confirms it; else it confirms the live lesson of its project or of none that is most alike, from 0.5 on (the smallest id on
    a tie), which takes over the new wording; else it is a new lesson, in the place of a deleted one with its id.
    With ``known_projects`` (project), arrivals of other projects that no live lesson has are rejected.
    """
    clean = lambda c: text.nfc(text.scrub(F.col(c)))
    asked = arrivals.select("id", trimmed(clean("content")).alias("content"), clean("context").alias("context"), F.col("confidence").cast("double").alias("confidence"), "project", "tags",
                            F.col("at").cast("timestamp").alias("at"))
    reason = F.when(F.coalesce("content", F.lit("")) == "", "reject: content is required")
    if known_projects is not None:
        known = known_projects.select("project").unionByName(lessons.where("NOT coalesce(deleted, false)").select("project")).where("project IS NOT NULL").distinct()
        asked = asked.join(known.select(F.col("project").alias("_known")), F.col("project") == F.col("_known"), "left")
        reason = reason.when(F.col("project").isNotNull() & F.col("_known").isNull(), "reject: unknown project")
        asked = asked.withColumn("reason", reason).drop("_known")
    else:
        asked = asked.withColumn("reason", reason)
    asked = written(asked, "arrivals")
    stored = lessons.where("NOT coalesce(deleted, false)").select(
        F.lit(True).alias("stored"), "id", "content", "context", "confidence", "project", "tags", F.lit(None).cast("timestamp").alias("at"), "reinforcements", F.lit(False).alias("deleted"),
        "created_at", "last_reinforced_at", "updated_at", F.col("id").alias("former"))
    new = asked.where("reason IS NULL").select(F.lit(False).alias("stored"), "id", "content", "context", "confidence", "project", "tags", "at")
    rows = numbered(stored.unionByName(new, allowMissingColumns=True).withColumn("global", F.lit(False))).withColumn("_late", ~F.col("stored"))
    columns = ["stored", "id", "content", "context", "confidence", "project", "tags", "at", "reinforcements", "deleted", "created_at", "last_reinforced_at", "updated_at", "wording", "_late"]
    done = folded_in_lots(rows, grouped_by_likeness(rows, least), ["_late", "at", "id"], columns, lambda: Saving(least), f"arrival string, action string, target string, lesson struct<{LESSON}>",
                          {"words": text.word_set(F.col("content"))})
    changed = done.where("lesson IS NOT NULL").select("lesson.*")
    more = [c for c in lessons.columns if c not in changed.columns]
    changed = changed.join(lessons.select("id", *more), "id", "left") if more else changed
    after = lessons.join(changed.select("id"), "id", "left_anti").unionByName(changed.select(*[F.col(c).cast(t).alias(c) for c, t in lessons.dtypes]))
    actions = done.where("arrival IS NOT NULL").select("arrival", "action", "target").unionByName(
        asked.where("reason IS NOT NULL").select(F.col("id").alias("arrival"), F.col("reason").alias("action"), F.lit(None).cast("string").alias("target")))
    return after, actions


# ---------------------------------------------------------------- versions


def evolve(memories: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The memories after changes, (source_id, target_id, type, confidence) of their relations, and (id, error) of changes of unknown memories.

    ``changes``: id (of the new version), memory_id, content, title (null: as before), at.  A change makes a version of
    its memory, which is no longer the latest; it may name a version that another change of the batch makes, so changes
    are applied in rounds, as many as versions build on each other.  Two changes of one memory both make the next version of it.
    """
    clean = changes.select("id", "memory_id", text.scrub(F.col("content")).alias("_content"), text.scrub(F.col("title")).alias("_title"), F.col("at").alias("_at"))
    todo, now = written(clean, "changes"), written(memories, "memories")
    found, kinds = [], dict(memories.dtypes)
    while True:
        ready = todo.join(now.withColumnRenamed("id", "_old"), F.col("memory_id") == F.col("_old"))
        made = {"id": F.col("id"), "content": F.col("_content"), "title": F.coalesce(F.nullif("_title", F.lit("")), "title"), "version": F.coalesce("version", F.lit(1)) + 1, "parent_id": F.col("_old"),
                "supersedes": F.concat(F.array("_old"), F.coalesce("supersedes", F.array().cast("array<string>"))), "is_latest": F.lit(True), "created_at": F.col("_at"), "updated_at": F.col("_at")}
        new = written(ready.select(*[made.get(c, F.col(c)).cast(kinds[c]).alias(c) for c in memories.columns]), "versions")
        if new.isEmpty():
            break
        found.append(new.select("id", "parent_id"))
        gone = new.select(F.col("parent_id").alias("_p")).distinct()
        marked = now.join(gone, F.col("id") == F.col("_p"), "left").withColumn("is_latest", F.when(F.col("_p").isNotNull(), F.lit(False)).otherwise(F.col("is_latest"))).drop("_p")
        now = written(marked.unionByName(new), "memories")
        todo = written(todo.join(new.select("id"), "id", "left_anti"), "changes")
    links = reduce(DataFrame.unionByName, found) if found else memories.select("id", F.col("id").alias("parent_id")).limit(0)
    relations = links.select(F.col("id").alias("source_id"), F.col("parent_id").alias("target_id"), F.lit("supersedes").alias("type"), F.lit(1.0).alias("confidence"))
    return now, relations, todo.select("id", F.lit("memory not found").alias("error"))
