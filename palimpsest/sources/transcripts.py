"""Agent transcripts in JSON lines, and graphs in JSON."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE = "type string, uuid string, sessionId string, timestamp string, cwd string, message struct<role: string, content: string>"
PART = "array<struct<type: string, text: string, id: string, name: string, input: string, tool_use_id: string, content: string, is_error: boolean>>"


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """One row for each part of each message below ``path``: file, at, session_id, ts, role, kind, body, tool_name, call_id, is_error.

    Lines that aren't JSON objects are left out; a missing time is that of the
    line before it in its file.  Lines keep their order by block and place.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
    rows = lines.select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"),
                        F.from_json("value", LINE).alias("r"))
    rows = rows.where("r.type IS NOT NULL")
    order = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("ts", F.last(F.try_to_timestamp("r.timestamp"), True).over(order))
    parts = F.from_json("r.message.content", PART)
    plain = F.array(F.struct(F.lit("text").alias("type"), F.col("r.message.content").alias("text"), *[F.lit(None).cast("string").alias(c) for c in ("id", "name", "input", "tool_use_id", "content")],
                             F.lit(None).cast("boolean").alias("is_error")))
    listed = F.startswith(F.ltrim(F.coalesce("r.message.content", F.lit(""))), F.lit("["))
    rows = rows.withColumn("part", F.explode_outer(F.when(listed, parts).otherwise(plain)))
    return rows.select("file", "at", F.col("r.sessionId").alias("session_id"), "ts", F.coalesce("r.message.role", "r.type").alias("role"), F.col("part.type").alias("kind"),
                       F.coalesce("part.text", "part.input", "part.content").alias("body"), F.col("part.name").alias("tool_name"), F.coalesce("part.id", "part.tool_use_id").alias("call_id"),
                       F.coalesce("part.is_error", F.lit(False)).alias("is_error"))


def calls_with_results(parts: DataFrame) -> DataFrame:
    """Tool calls with their results, if there is one."""
    calls = parts.where("kind = 'tool_use'").select("session_id", "call_id", "ts", "tool_name", F.col("body").alias("input"))
    results = parts.where("kind = 'tool_result'").select("session_id", "call_id", F.col("body").alias("output"), "is_error")
    return calls.join(results, ["session_id", "call_id"], "left")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (id, label, kind), edges (src, dst, type) with both ends known, and dangling edges, of graph files in JSON."""
    schema = ("nodes array<struct<id: string, label: string, file_type: string>>, links array<struct<source: string, target: string, relation: string>>, "
              "edges array<struct<source: string, target: string, relation: string>>")
    files = spark.read.schema(schema).json(path, multiLine=True)
    nodes = files.select(F.explode("nodes").alias("n")).select("n.id", "n.label", F.coalesce("n.file_type", F.lit("concept")).alias("kind")).where("id IS NOT NULL").dropDuplicates(["id"])
    links = files.select(F.explode(F.coalesce("links", "edges")).alias("e")).select(F.col("e.source").alias("src"), F.col("e.target").alias("dst"), F.coalesce("e.relation", F.lit("related_to")).alias("type")).distinct()
    known = nodes.select("id")
    whole = links.join(known, links["src"] == known["id"], "left_semi").join(known, F.col("dst") == known["id"], "left_semi")
    return nodes, whole, links.join(whole, ["src", "dst", "type"], "left_anti")
