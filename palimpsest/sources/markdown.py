"""Memory files in Markdown: one text per project under a budget of lines, and its sections and memories read back."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEADER = "# Agent Memory"


def memory_files(memories: DataFrame, summaries: DataFrame, budget: int = 200) -> DataFrame:
    """(project, body): a header, the project's summary, and its latest memories by falling strength (ties: id), as whole lines within ``budget``.

    ``memories``: id, project, title, content, strength; ``summaries``: project, summary.  Only the first memories that can have a
    line, and their first lines, are gathered, so a project's text is bounded by its budget.  Line breaks in titles become blanks.
    """
    order = Window.partitionBy("project").orderBy(F.desc("strength"), "id")
    rows = memories.where("project IS NOT NULL").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= budget)
    lines = F.slice(F.split(F.coalesce("content", F.lit("")), "\n", -1), 1, budget)
    rows = rows.select("project", "_r", F.regexp_replace(F.coalesce("title", F.lit("")), r"\s*\n\s*", " ").alias("title"), lines.alias("lines"))
    heads = rows.select("project").distinct().join(summaries.select("project", "summary"), "project", "full")
    said = F.coalesce("summary", F.lit("")) != ""
    head = F.concat(F.array(F.lit(HEADER), F.lit("")), F.when(said, F.concat(F.array(F.lit("## Project Summary")), F.split("summary", "\n", -1), F.array(F.lit("")))).otherwise(F.array().cast("array<string>")),
                    F.array(F.lit("## Key Memories"), F.lit("")))
    heads = heads.where("project IS NOT NULL").select("project", head.alias("head"))
    before = F.sum(F.size("lines") + 2).over(Window.partitionBy("project").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("_b", F.coalesce(before, F.lit(0))).join(heads.select("project", F.size("head").alias("_h")), "project").withColumn("_at", F.col("_h") + F.col("_b"))
    room = F.greatest(F.lit(budget - 2) - F.col("_at"), F.lit(0)).cast("int")  # lines of content that still fit
    part = F.concat(F.array(F.concat(F.lit("### "), "title")), F.slice("lines", F.lit(1), room), F.array(F.lit("")))
    kept = placed.where(F.col("_at") < budget - 2).groupBy("project").agg(F.array_sort(F.collect_list(F.struct("_r", part.alias("part")))).alias("parts"))
    whole = heads.join(kept, "project", "left").select("project", F.concat("head", F.coalesce(F.flatten(F.transform("parts", lambda x: x.part)), F.array().cast("array<string>"))).alias("all"))
    return whole.select("project", F.array_join(F.slice("all", 1, budget), "\n").alias("body"))


def _trimmed(value):
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def file_sections(files: DataFrame, key: str = "project", body: str = "body") -> DataFrame:
    """(key, section, content): what stands under each line that opens with ``## ``, trimmed; of sections with one name the last.  Null: none."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), F.coalesce(body, F.lit(""))), "\n## ", -1), 2, 1 << 30)
    rows = files.select(key, F.posexplode(parts).alias("_pos", "_part"))
    name = _trimmed(F.split_part(F.col("_part"), F.lit("\n"), F.lit(1)))
    rest = F.regexp_replace("_part", r"^[^\n]*\n?", "")
    rows = rows.select(key, name.alias("section"), F.struct(F.col("_pos").alias("pos"), _trimmed(rest).alias("content")).alias("_c")).where("section <> ''")
    return rows.groupBy(key, "section").agg(F.max("_c").alias("_c")).select(key, "section", "_c.content")


def file_memories(files: DataFrame, key: str = "project", body: str = "body") -> DataFrame:
    """(key, place, title, content): the entries ``### title`` under Key Memories, in order."""
    told = file_sections(files, key, body).where("section = 'Key Memories'")
    parts = F.slice(F.split(F.concat(F.lit("\n"), F.col("content")), "\n### ", -1), 2, 1 << 30)
    rows = told.select(key, F.posexplode(parts).alias("place", "_part"))
    return rows.select(key, "place", _trimmed(F.split_part(F.col("_part"), F.lit("\n"), F.lit(1))).alias("title"), _trimmed(F.regexp_replace("_part", r"^[^\n]*\n?", "")).alias("content"))


def read_memory_files(spark: SparkSession, path: str) -> DataFrame:
    """(project, body) of the Markdown files below a path; a file's name without its ending is its project."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("_f"), F.col("value").alias("body"))
    return files.select(F.url_decode(F.regexp_extract("_f", r"([^/]+)\.md$", 1)).alias("project"), "body")


def to_sync(stored: DataFrame, files: DataFrame, memories: DataFrame) -> DataFrame:
    """(project, action, title, content): entries of a file that the store has not, or with another content; entries count by their title.

    ``stored`` are the project's memories (project, title, content), ``memories`` the entries read from ``files``.
    """
    held = stored.select(F.col("project").alias("_p"), F.col("title").alias("_t"), _trimmed(F.col("content")).alias("_c"))
    rows = memories.join(files.select("project").distinct(), "project", "left_semi").join(held, (F.col("project") == F.col("_p")) & (F.col("title") == F.col("_t")), "left")
    return rows.where(F.col("_t").isNull() | (F.col("_c") != F.col("content"))).select("project", F.when(F.col("_t").isNull(), "add").otherwise("change").alias("action"), "title", "content")
