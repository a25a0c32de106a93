"""Slots (scope, project, label, content, pinned, limit): precedence, edits within a limit, and sweeps of records past their time."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def head_lines(text: Column, limit: Column | int) -> Column:
    """The head of a text up to ``limit`` characters, cut at the end of a line; a first line that is longer is cut as it is."""
    n = limit if isinstance(limit, Column) else F.lit(limit)
    whole = F.left(text, n + 1)
    cut = F.char_length(whole) - F.locate("\n", F.reverse(whole))  # characters before the last line break
    at_break = F.locate("\n", F.reverse(whole)) > 0
    return F.when(F.char_length(text) <= n, text).when(at_break & (cut > 0), F.left(whole, cut)).otherwise(F.left(text, n))


def tail_lines(text: Column, limit: Column | int) -> Column:
    """The tail of a text down to ``limit`` characters, cut at the start of a line; a last line that is longer is cut as it is."""
    n = limit if isinstance(limit, Column) else F.lit(limit)
    tail, before = F.right(text, n), F.left(F.right(text, n + 1), F.lit(1))
    at = F.locate("\n", tail)
    rest = F.substring(tail, at + 1, F.char_length(tail))
    return F.when(F.char_length(text) <= n, text).when(before == "\n", tail).when((at > 0) & (rest != ""), rest).otherwise(tail)


def visible(slots: DataFrame, projects: DataFrame) -> DataFrame:
    """The slots that each project sees: its own, and the global ones whose label it has not."""
    names = [c for c in slots.columns if c != "project"]
    asked = projects.select("project").where("project IS NOT NULL").distinct()
    own = slots.where("scope = 'project'").join(asked, "project", "left_semi").select("project", *names)
    everywhere = slots.where("scope = 'global'").agg(F.collect_list(F.struct(*names)).alias("s")).scalar()  # a few labels
    shared = asked.select("project", F.explode(everywhere).alias("s")).select("project", "s.*")
    rows = own.unionByName(shared)
    order = Window.partitionBy("project", "label").orderBy(F.when(F.col("scope") == "project", 0).otherwise(1))
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r").select(*slots.columns)


def pinned_text(seen: DataFrame, heading: str = "# pinned slots") -> DataFrame:
    """(project, content): the pinned slots of each project that hold something, by label."""
    body = F.regexp_replace(F.coalesce("content", F.lit("")), r"(?U)^\s+|\s+$", "")
    rows = seen.where("pinned").withColumn("_b", body).where("_b <> ''")
    held = F.array_sort(F.collect_list(F.struct("label", F.concat(F.lit("## "), "label", F.lit("\n"), "_b", F.lit("\n")).alias("part"))))
    return rows.groupBy("project").agg(held.alias("h")).select("project", F.concat(F.lit(heading + "\n\n"), F.array_join(F.transform("h", lambda x: x.part), "\n")).alias("content"))


def appended(content: Column, more: Column, limit: Column | int) -> Column:
    """A slot with a line more, whose oldest lines go beyond the limit."""
    joined = F.when(F.coalesce(content, F.lit("")) == "", more).otherwise(F.concat(content, F.lit("\n"), more))
    return tail_lines(joined, limit)


def replaced(content: Column, limit: Column | int) -> Column:
    """A slot with another content, whose last lines go beyond the limit."""
    return head_lines(content, limit)


def expired(rows: DataFrame, at: str, now: Column, seconds: float, expires: str | None = None) -> DataFrame:
    """Rows whose own time to end is reached or, where they have none, that are as old as ``seconds`` (0: those never end); rows without a time stay."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    t = F.unix_micros(now.cast("timestamp"))
    old = (F.lit(seconds > 0)) & (micros(at) + int(seconds * 1e6) <= t)
    return rows.where(F.coalesce(F.when(F.col(expires).isNotNull(), micros(expires) <= t).otherwise(old) if expires else old, F.lit(False)))
