"""Marks that say how far a consumer has come, and states that change slowly; batch frames and streams."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_counts(rows: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, n): rows of each key so far; as a stream in update mode."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def windows(rows: DataFrame, ts: str, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """(first_at, n) of tumbling or sliding windows in event time; ``late`` sets the watermark of a stream."""
    rows = rows.withWatermark(ts, late) if late else rows
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return rows.groupBy(window.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("first_at"), "n")


def beyond_mark(rows: DataFrame, marks: DataFrame, key: str, ts: str) -> DataFrame:
    """Rows newer than the mark (key, mark) of their key; all of keys without a mark."""
    held = marks.select(F.col(key).alias("_k"), "mark")
    return rows.join(held, F.col(key) == F.col("_k"), "left").where(F.col("mark").isNull() | (F.col(ts) > F.col("mark"))).drop("_k", "mark")


def next_marks(rows: DataFrame, marks: DataFrame, key: str, ts: str) -> DataFrame:
    """(key, mark) after ``rows`` have been taken; a mark never moves back."""
    return rows.select(key, F.col(ts).alias("mark")).unionByName(marks.select(key, "mark")).groupBy(key).agg(F.max("mark").alias("mark"))


def ready(rows: DataFrame, pending: DataFrame, key: str, ts: str, now: Column, most: str = "1 hour") -> DataFrame:
    """Rows older than the oldest pending row of their key; what has been held for ``most`` is let go."""
    oldest = pending.groupBy(F.col(key).alias("_k")).agg(F.min(ts).alias("_oldest"))
    free = F.col("_oldest").isNull() | (F.col(ts) < F.col("_oldest")) | (F.col(ts) <= now - F.expr(f"INTERVAL {most}"))
    return rows.join(oldest, F.col(key) == F.col("_k"), "left").where(free).drop("_k", "_oldest")


def coverage(listed: DataFrame, pending: DataFrame, key: str, ts: str) -> DataFrame:
    """(key, covered_through) of a summary made from a listing (key, listed_at): its time, or the oldest pending row before it."""
    oldest = pending.groupBy(key).agg(F.min(ts).alias("_oldest"))
    return listed.join(oldest, key, "left").select(key, F.least("listed_at", "_oldest").alias("covered_through"))


def uncovered(rows: DataFrame, covered: DataFrame, key: str, row_id: str) -> DataFrame:
    """Rows that no summary has taken in (key, row_id), late ones with old times as well."""
    return rows.join(covered.select(key, row_id), [key, row_id], "left_anti")


def steady(samples: DataFrame, key: str, order: list[str], value: str, agreeing: int = 3, start: str = "healthy") -> DataFrame:
    """Adds the verdict after each sample: it changes only when ``agreeing`` samples in a row say the same."""
    by = Window.partitionBy(key).orderBy(*order)
    new_run = F.coalesce((F.lag(value).over(by) != F.col(value)).cast("int"), F.lit(1))
    runs = samples.withColumn("_new", new_run).withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy(key, "_run").orderBy(*order))
    switched = runs.withColumn("_at", F.when(place == agreeing, F.col(value)))
    verdict = F.coalesce(F.last("_at", True).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(start))
    return switched.withColumn("verdict", verdict).drop("_new", "_run", "_at")


def read_once(messages: DataFrame, reader: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """A reader's messages that are neither read nor expired, and all messages with these marked as read.

    ``messages``: id, reader, read_at, expires_at.
    """
    fresh = (F.col("reader") == reader) & F.col("read_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
    fresh = F.coalesce(fresh, F.lit(False))
    return messages.where(fresh), messages.withColumn("read_at", F.when(fresh, now).otherwise(F.col("read_at")))
