"""Reference counts of images by deltas, and a quota that spares what is referenced or fresh."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_references(counts: DataFrame, deltas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts (path, n) after deltas (path, delta, at, id) of 1 and -1 in order, and (path) of images that are gone.

    A count that a step brings to zero or below is deleted with its image, and starts anew with the next reference.  So only what
    follows the last time a path stood at zero counts: with running sums S that start at n, the count is S - min(0, least S so far).
    """
    first = counts.select("path", F.col("n").cast("long").alias("delta"), F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("string").alias("id"), F.lit(0).alias("turn"))
    steps = deltas.where("delta IS NOT NULL AND path IS NOT NULL").select("path", F.col("delta").cast("long").alias("delta"), F.col("at").cast("timestamp").alias("at"), F.col("id").cast("string").alias("id"), F.lit(1).alias("turn"))
    upto = Window.partitionBy("path").orderBy("turn", "at", "id").rowsBetween(Window.unboundedPreceding, 0)
    sums = first.unionByName(steps).withColumn("_s", F.sum("delta").over(upto))
    order = F.struct("turn", "at", "id")
    last = sums.groupBy("path").agg(F.max_by("_s", order).alias("s"), F.min("_s").alias("least"), F.max("turn").alias("changed"))
    last = last.select("path", (F.col("s") - F.least(F.lit(0), "least")).alias("n"), "changed")
    return last.where("n > 0").select("path", "n"), last.where("n = 0 AND changed = 1").select("path")


def over_quota(images: DataFrame, counts: DataFrame, quota: int, now: Column, grace_seconds: float = 30) -> DataFrame:
    """(path, size) of the images to delete, oldest first, until the rest fits; referenced ones and those younger than the grace stay.

    ``images``: path, size, changed_at.  Totals are summed by day before they are spread over rows.
    """
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("changed_at").cast("timestamp"))
    held = counts.where("n > 0").select("path")
    free = images.where(age >= int(grace_seconds * 1e6)).join(held, "path", "left_anti").withColumn("_day", F.to_date("changed_at"))
    total = images.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total")).scalar()
    days = free.groupBy("_day").agg(F.sum("size").alias("_bytes"))
    before = days.withColumn("_before", F.coalesce(F.sum("_bytes").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_day", "_before")
    inner = F.coalesce(F.sum("size").over(Window.partitionBy("_day").orderBy("changed_at", "path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = free.join(before, "_day").withColumn("_freed", F.col("_before") + inner)
    return rows.where(total - F.col("_freed") > quota).select("path", "size")
