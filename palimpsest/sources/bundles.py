"""Export and import of whole stores, versioned snapshots, deltas and Markdown files."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators.lifecycle import last_writer_wins, upsert

STRATEGIES = ("merge", "replace", "skip")


def export_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as JSON lines below ``path``."""
    for name, rows in tables.items():
        rows.write.mode("errorifexists").json(f"{path}/{name}")


def read_bundle(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.items()}


def import_rows(held: DataFrame, coming: DataFrame, key: str, strategy: str = "merge", updated: str | None = None) -> DataFrame:
    """merge: the newer of two rows (without times the incoming one); skip: held rows win; replace: only incoming rows stay."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {', '.join(STRATEGIES)}")
    if strategy == "replace":
        return coming
    if strategy == "skip":
        return held.unionByName(coming.join(held.select(key), key, "left_anti"))
    return last_writer_wins(held, coming, key, updated) if updated else upsert(held, coming, key)


def snapshot(tables: dict[str, DataFrame], path: str, version: int) -> None:
    for name, rows in tables.items():
        rows.write.mode("errorifexists").parquet(f"{path}/version={version}/{name}")


def restore(spark: SparkSession, path: str, version: int, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/version={version}/{name}") for name in names}


def delta_pages(rows: DataFrame, since, key: str, updated: str, page_bytes: int = 8 << 20, buckets: int = 256) -> DataFrame:
    """Rows newer than ``since`` with the number of their page of about ``page_bytes``, in the order of ``key``.

    Ranges of the key are summed first, so the running total of bytes never
    puts all rows into one task: only the ranges' sums are ordered as a whole.
    """
    new = rows.where(F.col(updated) > since).withColumn("_bytes", F.octet_length(F.to_json(F.struct("*"))).cast("long"))
    new = new.repartitionByRange(buckets, key).withColumn("_range", F.spark_partition_id())
    sums = new.groupBy("_range").agg(F.sum("_bytes").alias("_sum"))
    before = sums.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    upto = F.sum("_bytes").over(Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    paged = new.withColumn("_upto", upto).join(before, F.col("_range") == F.col("_r"))
    page = F.floor((F.col("_before") + F.col("_upto") - F.col("_bytes")) / page_bytes).cast("long")
    return paged.withColumn("page", page).drop("_bytes", "_range", "_r", "_before", "_upto")


def markdown(rows: DataFrame, key: str, title: str, body: str, facts: list[str]) -> DataFrame:
    """(key, value): each row as a Markdown text with its facts in front."""
    front = [F.concat(F.lit(f"{name}: "), F.coalesce(F.col(name).cast("string"), F.lit(""))) for name in facts]
    value = F.concat_ws("\n", F.lit("---"), *front, F.lit("---"), F.concat(F.lit("# "), F.coalesce(F.col(title), F.lit(""))), F.lit(""), F.coalesce(F.col(body), F.lit("")))
    return rows.select(key, value.alias("value"))


def export_markdown(rows: DataFrame, path: str, key: str, title: str, body: str, facts: list[str]) -> None:
    """A folder of Markdown text for each key."""
    markdown(rows, key, title, body, facts).write.partitionBy(key).mode("errorifexists").text(path)
