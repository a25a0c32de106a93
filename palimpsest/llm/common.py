"""Helpers shared by the corpus operators."""
from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.shared import shared_path, written
from palimpsest.sources.tables import table

__all__ = ["components", "fold_bucket", "sent", "shared_path", "shuffle_width", "table", "tidy", "values", "written"]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold_bucket(column: str, modulus: int):
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def sent(docs: DataFrame, keep: list[str] | tuple[str, ...], text: str) -> tuple[DataFrame, int]:
    """The columns that tasks get, ``keep`` first and the text once, and the place of the text."""
    names = list(keep)
    return (docs.select(*names), names.index(text)) if text in names else (docs.select(*names, docs[text].alias("_text")), len(names))


def values(column: pa.Array, rows: int = 500) -> Iterator:
    """The values of a column as Python objects, of which ``rows`` are held at once."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def give_back() -> None:
    """Memory that a Python worker has freed goes back to the system; workers stay, and share an executor's memory with what comes next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` with ``give_back`` before and after it."""
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 40) -> DataFrame:
    """Connected components of an undirected graph: rows (node, component), the smallest node of each.

    Alternating large-star and small-star steps: every step links neighbours to a
    node's smallest neighbour, until only stars are left.  Each round is written
    to the shared folder, so no lineage grows and nothing reaches the driver but a
    count and a checksum.  Nodes without an edge are not listed.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    links = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(low, both.u == low.w).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(down, large.u == down.w)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select(F.col("w").alias("u"), F.col("m").alias("v")))
        links = written(small.where("u <> v").distinct(), "links")
        state = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen == state:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
