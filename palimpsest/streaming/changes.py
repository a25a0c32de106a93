"""A feed of changes: every batch of a stream is compared with the state before it, and triggers see old and new values."""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.tables import files_of


class ChangeFeed:
    """Keyed state under a folder, changed batch by batch; ``apply`` serves as a ``foreachBatch`` function.

    A batch writes what it changed (key, op, old, new) and its latest rows, each to a folder of its own number.  The state
    is the latest row of every key in the last base and the batches after it; every ``every`` batches
    they are written into a new base, so a batch reads its own keys and never rewrites the whole.

    A batch that comes again is compared with the state before its number and overwrites its folders, so the feed, the state and
    the calls of triggers are those of one delivery.  Of rows of a batch with one key the last by ``order`` counts (ties: the greatest
    values); rows without a key are left out; a row whose ``gone`` column is true removes its key.  A row that changes nothing is no change.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: str, values: list[str], kinds: str, gone: str | None = None, every: int = 8):
        self.spark, self.path, self.key, self.order, self.values, self.gone, self.every = spark, path.rstrip("/"), key, order, values, gone, every
        self.row_kind = f"{key} {kinds.split(', ')[0].split()[1]}, now struct<{', '.join(f'{p.split()[0]}: {p.split(maxsplit=1)[1]}' for p in kinds.split(', ')[1:])}>"
        self.triggers: list[tuple[Column, Callable[[DataFrame, int], None]]] = []

    def on(self, condition: Column, action: Callable[[DataFrame, int], None]) -> None:
        """Calls ``action(changes, batch_id)`` for each batch with changes that meet a condition on op, old and new."""
        self.triggers.append((condition, action))

    def _batches(self, part: str) -> list[int]:
        """Numbers of the finished folders of a part."""
        done = (p for p, *_ in files_of(self.spark, f"{self.path}/{part}") if p.endswith("/_SUCCESS"))
        return sorted(int(p.rsplit("=", 1)[1].split("/")[0]) for p in done)

    def _read(self, part: str, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{part}/batch={number}")

    def state(self, before: int | None = None) -> DataFrame:
        """(key, now): the state, or what it was before a batch."""
        bases = [b for b in self._batches("base") if before is None or b < before]
        last = bases[-1] if bases else -1
        later = [b for b in self._batches("delta") if b > last and (before is None or b < before)]
        parts = [self._read("base", last).withColumn("_b", F.lit(last))] if bases else []
        parts += [self._read("delta", b).withColumn("_b", F.lit(b)) for b in later]
        if not parts:
            return self.spark.createDataFrame([], self.row_kind)
        newest = reduce(DataFrame.unionByName, parts).groupBy(self.key).agg(F.max_by(F.struct("now"), "_b").alias("_s"))
        return newest.select(self.key, "_s.now").where("now IS NOT NULL")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        value = F.struct(*self.values)
        shown = F.when(F.coalesce(F.col(self.gone), F.lit(False)), F.lit(None)).otherwise(value) if self.gone else value
        rows = batch.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max(F.struct(F.col(self.order).alias("o"), shown.alias("now"))).alias("_m")).select(self.key, "_m.now")
        rows.write.mode("overwrite").parquet(f"{self.path}/delta/batch={batch_id}")
        rows = self._read("delta", batch_id)
        old = self.state(batch_id).withColumnRenamed("now", "old").join(rows.select(self.key), self.key, "left_semi")
        op = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("update")
        changes = rows.withColumnRenamed("now", "new").join(old, self.key, "left").where(~F.col("old").eqNullSafe(F.col("new"))).select(self.key, op.alias("op"), "old", "new")
        changes.write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch_id}")
        written = self._read("changes", batch_id)
        for condition, action in self.triggers:
            hit = written.where(condition)
            if not hit.isEmpty():
                action(hit, batch_id)
        if len([b for b in self._batches("delta") if b > max([-1, *self._batches("base")])]) > self.every and batch_id > 0:
            # the batch itself stays outside the base, as it may come again
            self.state(batch_id).write.mode("overwrite").parquet(f"{self.path}/base/batch={batch_id - 1}")

    def changes(self, after: int = -1) -> DataFrame:
        """(batch, key, op, old, new) of all batches after a number, as a consumer asks for what it has not seen."""
        parts = [self._read("changes", b).withColumn("batch", F.lit(b)) for b in self._batches("changes") if b > after]
        if parts:
            return reduce(DataFrame.unionByName, parts).select("batch", self.key, "op", "old", "new")
        none = self.spark.createDataFrame([], self.row_kind)
        return none.select(F.lit(0).alias("batch"), self.key, F.lit("").alias("op"), F.col("now").alias("old"), F.col("now").alias("new"))
