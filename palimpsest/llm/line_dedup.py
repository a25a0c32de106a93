"""Line deduplication over levelled sorted runs (DataFrame functions only).

Every distinct line key of a document is one 128-bit hash; hashes are written once
and texts are read again only to drop lines.  ``LineRuns`` keeps runs of (hash,
number of documents), each sorted by hash and written to the shared folder.  A new
batch is merge-anti-joined with the keys that the runs already hold as frequent
(nothing more need be known of those), and what is left becomes a run of level 0.
``fanout`` runs of a level are compacted into one of the next.

Defined results: null or empty text is one empty line; empty keys never count;
each row is a document, also where ids repeat or are null; texts of any length are
read whole; a key that exactly ``min_docs`` documents hold counts as frequent; an empty
table gives an empty result; columns of the input are kept untouched by ``drop_lines``.
"""
from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

BLANKS = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """Blanks stripped at both ends, A-Z lower-cased; other letters stay as they are."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def key_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7919), key).alias("h2"))


def document_keys(docs: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """One row for each distinct non-empty key of each document."""
    keys = F.array_distinct(F.transform(lines_of(F.col(text)), line_key))
    rows = docs.select(*keep, F.explode(F.filter(keys, lambda k: k != "")).alias("_key"))
    return rows.select(*[c for c in rows.columns if c != "_key"], key_hash(F.col("_key")).alias("_k")).select(
        "*", F.col("_k.h1").alias("h1"), F.col("_k.h2").alias("h2")).drop("_k")


class LineRuns:
    """A family of sorted runs of line hashes with document counts."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, fanout: int = 2):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[DataFrame]] = []

    def _all(self) -> DataFrame | None:
        runs = [run for level in self.levels for run in level]
        out = None
        for run in runs:
            out = run if out is None else out.unionByName(run)
        return out

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(written(run.sortWithinPartitions("h1", "h2"), f"line-run-{level}"))
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = full[0]
            for run in full[1:]:
                merged = merged.unionByName(run)
            self._put(level + 1, merged.groupBy("h1", "h2").agg(F.sum("n").alias("n")))

    def add(self, keys: DataFrame) -> None:
        """Adds a batch: one row (h1, h2) for each distinct key of each of its documents."""
        batch = keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
        held = self._all()
        if held is not None:
            settled = held.where(F.col("n") >= self.min_docs).select("h1", "h2")
            batch = batch.join(settled.hint("merge"), ["h1", "h2"], "left_anti")
        self._put(0, batch)

    def frequent(self) -> DataFrame:
        """Keys found in at least ``min_docs`` documents of all batches."""
        held = self._all()
        return held.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where(F.col("n") >= self.min_docs).select("h1", "h2")


def drop_lines(docs: DataFrame, mine: DataFrame, frequent: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text added; ``mine`` has the keys (_id, h1, h2) of documents."""
    hits = (mine.join(frequent, ["h1", "h2"], "left_semi").groupBy("_id")
            .agg(F.collect_set(F.struct("h1", "h2")).alias("_drop")))
    rows = docs.join(hits.hint("shuffle_hash"), docs[doc_id].eqNullSafe(hits["_id"]), "left").drop("_id")
    rows = rows.withColumn("_lines", lines_of(F.col(text)))
    gone = lambda line: F.array_contains(F.col("_drop"), key_hash(line_key(line)))
    kept = F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(F.filter(F.col("_lines"), lambda x: ~gone(x)))
    rows = rows.withColumn("_kept", kept)
    return (rows.withColumn("n_lines", F.size("_lines").cast("long"))
            .withColumn("n_dropped", (F.size("_lines") - F.size("_kept")).cast("long"))
            .withColumn("kept_text", F.array_join("_kept", "\n")).drop("_lines", "_kept", "_drop"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, batches: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines whose key at least ``min_docs`` documents hold go from every document."""
    runs = LineRuns(docs.sparkSession, min_docs)
    keys = written(document_keys(docs, text, [F.col(doc_id).alias("_id"), F.pmod(F.xxhash64(F.col(doc_id)), F.lit(batches)).cast("int").alias("_batch")]), "line-keys")
    for b in range(batches):
        runs.add(keys.where(F.col("_batch") == b))
    return drop_lines(docs, keys, written(runs.frequent(), "frequent-lines"), doc_id, text)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT doc, doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc, doc_id
"""
