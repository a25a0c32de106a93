"""Embedding near-duplicates through a pivot-permutation index.

Each vector is described by its ``prefix`` nearest reference points (pivots) in
order.  Inverted lists hold, for each pivot, the vectors whose description names
it.  All pairs of a list are compared in double precision; a linked pair counts in
the list of its smallest shared pivot only.  Linked vectors that share no pivot at
all are not found.

Pivots come from a bounded sample, the distinct vectors with the smallest hash, at
most 2^k of them, k growing so that lists grow as the square root of the input;
every vector is indexed.  MOST_PIVOTS bounds what is sent to the tasks; it is reached at
some 268 million vectors, beyond which lists grow in proportion.  A pivot is taken only if no earlier one lies within twice
the link angle, so no vector has two pivots within its link angle and a dense group
owns few of them, however many rows it has.  Pivots with long lists get the smallest
numbers.  Vectors that are equal count as one with a multiplicity.

A list longer than ``block`` is cut into blocks and each pair of blocks is a group of
its own, so no task holds more than two blocks.  Rows of a list with the same
smallest pivot have met in the list of that pivot; where they fill a block, they get
blocks of their own, which are not paired with one another again.  Groups return
link counts and the edges of a spanning forest, never all pairs.

Defined results: vectors that are null, zero or hold null or non-finite
components, and rows without an id, link with nothing and are their own
component; vectors of different lengths never link; each row of a repeated id
counts as a vector; an empty table gives an empty result.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, shuffle_width, table, written

PREFIX, BLOCK = 16, 1500
SAMPLED = 4  # vectors looked at for each wanted pivot
LEAST_PIVOTS, MOST_PIVOTS = 128, 1 << 16
COSINE = 0.9


def pivots_for(n: int) -> int:
    """A power of two near 4 sqrt(n), within bounds."""
    return int(min(MOST_PIVOTS, max(LEAST_PIVOTS, 2 ** round(math.log2(4 * math.sqrt(max(n, 1)))))))


def usable(vector):
    """Not null, no null or non-finite component, not zero."""
    return (F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x) == float("inf")))
            & F.exists(vector, lambda x: x != 0))


def unit(rows: pa.Array) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in rows.to_numpy(zero_copy_only=False)])
    big = np.abs(x).max(1, keepdims=True)  # keeps squares of very large or small components in range
    x = x / big
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of the nearest pivots, nearest first."""
    near = x @ pivots.T
    k = min(prefix, near.shape[1])
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
    return np.take_along_axis(top, order, 1)


def pivots_apart(x: np.ndarray, most: int, cosine: float) -> np.ndarray:
    """Up to ``most`` rows of ``x``, in order, no two within twice the angle of ``cosine``; those near most of ``x`` first."""
    apart = 2 * cosine * cosine - 1 if cosine > 0 else -1.0
    chosen = x[:1]
    for s in range(1, len(x), 256):
        part = x[s : s + 256]
        part = part[(part @ chosen.T).max(1) < apart]
        near, taken = part @ part.T, []
        for i in range(len(part)):
            if not (near[i, taken] >= apart).any():
                taken.append(i)
        chosen = np.concatenate([chosen, part[taken]])
        if len(chosen) >= most:
            break
    chosen = chosen[:most]
    length = np.zeros(len(chosen), np.int64)
    for s in range(0, min(len(x), 4096), 1024):
        length += np.bincount(nearest_pivots(x[s : s + 1024], chosen, PREFIX).ravel(), minlength=len(chosen))
    return chosen[np.argsort(-length, kind="stable")]


def meet_before(pivot: int, perm: np.ndarray, i: np.ndarray, j: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs (i of left, j of right) share a pivot below ``pivot``."""
    if len(i) * 512 > len(left) * len(right) * pivot:  # many pairs: all of the two blocks at once
        named = np.zeros((len(perm), pivot + 1), np.float32)
        np.put_along_axis(named, np.minimum(perm, pivot), 1.0, 1)
        return (named[left, :pivot] @ named[right, :pivot].T)[i, j] > 0
    out = np.zeros(len(i), bool)
    for s in range(0, len(i), 1 << 14):
        e = slice(s, s + (1 << 14))
        p, q = perm[left[i[e]]], perm[right[j[e]]]
        out[e] = ((p[:, :, None] == q[:, None, :]) & (p[:, :, None] < pivot)).any((1, 2))
    return out


def group_links(pivot: int, perm: np.ndarray, x: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i in left, j in right) of linked pairs whose smallest shared pivot is ``pivot``; with ``same``, left is right."""
    near = x[left] @ x[right].T
    i, j = np.nonzero(near >= cosine - 1e-9)
    if same:
        i, j = i[i < j], j[i < j]
    ok = near[i, j] >= cosine + 1e-9
    unsure = np.flatnonzero(~ok)
    ok[unsure] = (x[left[i[unsure]]] * x[right[j[unsure]]]).sum(1) >= cosine
    i, j = i[ok], j[ok]
    if pivot and len(i):
        new = ~meet_before(pivot, perm, i, j, left, right)
        i, j = i[new], j[new]
    return left[i], right[j]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Label of each place: the smallest place that links reach."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE,
                    prefix: int = PREFIX, block: int = BLOCK) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of ``vectors``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"))
    rows = rows.withColumn("ok", F.coalesce(usable("v") & F.col("vec_id").isNotNull(), F.lit(False)))
    classes = written(rows.where("ok").groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
                      .select("id", "copies", "v", F.size("v").alias("dim"), F.xxhash64("v").alias("h")), "vectors")
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts, edges = [], []
    for dim, n in sorted(sizes.items()):
        c, e = _index(spark, classes.where(F.col("dim") == dim), n, cosine, prefix, block)
        counts.append(c)
        edges.append(e)
    if not sizes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = _union(counts).groupBy("id").agg(F.sum("n").alias("n"))
    part = components(_union(edges), "a", "b")
    found = (classes.join(links, "id", "left").join(part, F.col("id") == F.col("node"), "left")
             .select(F.col("v").alias("_v"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("_n"), F.coalesce("component", "id").alias("_c")))
    out = rows.join(found, F.col("ok") & (F.col("v") == F.col("_v")), "left")
    component = F.coalesce("_c", "vec_id")
    return out.select("vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _index(spark: SparkSession, classes: DataFrame, n: int, cosine: float, prefix: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Link counts (id, n) and forest edges (a, b) among the classes of one dimension."""
    sample = classes.orderBy("h", "id").limit(SAMPLED * pivots_for(n)).select("v").toArrow()["v"].combine_chunks()
    pivots = pivots_apart(unit(sample), pivots_for(n), cosine)
    known = spark.sparkContext.broadcast(pivots)

    def describe(batches):
        for batch in batches:
            if len(batch):
                perm = nearest_pivots(unit(batch.column(2)), known.value, prefix).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(perm.ravel()), perm.shape[1]).cast(pa.list_(pa.int32()))], names=["id", "copies", "v", "perm"])

    described = written(classes.select("id", "copies", "v").mapInArrow(describe, "id long, copies long, v array<float>, perm array<int>")
                        if dict(classes.dtypes)["v"] == "array<float>" else
                        classes.select("id", "copies", F.col("v").cast("array<double>").alias("v")).mapInArrow(describe, "id long, copies long, v array<double>, perm array<int>"), "permutations")
    lists = described.select("*", F.array_min("perm").alias("first"), F.explode("perm").alias("pivot"))
    sizes = lists.groupBy("pivot", "first").agg(F.count(F.lit(1)).alias("n"))
    own = (F.col("n") > block) & (F.col("first") < F.col("pivot"))  # rows that have met and fill a block
    parts = sizes.groupBy("pivot", F.when(own, F.col("first")).otherwise(-1).alias("part")).agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    by_pivot = Window.partitionBy("pivot")
    parts = parts.select("pivot", "part", "blocks", (F.sum("blocks").over(by_pivot.orderBy("part")) - F.col("blocks")).cast("int").alias("start"), F.sum("blocks").over(by_pivot).cast("int").alias("total"))
    parts = written(parts, "list-parts")
    apart = parts.where("part >= 0").select("pivot", F.col("part").alias("first"), "part")
    lists = lists.join(F.broadcast(apart), ["pivot", "first"], "left").withColumn("part", F.coalesce("part", F.lit(-1)))
    lists = lists.join(F.broadcast(parts), ["pivot", "part"])
    lists = lists.withColumn("blk", F.col("start") + F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = lambda b: (F.col("part") >= 0) & (b >= F.col("start")) & (b < F.col("start") + F.col("blocks"))
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("total") - 1), lambda b: ~met(b)))
    groups = lists.select("*", other.alias("oth")).select("pivot", F.least("blk", "oth").alias("lo"), F.greatest("blk", "oth").alias("hi"), "blk", "id", "copies", "v", "perm")

    def link(key, t):
        pivot, lo, hi = (k.as_py() for k in key)
        ids, copies, blk = (t[c].to_numpy() for c in ("id", "copies", "blk"))
        x = unit(t["v"].combine_chunks())
        perm = np.stack([np.asarray(p) for p in t["perm"].to_numpy()])
        left, right = np.flatnonzero(blk == lo), np.flatnonzero(blk == hi)
        i, j = group_links(pivot, perm, x, left, right, lo == hi, cosine)
        total = np.bincount(i, weights=copies[j], minlength=len(ids)) + np.bincount(j, weights=copies[i], minlength=len(ids))
        label = forest(len(ids), i, j)
        at = np.flatnonzero(total > 0)
        return pa.table({"id": pa.array(ids[at]), "n": pa.array(total[at].astype(np.int64)), "other": pa.array(ids[label[at]])})

    found = groups.repartition(shuffle_width(spark) * 2, "pivot", "lo", "hi").groupBy("pivot", "lo", "hi").applyInArrow(link, "id long, n long, other long")
    found = written(found, "vector-links")
    return found.select("id", "n"), found.select(F.col("id").alias("a"), F.col("other").alias("b"))


def op9_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
