"""Joins by similarity of token sets: contradictions, supersession, shadowing."""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import graph
from palimpsest.sources.shared import freed, removed, written

SEEN = 1 << 20
MASKS = 500_000
LOT = 10_000
FEW = 16
SHARED = 8


def contradictions(memories: DataFrame, newest: int = 1000, above: float = 0.9, key: str = "id", body: str = "content", concepts: str = "concepts", order: str = "created_at") -> DataFrame:
    """(id_a, id_b, similarity): pairs of the newest memories that share a concept and nearly all words.

    Only the newest 1000 are compared, as the feature is defined, so the pairs
    of one concept stay bounded.  Texts that name different dates don't contradict.
    """
    rows = memories.orderBy(F.col(order).desc(), key).limit(newest)
    rows = rows.select(F.col(key).alias("id"), F.col(body).alias("body"), F.col(concepts).alias("concepts"), text.word_set(F.col(body)).alias("words"))
    tagged = rows.select("id", F.explode(F.array_distinct("concepts")).alias("concept"))
    pairs = tagged.alias("x").join(tagged.alias("y"), "concept").where("x.id < y.id").select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b")).distinct()
    a = rows.select(F.col("id").alias("id_a"), F.col("body").alias("body_a"), F.col("words").alias("words_a"))
    b = rows.select(F.col("id").alias("id_b"), F.col("body").alias("body_b"), F.col("words").alias("words_b"))
    both = pairs.join(a, "id_a").join(b, "id_b")
    alike = text.jaccard(F.col("words_a"), F.col("words_b"), F.col("body_a"), F.col("body_b"))
    both = both.withColumn("similarity", F.round(alike, 6)).where((F.col("similarity") > above) & ~text.different_dates(F.col("body_a"), F.col("body_b")))
    return both.select("id_a", "id_b", "similarity")


def supersession(incoming: DataFrame, candidates: DataFrame, memories: DataFrame, replace: float = 0.7, advise: float = 0.4) -> DataFrame:
    """(id, other, similarity, action) for each incoming text (id, body).

    ``candidates`` (id, other, rank) are search hits, ``memories`` (other, body).
    The first candidate above 0.7 is superseded unless the texts name different
    dates; else the most similar above 0.4 is named as advice; else insert.
    """
    new = incoming.select("id", F.col("body").alias("mine"), text.word_set(F.col("body")).alias("words_mine"))
    old = memories.select("other", F.col("body").alias("theirs"), text.word_set(F.col("body")).alias("words_theirs"))
    pairs = candidates.select("id", "other", "rank").join(new, "id").join(old, "other")
    alike = text.jaccard(F.col("words_mine"), F.col("words_theirs"), F.col("mine"), F.col("theirs"))
    pairs = pairs.withColumn("similarity", F.round(alike, 6))
    replaces = (F.col("similarity") > replace) & ~text.different_dates(F.col("mine"), F.col("theirs"))
    pairs = pairs.withColumn("replaces", replaces).where(F.col("replaces") | (F.col("similarity") > advise))
    best = pairs.groupBy("id").agg(F.min_by(F.struct("other", "similarity", "replaces"), F.struct(
        ~F.col("replaces"), F.when(F.col("replaces"), F.col("rank")).otherwise(0), -F.col("similarity"), F.col("rank"))).alias("best"))
    action = F.when(F.col("best.replaces"), "supersede").when(F.col("best.other").isNotNull(), "advise").otherwise("insert")
    return incoming.select("id").join(best, "id", "left").select("id", "best.other", "best.similarity", action.alias("action"))


def shadowing(pool: DataFrame, shared: int = 2, share: float = 0.3) -> DataFrame:
    """(query_id, doc_id, newer_id, n_shared): the newest row of the same kind that repeats a row's distinctive terms.

    ``pool``: limited hits with query_id, doc_id, ts, kind, body.
    """
    rows = pool.select("query_id", "doc_id", "ts", "kind", text.distinctive_terms(F.col("body")).alias("terms"))
    new = rows.select("query_id", "kind", F.col("doc_id").alias("newer_id"), F.col("ts").alias("newer_ts"), F.col("terms").alias("newer_terms"))
    both = rows.join(new, ["query_id", "kind"]).where("newer_ts > ts")
    both = both.withColumn("n_shared", F.size(F.array_intersect("terms", "newer_terms")).cast("long"))
    least = F.least(F.size("terms"), F.size("newer_terms"))
    both = both.where((F.col("n_shared") >= shared) & (F.col("n_shared") >= share * least))
    order = Window.partitionBy("query_id", "doc_id").orderBy(F.col("newer_ts").desc(), "newer_id")
    return both.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("query_id", "doc_id", "newer_id", "n_shared")


def twins(rows: DataFrame, alike: float = 0.5, key: str = "id", words: str = "words") -> DataFrame:
    """(id_a, id_b, similarity) of rows whose token sets are alike, by a prefix filter."""
    found = shared_counts(rows, alike, key, words)
    score = F.round(F.col("shared") / F.col("total"), 6)
    return found.select("id_a", "id_b", score.alias("similarity")).where(F.col("similarity") >= alike)


def prefixes(rows: DataFrame, alike: float) -> DataFrame:
    """(id, size, word, at, n): the first words of each set (id, words) in the order of rarity, of which sets that are alike share one.

    ``at`` counts all words of the set; words of one set only are left out.
    """
    each = rows.select("id", F.size("words").alias("size"), F.explode("words").alias("word"))
    counts = each.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    placed = each.join(counts, "word").withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy("n", "word")))
    return placed.where((F.col("at") <= F.col("size") - F.ceil(alike * F.col("size")) + 1) & (F.col("n") > 1))


def shared_counts(rows: DataFrame, alike: float, key: str = "id", words: str = "words") -> DataFrame:
    """(id_a, id_b, shared, total) for pairs of rows that may be alike: sizes of intersection and union.

    Words are ordered by rarity; sets that are alike share one of the first
    n - ceil(alike * n) + 1 words, so only those are joined.
    """
    rows = rows.select(F.col(key).alias("id"), F.array_distinct(F.col(words)).alias("words"))
    heads = prefixes(rows, alike).select("id", "word", "size")
    a, b = heads.select(F.col("id").alias("id_a"), "word", F.col("size").alias("size_a")), heads.select(F.col("id").alias("id_b"), "word", F.col("size").alias("size_b"))
    near = (F.col("id_a") < F.col("id_b")) & (F.least("size_a", "size_b") >= alike * F.greatest("size_a", "size_b"))
    return overlaps(a.join(b, "word").where(near).select("id_a", "id_b").distinct(), rows)


def overlaps(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(id_a, id_b, shared, total) of pairs of rows (id, words)."""
    full = pairs.join(rows.select(F.col("id").alias("id_a"), F.col("words").alias("words_a")), "id_a").join(rows.select(F.col("id").alias("id_b"), F.col("words").alias("words_b")), "id_b")
    return full.select("id_a", "id_b", F.size(F.array_intersect("words_a", "words_b")).alias("shared"), F.size(F.array_union("words_a", "words_b")).alias("total"))


def picked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose number ``id`` is among ``ids``.

    64 numbers in a row are one mask, and up to ``MASKS`` masks go to every task, so that long rows stay where they are; more are joined by a shuffle.
    """
    place, bit = F.shiftright("id", 6), lambda: F.expr("shiftleft(1L, CAST(id & 63 AS INT))")
    masks = written(ids.select("id").groupBy(place.alias("_place")).agg(F.bit_or(bit()).alias("_mask")), "masks")
    masks = F.broadcast(masks) if masks.count() <= MASKS else masks
    return rows.join(masks, place == F.col("_place")).where(F.col("_mask").bitwiseAND(bit()) != 0).drop("_place", "_mask")


def tallied(sets: DataFrame) -> np.ndarray:
    """Upper bounds of the numbers of sets that hold a hash: two tables of counts by different bits, of which the smaller count holds."""
    size = SEEN

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(2 * size, np.int64)
        for words in (batch.column("words").slice(i, 2000) for batch in batches for i in range(0, batch.num_rows, 2000)):
            for at in places(words.flatten().to_numpy(zero_copy_only=False), size):
                n += np.bincount(at, minlength=2 * size)
        found = np.flatnonzero(n)
        for i in range(0, len(found), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(found[i:i + 100_000], pa.int32()), pa.array(n[found[i:i + 100_000]])], names=["at", "n"])

    found = sets.select("words").mapInArrow(tally, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(2 * size, np.uint32)
    n[found["at"].to_numpy()] = np.minimum(found["n"].to_numpy(), 2**32 - 1)
    return n


def places(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of hashes in two tables of ``size`` counts, a power of two, that lie one behind the other."""
    return hashes & (size - 1), ((hashes >> 24) & (size - 1)) + size


def first_words(sets: DataFrame, alike: float) -> DataFrame:
    """(id, scope, size, before, words): hashes of the first words of each set in the order of rarity, of which sets that are alike share one.

    Rarity is a bound of ``tallied``: any order serves that is the same for all sets.  Words of one set only are left out, ``before`` counts them.
    """
    seen = tallied(sets)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 500) for whole in batches for i in range(0, whole.num_rows, 500)):
            lists = batch.column("words")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            hashes, of = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)
            a, b = places(hashes, len(seen) // 2)
            n = np.minimum(seen[a], seen[b])
            order = np.lexsort((hashes, n, of))
            hashes, n = hashes[order], n[order]
            rank = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            heads = rank < np.repeat(sizes - np.ceil(alike * sizes) + 1, sizes)
            kept = heads & (n > 1)
            counts = np.bincount(of[kept], minlength=len(sizes))
            words = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]), pa.array(hashes[kept])).cast(pa.list_(pa.int64()))
            before = pa.array(np.bincount(of[n <= 1], minlength=len(sizes)), pa.int32())
            out = pa.RecordBatch.from_arrays([batch.column("id"), batch.column("scope"), batch.column("size"), before, words], names=["id", "scope", "size", "before", "words"])
            yield out.filter(pa.array(counts > 0))

    return sets.mapInArrow(cut, "id long, scope long, size int, before int, words array<long>")


def lots(n: int) -> int:
    """Four lots, one after the other, where more than ``LOT`` rows are exchanged, so a quarter of them lies on disk at a time."""
    return 4 if n > LOT else 1


def ties(rows: DataFrame, alike: float, scope: str, only: DataFrame | None = None, words: Column | None = None) -> DataFrame:
    """(src, dst): links between rows (id, words or what ``words`` makes without repeats, group, scope) that reach what the links of all pairs from ``alike`` on reach.

    Rows meet within a group and a scope; those whose scope is null meet all of the group; with ``only`` (id) just those rows.  First each
    row is compared with one other that shares most of a few of its first words; pairs that these links join already are compared no more, so a
    group of many copies that are alike costs a link each instead of one a pair.  Words travel as hashes of the first ones; whole sets do for pairs only.
    """
    loose = alike - 1e-6
    words = F.array_distinct("words") if words is None else words
    hashes = F.transform(words, lambda w: F.xxhash64(w, F.col("group")))
    some = rows if only is None else picked(rows, only)
    sets = some.select("id", F.when(F.col(scope).isNotNull(), F.xxhash64(scope)).alias("scope"), hashes.alias("words")).withColumn("size", F.size("words"))
    heads = written(first_words(sets, loose), "prefixes")

    def joined(pairs: DataFrame, of: DataFrame) -> DataFrame:
        """Pairs with the columns of both their rows."""
        mine = picked(of, pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")))
        a, b = (mine.select(*[F.col(c).alias(f"{c}_{x}") for c in of.columns]) for x in "ab")
        return pairs.join(a, "id_a").join(b, "id_b")

    def likely(pairs: DataFrame) -> DataFrame:
        """Pairs whose first words agree enough: what two sets share beyond those of both is in the rest of the one whose first words end earlier."""
        both = joined(pairs, heads.select("id", "size", "words"))
        shared = F.size(F.array_intersect("words_a", "words_b")) + F.size("words_a") - F.size(F.array_distinct("words_a"))  # words of one hash count as shared
        most = shared + F.greatest(F.ceil(loose * F.col("size_a")), F.ceil(loose * F.col("size_b"))) - 1
        return both.where(most >= loose / (1 + loose) * (F.col("size_a") + F.col("size_b")) - 1e-3).select("id_a", "id_b")

    def alike_words(pairs: DataFrame) -> DataFrame:
        both = overlaps(pairs, picked(rows, pairs.select(F.explode(F.array("id_a", "id_b")).alias("id"))).select("id", words.alias("words")))
        return both.where(F.round(F.col("shared") / F.col("total"), 6) >= alike).select("id_a", "id_b")

    def good(pairs: DataFrame) -> DataFrame:
        for check in (likely, alike_words):
            k = lots(pairs.count())
            pairs = reduce(DataFrame.unionByName, [freed(written(check(pairs.where(F.pmod(F.xxhash64("id_b"), F.lit(k)) == lot)), check.__name__)) for lot in range(k)])
        return pairs.select(F.col("id_a").alias("src"), F.col("id_b").alias("dst"))

    few = heads.select("id", "scope", "size", F.least(F.lit(FEW), F.size("words")).alias("held"), F.explode(F.slice(F.sort_array("words"), 1, FEW)).alias("word"))
    firsts = few.groupBy("word", "scope").agg(F.min(F.struct("id", "size")).alias("f"), F.max("id").alias("last")).where("f.id < last")
    near = F.least("size", "f.size") >= loose * F.greatest("size", "f.size")
    same = (few["word"] == firsts["word"]) & few["scope"].eqNullSafe(firsts["scope"])
    named = few.join(firsts, same).where((F.col("id") != F.col("f.id")) & near).groupBy("id", "held", F.col("f.id").alias("other")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * 4 >= F.col("held"))
    named = named.groupBy("id").agg(F.max_by("other", F.struct("n", "other")).alias("other"))
    stars = good(freed(written(named.select(F.col("other").alias("id_a"), F.col("id").alias("id_b")), "named")))

    parts = written(graph.connected(stars), "parts")
    bare = heads
    heads = freed(written(bare.join(parts, F.col("id") == F.col("node"), "left").withColumn("part", F.coalesce("component", "id")).drop("node", "component"), "prefixes"))
    removed(bare)
    size = heads.agg(F.sum(F.size("words")), F.count_if(F.col("scope").isNull()), F.count("scope")).first()
    k, mixed, found = lots((size[0] or 0) // 100), bool(size[1] and size[2]), []
    for lot in range(k):
        each = heads.select("id", "scope", "size", "part", "before", F.posexplode("words").alias("at", "word")).where(F.pmod("word", F.lit(k)) == lot)
        each = each.withColumn("at", F.col("before") + F.col("at") + 1).drop("before")
        open_words = each.groupBy("word").agg(F.min("part").alias("_a"), F.max("part").alias("_z")).where("_a < _z").select("word")
        each = freed(written(each.join(open_words, "word", "left_semi"), "open-prefixes"))
        a, b = (each.select("word", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "scope", "size", "at", "part")]) for x in "ab")
        # sets that are alike share ``least`` words at least before the place from which the rest cannot hold all others that they must share
        must = loose / (1 + loose) * (F.col("size_a") + F.col("size_b"))
        least = F.greatest(F.lit(1), F.least(F.lit(SHARED), F.floor(must - F.ceil(loose * F.greatest("size_a", "size_b")) + 1))).cast("int")
        may = (F.col("part_a") != F.col("part_b")) & (F.least("size_a", "size_b") >= loose * F.greatest("size_a", "size_b")) & (least + F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b")) >= must - 1e-3)
        met = lambda x, y, on: x.join(y, (x["word"] == y["word"]) & on).where(may).select("id_a", "id_b", least.alias("least"))  # noqa: E731, B023
        pairs = met(a, b, F.col("scope_a").eqNullSafe(F.col("scope_b"))).where("id_a < id_b")
        if mixed:
            pairs = pairs.unionByName(met(a.where("scope_a IS NULL"), b.where("scope_b IS NOT NULL"), F.lit(True)))
        # words lie in one lot each, so what shares ``least`` shares a k-th of that in one lot
        pairs = pairs.groupBy("id_a", "id_b", "least").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * k >= F.col("least"))
        found.append(freed(written(pairs.select("id_a", "id_b"), "candidates")))
        removed(each)
    more = good(freed(written(reduce(DataFrame.unionByName, found).distinct(), "candidates")))
    removed(heads)
    return stars.unionByName(more)
