r"""Ranked lexical search of every item of a query set over all documents: a threshold-seeded join.

Items are taken in blocks of about ``BLOCK_BYTES`` of text, so what every task holds of
them is bounded; each block meets all documents.

1. One scan of the texts leaves, for every document, its length and the counts of the
   block's terms in it (written once).  Frequencies and weights follow.
2. Per-term stored impacts: the ``k`` highest impacts of every term, with their
   documents.  The kth impact of any of its terms is a lower bound of an item's kth
   score; the exact scores of the stored documents of its terms raise that threshold.
3. Suffix bounds: an item's terms are ordered by their highest possible share of a score.
   Where the shares from a term on add up to less than the threshold, documents that hold none of
   the terms before can't enter; only the terms before generate candidates.
4. Candidates come from a join of generating terms with postings, and go as soon as what they have
   and the bound of what is left fall short of the threshold.  The others are exactly
   rescored, and those that reach the threshold are ranked.

Every bound is safe, with ties kept, so results are those of scoring all pairs.
Scores are integers; see ``impacts``.

Defined results: null texts have no terms; documents without terms are neither counted
nor found, and items without terms find nothing; every row is a document or an item of its
own, also where ids repeat or are null; equal scores go by ascending id (nulls last), then by row; empty
tables give an empty result; texts of any length are counted whole, in pieces; other columns are not read.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")  # in UTF-8, what the pattern of characters leaves
GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
PIECE = 1 << 22
BLOCK_BYTES = 8 << 20
MOST_PAIRS = 1 << 18


def term_counts(text: str | None) -> Counter[bytes]:
    """Terms of a text, A-Z lower-cased; long texts are cut between terms."""
    data, out, at = (text or "").encode().lower(), Counter(), 0
    while at < len(data):
        gap = GAP.search(data, at + PIECE) if at + PIECE < len(data) else None
        end = gap.start() if gap else len(data)
        out.update(TERM.findall(data[at:end]))
        at = end
    return out


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(w: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return w * (1_000_000_000 * tf // (1000 * tf + 8 * m))


@dataclass
class Block:
    """Items of a block: entries (term, times) item by item, and what is known of terms."""

    items: list[int]
    terms: list[bytes]
    first: np.ndarray  # entries of item i: first[i] to first[i + 1]
    tid: np.ndarray
    times: np.ndarray
    w: np.ndarray | None = None
    threshold: np.ndarray | None = None
    gen_end: np.ndarray | None = None  # entries before it generate candidates
    near_end: np.ndarray | None = None  # entries before it are counted before candidates are rescored
    gen_rest: np.ndarray | None = None  # the most that entries from gen_end, near_end on can add
    near_rest: np.ndarray | None = None

    @staticmethod
    def of(rows: list[tuple[int, str | None]]) -> Block:
        counts = [term_counts(text) for _, text in rows]
        terms = sorted(set().union(*counts))
        place = {t: i for i, t in enumerate(terms)}
        flat = [(place[t], c) for counted in counts for t, c in counted.items()]
        tid, times = (np.array(x, np.int64) for x in (zip(*flat, strict=True) if flat else ((), ())))
        return Block([i for i, _ in rows], terms, np.cumsum([0, *map(len, counts)]), tid, times)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.items)), np.diff(self.first))

    def ordered(self, most: np.ndarray, kth: np.ndarray) -> None:
        """Sorts the entries of every item by their bound and seeds its threshold with the best kth impact of a term."""
        owner, bound = self.owner(), self.times * most[self.tid]
        order = np.lexsort((self.tid, -bound, owner))
        self.tid, self.times = self.tid[order], self.times[order]
        self.threshold = np.zeros(len(self.items), np.int64)
        np.maximum.at(self.threshold, owner, self.times * kth[self.tid])

    def pruned(self, most: np.ndarray) -> None:
        """Where the suffix bound of every item falls below its threshold, and below half of it."""
        bound, n = self.times * most[self.tid], len(self.items)
        self.gen_end, self.near_end, self.gen_rest, self.near_rest = (np.zeros(n, np.int64) for _ in range(4))
        for i in range(n):
            a, b = self.first[i], self.first[i + 1]
            suffix = np.append(np.cumsum(bound[a:b][::-1])[::-1], 0)
            gen = int(np.argmax(np.append(suffix[:-1] < self.threshold[i], True)))
            near = int(np.argmax(np.append(2 * suffix[:-1] < self.threshold[i], True)))
            self.gen_end[i], self.near_end[i], self.gen_rest[i], self.near_rest[i] = a + gen, a + near, suffix[gen], suffix[near]


class Postings:
    """The counts of a batch of documents, as flat arrays ordered by row and term."""

    def __init__(self, block: Block, m: np.ndarray, tids: pa.ListArray, tfs: pa.ListArray):
        self.block = block
        self.start = np.append(0, np.cumsum(tids.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
        self.tid, tf = (x.flatten().to_numpy().astype(np.int64) for x in (tids, tfs))
        self.row = np.repeat(np.arange(len(m)), np.diff(self.start))
        self.impact = impacts(block.w[self.tid], tf, m[self.row])
        self.key = self.row * len(block.terms) + self.tid

    def gained(self, row: np.ndarray, item: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """What the entries start to end of an item add to its score of a row, for pairs (row, item)."""
        size = end - start
        at = np.append(0, np.cumsum(size))
        entry = np.repeat(start - at[:-1], size) + np.arange(at[-1])
        key = np.repeat(row, size) * len(self.block.terms) + self.block.tid[entry]
        place = np.searchsorted(self.key, key)
        place[place == len(self.key)] = 0
        hit = self.key[place] == key if len(self.key) else np.zeros(len(key), bool)
        value = np.where(hit, self.block.times[entry] * self.impact[place], 0) if len(self.key) else np.zeros(len(key), np.int64)
        total = np.append(0, np.cumsum(value))  # differences are right even where the sum wraps around
        return total[at[1:]] - total[at[:-1]]

    def scores(self, row: np.ndarray, item: np.ndarray) -> np.ndarray:
        first = self.block.first
        return self.gained(row, item, first[item], first[item + 1])

    def generated(self, inverse: tuple[np.ndarray, np.ndarray, np.ndarray], rows: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, score so far) of candidates among rows: pairs that share a generating term."""
        ptr, items, times = inverse
        a, b = self.start[rows.start], self.start[rows.stop]
        tid = self.tid[a:b]
        size = ptr[tid + 1] - ptr[tid]
        at = np.append(0, np.cumsum(size))
        entry = np.repeat(ptr[tid] - at[:-1], size) + np.arange(at[-1])
        pair = np.repeat(self.row[a:b], size) * len(self.block.items) + items[entry]
        value = np.repeat(self.impact[a:b], size) * times[entry]
        order = np.argsort(pair, kind="stable")
        pair, total = pair[order], np.append(0, np.cumsum(value[order]))
        opens = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
        found = pair[opens]
        return found // len(self.block.items), found % len(self.block.items), total[np.append(opens[1:], len(pair))[: len(opens)]] - total[opens]

    def found(self, inverse: tuple[np.ndarray, np.ndarray, np.ndarray], sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, item, exact score) of all pairs that reach the thresholds."""
        block, first, at = self.block, self.block.first, 0
        load = np.append(0, np.cumsum(sizes[self.tid]))[self.start]  # pairs to come before each row
        while at < len(self.start) - 1:
            stop = max(at + 1, int(np.searchsorted(load, load[at] + MOST_PAIRS, "right")) - 1)
            row, item, score = self.generated(inverse, slice(at, stop))
            keep = score + block.gen_rest[item] >= block.threshold[item]
            row, item, score = row[keep], item[keep], score[keep]
            score = score + self.gained(row, item, block.gen_end[item], block.near_end[item])
            keep = score + block.near_rest[item] >= block.threshold[item]
            row, item = row[keep], item[keep]
            score = score[keep] + self.gained(row, item, block.near_end[item], first[item + 1])
            keep = (score >= block.threshold[item]) & (score > 0)
            yield row[keep], item[keep], score[keep]
            at = stop


def counted(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(doc, doc_id, n, tids, tfs) of every document with a term: its length, and its counts of ``terms`` by place, ascending."""
    sent = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                n, ends, tids, tfs = [], [0], [], []
                for text in batch.column(2):
                    found = term_counts(text.as_py())
                    mine = sorted((place[t], c) for t, c in found.items() if t in place)
                    n.append(sum(found.values()))
                    tids.extend(t for t, _ in mine)
                    tfs.extend(c for _, c in mine)
                    ends.append(len(tids))
                arrays = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tids, pa.int32())),
                          pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tfs, pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc", "doc_id", "n", "tids", "tfs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text")
    return written(rows.mapInArrow(count, f"doc long, doc_id {kind}, n long, tids array<int>, tfs array<int>").where("n > 0"), "term-counts")


def best_impacts(rows: DataFrame, w: DataFrame, k: int) -> DataFrame:
    """(tid, place, impact, doc): the k highest impacts of every term. ``w`` (tid, w) has the terms of one block."""
    postings = rows.select("doc", "m", F.explode(F.arrays_zip("tids", "tfs")).alias("p")).select("doc", "m", "p.tids", F.col("p.tfs").cast("long").alias("tf"))
    scored = postings.join(F.broadcast(w), postings["tids"] == w["tid"]).select("tid", "doc", F.expr("w * ((1000000000L * tf) div (1000L * tf + 8L * m))").alias("impact"))
    order = Window.partitionBy("tid").orderBy(F.col("impact").desc(), "doc")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def seed_scores(rows: DataFrame, best: DataFrame, block: Block, k: int) -> np.ndarray:
    """The kth best exact score of every item among the stored documents of its terms; 0 if there are fewer."""
    spark = rows.sparkSession
    entries = spark.createDataFrame(pd.DataFrame({"item": block.owner(), "tid": block.tid}), "item int, tid int")
    pairs = entries.join(best.select("tid", "doc"), "tid").groupBy("doc").agg(F.collect_set("item").alias("items"))
    sent = spark.sparkContext.broadcast(block)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                m, tids, tfs, items = whole.slice(at, 500).columns
                posts = Postings(sent.value, m.to_numpy(), tids, tfs)
                row = np.repeat(np.arange(len(m)), items.value_lengths().to_numpy(zero_copy_only=False))
                item = items.flatten().to_numpy().astype(np.int64)
                for a in range(0, len(item), MOST_PAIRS):
                    part = slice(a, a + MOST_PAIRS)
                    yield pa.RecordBatch.from_arrays([pa.array(item[part], pa.int32()), pa.array(posts.scores(row[part], item[part]), pa.int64())], ["item", "score"])

    scored = rows.select("doc", "m", "tids", "tfs").join(pairs, "doc").select("m", "tids", "tfs", "items").mapInArrow(score, "item int, score long")
    kth = scored.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc()))).where(F.col("place") == k)
    out = np.zeros(len(block.items), np.int64)
    for r in kth.select("item", "score").collect():  # one row for each item of the block at most
        out[r["item"]] = r["score"]
    return out


def candidates(rows: DataFrame, block: Block) -> DataFrame:
    """(item, doc_id, doc, score): all pairs whose exact score reaches the threshold of the item."""
    owner = block.owner()
    generating = np.flatnonzero(np.arange(len(block.tid)) < block.gen_end[owner])
    generating = generating[np.argsort(block.tid[generating], kind="stable")]
    ptr = np.searchsorted(block.tid[generating], np.arange(len(block.terms) + 1))
    sent = rows.sparkSession.sparkContext.broadcast((block, (ptr, owner[generating], block.times[generating])))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, inverse = sent.value
        keys, sizes = np.array(held.items, np.int64), np.diff(inverse[0])
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                doc, doc_id, m, tids, tfs = batch.columns
                for row, item, score in Postings(held, m.to_numpy(), tids, tfs).found(inverse, sizes):
                    take = pa.array(row, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(keys[item], pa.int64()), doc_id.take(take), doc.take(take), pa.array(score, pa.int64())], ["item", "doc_id", "doc", "score"])

    return rows.select("doc", "doc_id", "m", "tids", "tfs").mapInArrow(match, f"item long, doc_id {kind}, doc long, score long")


def search_block(docs: DataFrame, block: Block, k: int) -> DataFrame:
    spark = docs.sparkSession
    rows = counted(docs, block.terms)
    n, length = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
    rows = rows.withColumn("m", F.expr(f"25L + (75L * n * {n}L) div {length or 1}L"))
    df = np.zeros(len(block.terms), np.int64)
    for r in rows.select(F.explode("tids").alias("tid")).groupBy("tid").count().collect():  # terms of the block at most
        df[r["tid"]] = r["count"]
    block.w = np.array([weight(n, int(x)) for x in df], np.int64)
    w = spark.createDataFrame(pd.DataFrame({"tid": np.arange(len(df)), "w": block.w}), "tid int, w long")
    best = written(best_impacts(rows, w, k), "best-impacts")
    most, kth = np.zeros(len(df), np.int64), np.zeros(len(df), np.int64)
    for r in best.groupBy("tid").agg(F.max("impact").alias("most"), F.max(F.when(F.col("place") == k, F.col("impact"))).alias("kth")).collect():
        most[r["tid"]], kth[r["tid"]] = r["most"], r["kth"] or 0
    block.ordered(most, kth)
    block.threshold = np.maximum(block.threshold, seed_scores(rows, best, block, k))
    block.pruned(most)
    return candidates(rows, block)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", query: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of every item with the highest scores above 0."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    asked = written(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), F.col(query).alias("text")), "items")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    found = None
    for b in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == b).select("item", "text").collect()
        block = Block.of([tuple(r) for r in rows])
        if len(block.tid):
            part = search_block(docs, block, k)
            found = part if found is None else found.unionByName(part)
    if found is None:
        kinds = dict(asked.dtypes) | dict(docs.dtypes)
        return docs.sparkSession.createDataFrame([], f"item_id {kinds['item_id']}, rank int, doc_id {kinds['doc_id']}, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "doc")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, {TERMS} AS t FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS total FROM d WHERE len(t) > 0),
p AS (SELECT doc, doc_id, n, term, count(*) AS tf FROM (SELECT doc, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
i AS (SELECT row_number() OVER () AS item, item_id, {TERMS} AS t FROM benchmark),
q AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(t) AS term FROM i) GROUP BY ALL),
c AS (SELECT item, item_id, doc, doc_id, (sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // total)))))::BIGINT AS score
 FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, doc) AS rank FROM c WHERE score > 0) WHERE rank <= 10
"""
