"""Language identification by prediction by partial matching over bytes.

Training builds, for each language, a byte context tree up to ``depth`` bytes
deep from a bounded sample (``per_language`` documents of each language: ids fall into
``SALTS`` groups by hash, and each group gives those with the smallest hash).  A byte costs -log2 of its share in the
longest context that the tree knows, or an escape and its cost in the next
shorter one; statistics stay frozen.  A text's exact code length is the sum over
its bytes, and the language with the shortest code wins.  The score is the
posterior share of the winner.

All costs are laid out once as a table (context, byte) -> cost in each language,
so scoring is array look-ups.  Bytes that training never saw share one symbol.

Defined results: null texts and texts without a letter are ``und`` with score 0;
with nothing to learn from, every text is; ties go to the language first by name.  Each row
is scored by itself, also where it repeats another or has no id; texts of any length are scored whole, in
chunks; an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fold_bucket, table

LETTER = re.compile(r"[^\W\d_]").search
DEPTH = 3
PER_LANGUAGE = 416
SALTS = 32
CHUNK = 1 << 19


@dataclass
class ContextTrees:
    languages: list[str]
    symbol: np.ndarray  # byte -> symbol; 0 stands for unknown bytes and the text's start
    size: int  # number of symbols
    state: np.ndarray  # the last three symbols as a number -> context row
    cost: np.ndarray  # (context row * size + symbol, language) -> bits


def code_costs(grams: dict[int, np.ndarray], size: int, depth: int, known: list[np.ndarray]) -> list[np.ndarray]:
    """For one language: bits of (context row, symbol) for each order; known[o] are the context numbers of order o."""
    table_below = np.full((1, size), np.log2(size))
    out = []
    for order in range(depth + 1):
        contexts = known[order]
        counts = np.zeros((len(contexts), size))
        number, n = grams[order]
        counts[np.searchsorted(contexts, number // size), number % size] = n
        total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
        if order == 0:
            shorter = np.repeat(table_below, len(contexts), 0)
        else:
            shorter = out[-1][np.searchsorted(known[order - 1], contexts % size ** (order - 1))]
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = -np.log2(counts / (total + kinds))
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
        out.append(np.where(counts > 0, seen, escape + shorter))
    return out


def _symbols(values: list[bytes], symbol: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts one after the other, ``depth`` zeros before each; places where each text begins."""
    pad = bytes(depth)
    sizes = np.array([len(v) for v in values])
    begins = np.cumsum(sizes + depth) - sizes
    joined = np.frombuffer(b"".join([x for v in values for x in (pad, v)]), np.uint8)
    s = symbol[joined].astype(np.int64)
    for k in range(1, depth + 1):
        s[begins - k] = 0
    return s, begins


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, depth: int = DEPTH) -> ContextTrees | None:
    """Learn from the labelled documents given; leave held-out ones out before."""
    first = Window.partitionBy("_lang", F.pmod(F.xxhash64("_id"), F.lit(SALTS))).orderBy(F.xxhash64(F.lit(1), "_id"), "_id")
    ids = (docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(lang).alias("_lang")).distinct()
           .withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= -(-per_language // SALTS)).drop("_n"))
    chosen = docs.where(F.col(lang).isNotNull()).join(F.broadcast(ids), (docs[doc_id] == F.col("_id")) & (docs[lang] == F.col("_lang"))).select("_id", "_lang", docs[text].alias("_text"))
    chosen = chosen.groupBy("_id", "_lang").agg(F.min("_text").alias("_text")).select("_lang", "_text")  # of repeated rows one

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of byte grams of every order, packed as numbers of base 256."""
        for batch in batches:
            names, values = np.array(batch.column(0).to_pylist()), pc.cast(batch.column(1), pa.binary()).to_pylist()
            for name in np.unique(names):
                mine = [values[i] for i in np.flatnonzero(names == name)]
                s, begins = _symbols(mine, np.arange(256), depth)
                inside = np.ones(len(s), bool)
                for k in range(1, depth + 1):
                    inside[begins - k] = False
                at = np.flatnonzero(inside)
                number = s[at].copy()
                for order in range(depth + 1):
                    if order:
                        number = number + s[at - order] * 256**order
                    keys, n = np.unique(number, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array([order] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["lang", "ord", "gram", "n"])

    rows = chosen.mapInArrow(count, "lang string, ord int, gram long, n long").groupBy("lang", "ord", "gram").agg(F.sum("n").alias("n")).toPandas()
    if rows.empty:
        return None
    return trees(rows["lang"].to_numpy(), rows["ord"].to_numpy(), rows["gram"].to_numpy(), rows["n"].to_numpy(), depth)


def trees(lang: np.ndarray, order: np.ndarray, gram: np.ndarray, n: np.ndarray, depth: int = DEPTH) -> ContextTrees:
    """Frozen trees from counts of byte grams."""
    seen = np.unique(gram[order == 0])
    seen = seen[seen > 0]
    symbol = np.zeros(256, np.int32)
    symbol[seen] = np.arange(1, len(seen) + 1)
    size = len(seen) + 1
    number = np.zeros(len(gram), np.int64)
    for k in range(depth + 1):
        number += np.where(k <= order, symbol[(gram >> (8 * k)) & 255].astype(np.int64) * size**k, 0)
    known = [np.unique(number[order == o] // size) for o in range(depth + 1)]
    languages = sorted(set(lang.tolist()))
    costs = []
    for name in languages:
        mine = lang == name
        grams = {}
        for o in range(depth + 1):
            pick = mine & (order == o)
            keys, inverse = np.unique(number[pick], return_inverse=True)
            grams[o] = (keys, np.bincount(inverse, weights=n[pick], minlength=len(keys)))
        costs.append(np.concatenate(code_costs(grams, size, depth, known)))
    offset = np.concatenate([[0], np.cumsum([len(k) for k in known])])
    state = np.zeros(size**depth, np.int32)
    for o in range(1, depth + 1):  # longer contexts overwrite shorter ones
        width = size ** (depth - o)
        rows = (np.arange(width)[:, None] * size**o + known[o][None, :]).ravel()
        state[rows] = np.tile(np.arange(offset[o], offset[o + 1]), width)
    return ContextTrees(languages, symbol, size, state, np.stack(costs, axis=-1).reshape(-1, len(languages)).astype(np.float32))


def code_lengths(model: ContextTrees, values: list[bytes], depth: int = DEPTH) -> np.ndarray:
    """Bits of each text (at least one byte long) in each language; long texts go in chunks."""
    out = np.zeros((len(values), len(model.languages)))
    start = 0
    while start < len(values):
        end, total = start, 0
        while end < len(values) and (end == start or total + len(values[end]) <= CHUNK):
            total += len(values[end])
            end += 1
        s, begins = _symbols(values[start:end], model.symbol, depth)
        sizes = np.array([len(v) for v in values[start:end]])
        owner = np.repeat(np.arange(end - start), sizes)
        at = np.arange(total) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
        for lo in range(0, total, CHUNK):
            p = at[lo : lo + CHUNK]
            context = s[p - depth]
            for k in range(depth - 1, 0, -1):
                context = context * model.size + s[p - k]
            bits = model.cost[model.state[context].astype(np.int64) * model.size + s[p]]
            mine = owner[lo : lo + CHUNK]
            cuts = np.flatnonzero(np.diff(mine, prepend=-1))
            out[start + mine[cuts]] += np.add.reduceat(bits.astype(np.float64), cuts, axis=0)
        start = end
    return out


def predict(docs: DataFrame, model: ContextTrees | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with lang_pred, score and bits (code length of the winner)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", lang_pred string, score double, bits double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            lang, score, bits = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
            at = [i for i, v in enumerate(texts) if v and LETTER(v)] if m is not None else []
            if at:
                lengths = code_lengths(m, [texts[i].encode() for i in at])
                best = lengths.argmin(1)
                low = lengths[np.arange(len(at)), best]
                share = 1.0 / np.exp2(np.clip(low[:, None] - lengths, -1000, 0)).sum(1)
                for j, i in enumerate(at):
                    lang[i], score[i], bits[i] = m.languages[best[j]], float(share[j]), float(low[j])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], names=[*keep, "lang_pred", "score", "bits"])

    return docs.select(*keep, docs[text].alias("_text")).mapInArrow(run, schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(fold_bucket("doc_id", 4) != 2))
    return predict(docs, model).select("doc_id", (fold_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
