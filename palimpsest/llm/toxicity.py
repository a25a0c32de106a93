"""Toxic passages as maximum-scoring segments of token log-odds.

Training counts in how many labelled documents of each class a token occurs.  A
token is a whole word or a word's first four to six letters, so that inflected
forms share what is known of their stem.  Every token gets the log-odds of its
two class rates under an informative Dirichlet prior (the pooled rates, ``prior``
times the corpus strong).  A word scores as its longest significant token; words
without one are neutral and cost ``drift``.  One linear pass over a text finds
all maximal scoring segments.  The best scores that clean texts of n words reach
by chance follow an extreme-value law, whose two parameters are fitted on clean
training documents by quartiles, which mislabelled ones hardly move; what segments
score beyond that law is summed for a document, put on a logarithmic scale and
mapped to 0..1 by a logistic curve fitted on the same training documents.

Bound: at most ``max_rows`` labelled documents are learned from, those with the
smallest hash of their id; the tokens kept are a part of theirs.  Labels, language,
source and id never enter a score.

Defined results: null or empty texts get the score of a text without segments;
with no labelled row of a class every score is below 0.5; repeated labels of a
document count once, toxic if any is; null labels and labels without an id are left
out.  Of repeated document ids the smallest text is learned from; every document
row, repeated or without an id, gets a row of its own.  Texts of any length are read
whole, in time proportional to their length; of equal passages each one counts.  An
empty table gives no rows.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_bucket, sent, table, tidy, values

WORD = re.compile(r"[^\W\d_]+").findall
STEMS = (6, 5, 4)  # letters of a word's beginning that count as a token, longest first
ALPHA = 0.01
NONE = 8.0  # what a text without segments lacks
REMEMBERED = 100_000  # words whose score a Python worker keeps


@dataclass(frozen=True)
class Settings:
    max_rows: int = 20_000
    prior: float = 0.05
    min_z: float = 3.5
    drift: float = 0.05


@dataclass
class ToxicModel:
    weight: dict[str, float]
    drift: float
    rate: float  # of the extreme-value law
    base: float
    intercept: float
    slope: float

    def __post_init__(self):
        self.known: dict[str, float | None] = {}

    def word_score(self, word: str) -> float | None:
        """Log-odds of the longest significant token of a word."""
        w = self.weight.get(word)
        if w is None:
            w = next((x for k in STEMS if len(word) > k and (x := self.weight.get(word[:k] + "*")) is not None), None)
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[word] = w
        return w

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens and the maximal scoring segments (first, last token, score)."""
        tokens = WORD(text.lower()) if text else []
        known, score = self.known, self.word_score
        scores = [known[t] if t in known else score(t) for t in tokens]
        return len(tokens), maximal_segments([(i, w) for i, w in enumerate(scores) if w is not None], self.drift)

    def floor(self, n: int) -> float:
        """The best normalised score that chance is expected to give n words."""
        return max(0.0, self.base + math.log(max(n, 1)))

    def significant(self, n: int, segments: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
        """Segments that a clean text of n words reaches by chance with a probability of about ALPHA at most."""
        return [s for s in segments if self.rate * s[2] > self.floor(n) - math.log(ALPHA)]

    def evidence(self, n: int, scores: list[float]) -> float:
        """Summed excess of the significant segments, or what the best one lacks, on a logarithmic scale either way."""
        floor = self.floor(n)
        beyond = [self.rate * s - floor for s in scores] or [-NONE]
        x = sum(b for b in beyond if b > 0) or max(beyond)
        return math.copysign(math.log1p(abs(x)), x)

    def score(self, n: int, segments: list[tuple[int, int, float]]) -> float:
        x = self.intercept + self.slope * self.evidence(n, [s[2] for s in segments])
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, x))))


def maximal_segments(scored: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments in one pass; tokens between the scored ones cost ``drift`` each.

    Candidates are kept with the running total before and after them and the place
    of the nearest earlier candidate that starts lower.  A new one joins back to
    that candidate if it ends lower too.  Whatever lies between a candidate and its
    link starts no lower than the candidate, so a search steps along links and every
    link is passed once.
    """
    kept: list[tuple[int, int, float, float, int]] = []  # first, last, total before, total after, link
    total, last = 0.0, -1
    for i, w in scored:
        total -= drift * (i - last - 1)
        before, total, last = total, total + w, i
        if w <= 0:
            continue
        first, low, k = i, before, len(kept) - 1
        while True:
            while k >= 0 and kept[k][2] >= low:
                k = kept[k][4]
            if k < 0 or kept[k][3] >= total:
                break
            first, _, low, _, link = kept[k]
            del kept[k:]
            k = link
        kept.append((first, i, low, total, k))
    return [(a, b, after - before) for a, b, before, after, _ in kept]


def tokens_of(text: str | None) -> set[str]:
    own = set(WORD(text.lower())) if text else set()
    return own | {w[:k] + "*" for w in own for k in STEMS if len(w) > k}


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicModel:
    """Learn from the labelled documents given; leave held-out ones out before."""
    spark = docs.sparkSession
    marks = (labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("_toxic"))
             .orderBy(F.xxhash64("_id"), "_id").limit(settings.max_rows))
    rows = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"))
    chosen = rows.join(F.broadcast(marks), F.col("_doc") == F.col("_id")).groupBy("_id").agg(F.max("_toxic").alias("_toxic"), F.min("_text").alias("_text")).select("_toxic", "_text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        found = (Counter(), Counter())
        for batch in batches:
            for toxic, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[1 if toxic else 0].update(tokens_of(value))
        for toxic in (0, 1):
            terms = list(found[toxic])
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([found[toxic][t] * (1 - toxic) for t in terms], pa.int64()), pa.array([found[toxic][t] * toxic for t in terms], pa.int64())], names=["term", "clean", "toxic"])

    counts = chosen.mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    totals = counts.where(~F.col("term").endswith("*")).agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).first()
    n0, n1 = totals["clean"] or 0, totals["toxic"] or 0
    if not n0 or not n1:
        return ToxicModel({}, settings.drift, 1.0, 0.0, -1.0, 0.0)
    a0 = settings.prior * (n0 + n1)
    alpha = (F.col("clean") + F.col("toxic")) * F.lit(settings.prior)
    odds = lambda y, n: F.log(y + alpha) - F.log(F.lit(float(n) + a0) - y - alpha)
    delta = odds(F.col("toxic"), n1) - odds(F.col("clean"), n0)
    spread = F.sqrt(1 / (F.col("toxic") + alpha) + 1 / (F.col("clean") + alpha))
    terms = (counts.select("term", delta.alias("w"), (delta / spread).alias("z")).where(F.abs("z") >= settings.min_z)
             .collect())
    model = ToxicModel({r["term"]: r["w"] for r in terms}, settings.drift, 1.0, 0.0, 0.0, 1.0)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [model.segments(value) for value in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([[s[2] for s in segs] for _, segs in rows], pa.list_(pa.float64()))], names=["toxic", "n", "scores"])

    sample = chosen.mapInArrow(best, "toxic int, n long, scores array<double>").collect()  # max_rows rows at most
    model.rate, model.base = fit_extreme([(r["n"], max(r["scores"], default=0.0)) for r in sample if not r["toxic"]])
    x = np.array([model.evidence(r["n"], r["scores"]) for r in sample])
    model.intercept, model.slope = fit_logistic(x, np.array([float(r["toxic"]) for r in sample]))
    return model


def fit_extreme(rows: list[tuple[int, float]]) -> tuple[float, float]:
    """Rate and base of P(best > s) = 1 - exp(-e^base n e^(-rate s)) by quartiles, over texts with a segment."""
    rows = [(n, s) for n, s in rows if n > 0 and s > 0]
    if len(rows) < 20:
        return 1.0, 0.0
    s = np.array([s for _, s in rows])
    logs = np.log([n for n, _ in rows])
    width = float(np.subtract(*np.quantile(s, [0.75, 0.25])))
    rate = (math.log(math.log(4)) - math.log(math.log(4 / 3))) / max(width, 1e-3)
    rate = min(max(rate, 0.2), 2.0)
    return rate, float(np.median(rate * s - logs)) + math.log(math.log(2))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 200) -> tuple[float, float]:
    """Intercept and slope that minimise the ridge-penalised logistic loss, a convex function.

    Newton steps on the standardised evidence, halved until the loss falls enough, end
    when the gradient is as good as zero; anything else is an error, not a model.
    """
    mean, sd = float(x.mean()), max(float(x.std()), 1e-9)
    d = np.stack([np.ones_like(x), (x - mean) / sd], axis=1)

    def loss(b: np.ndarray) -> float:
        z = d @ b
        return float(np.logaddexp(0, z).sum() - y @ z + ridge * b @ b / 2)

    b = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(d @ b, -500, 500)))
        gradient = d.T @ (p - y) + ridge * b
        if np.abs(gradient).max() <= 1e-6 * max(len(x), 1):
            break
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(2), gradient)
        size, now = 1.0, loss(b)
        while loss(b - size * step) > now - 1e-4 * size * float(gradient @ step) and size > 1e-10:
            size /= 2
        b = b - size * step
    else:
        raise ArithmeticError("the logistic curve did not converge")
    return float(b[0] - b[1] * mean / sd), float(b[1] / sd)


def score_documents(docs: DataFrame, model: ToxicModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with score and the significant passages (first and last token, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, place = sent(docs, keep, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", score double, passages array<struct<first:int,last:int,score:double>>"
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores, passages = [], []
            for value in values(batch.column(place)):
                n, segs = m.segments(value)
                scores.append(m.score(n, segs))
                passages.append([{"first": a, "last": b, "score": s} for a, b, s in m.significant(n, segs)])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, pa.float64()), pa.array(passages, kind)], names=[*keep, "score", "passages"])

    return rows.mapInArrow(tidy(run), schema)


def trained_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> ToxicModel:
    labels = table(spark, sf_dir, "labels").where(fold_bucket("doc_id", 5) != 0)
    return train(docs, labels)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, trained_model(spark, docs, sf_dir))
    return scored.select("doc_id", (fold_bucket("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
                         F.size("passages").alias("n_passages"))
