"""Scoring formulas as column expressions; time is always a parameter."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
RRF_K = 60

# How lasting a kind of memory is by itself; others count 0.5.
TYPE_WEIGHTS = {"architecture": 0.9, "preference": 0.85, "pattern": 0.8, "bug": 0.7, "workflow": 0.6, "fact": 0.5}
OTHER_TYPE = 0.5


def age_days(ts: Column, now: Column) -> Column:
    """Fractional days from ``ts`` to ``now``; works for timestamps with and without zone."""
    seconds = lambda t: F.unix_micros(t.cast("timestamp")) / 1e6
    return (seconds(now) - seconds(ts)) / 86400.0


def quotient(a: Column, b: Column) -> Column:
    """As doubles divide: by zero gives infinity, zero by zero no number."""
    return F.when(b == 0, F.signum(a) * F.lit(float("inf"))).otherwise(a / F.nullif(b, F.lit(0.0)))


def bm25(tf: Column, length: Column, df: Column, n: Column, average: Column) -> Column:
    idf = F.log((n - df + 0.5) / (df + 0.5) + 1)
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ, a norm is zero or a vector is null."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm), F.lit(0.0))


def recency(ts: Column, now: Column) -> Column:
    """1 for today, the future or a missing time, falling to 0.6 with a half-life of 180 days."""
    days = F.floor(age_days(ts, now))
    return F.when(ts.isNull() | (days <= 0), 1.0).otherwise(0.6 + 0.4 * F.pow(F.lit(0.5), days / 180.0))


def salience(kind: Column, confidence: Column, uses: Column) -> Column:
    by_type = F.lit(OTHER_TYPE)
    for name, weight in TYPE_WEIGHTS.items():
        by_type = F.when(kind == name, weight).otherwise(by_type)
    base = F.greatest(by_type, F.coalesce(confidence, F.lit(0.0)))
    return F.least(F.lit(1.0), base + F.least(F.lit(0.2), 0.02 * F.coalesce(uses, F.lit(0))))


def retention(salience_: Column, days: Column, recent: Column, decay: float = 0.01, boost: float = 0.3) -> Column:
    """``recent``: the sum of 1 / days since each recent access."""
    return F.least(F.lit(1.0), salience_ * F.exp(-decay * days) + boost * recent)


def tier(score: Column, hot: float = 0.7, warm: float = 0.4, cold: float = 0.15) -> Column:
    return F.when(score >= hot, "hot").when(score >= warm, "warm").when(score >= cold, "cold").otherwise("evictable")


def weekly_decay(confidence: Column, rate: Column, weeks: Column) -> Column:
    return F.round(F.greatest(F.lit(0.05), confidence - rate * weeks), 3)


def periodic_decay(strength: Column, periods: Column) -> Column:
    return F.greatest(F.lit(0.1), strength * F.pow(F.lit(0.9), periods))


def reinforced(confidence: Column) -> Column:
    return F.least(F.lit(1.0), confidence + 0.1 * (1 - confidence))


def core_entry(importance: Column, days: Column, uses: Column) -> Column:
    """An access ten days ahead of now scores infinity, as nothing divides it."""
    return 0.5 * importance / 10 + quotient(F.lit(0.3), 1 + 0.1 * days) + 0.2 * F.log2(uses + 1.0) / 10


def aged(confidence: Column, share: Column, days: Column) -> Column:
    """Confidence times the matched share of a query, fading by a hundredth a day."""
    return quotient(confidence * share, 1 + 0.01 * days)


def edge_cost(weight: Column) -> Column:
    return 1 / F.greatest(weight, F.lit(0.01))


def relation_confidence(shared_sessions: Column, days: Column, other_days: Column, kind: Column) -> Column:
    """Half, more for sessions in common and fresh pairs, less for old ones and contradictions; 0 to 1."""
    age = F.when((days < 7) & (other_days < 7), 0.1).when((days > 90) & (other_days > 90), -0.1).otherwise(0.0)
    kinds = F.when(kind == "supersedes", 0.1).when(kind == "contradicts", -0.05).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + F.least(0.1 * shared_sessions, F.lit(0.3)) + age + kinds))
