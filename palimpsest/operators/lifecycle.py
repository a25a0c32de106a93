"""Retention, decay, eviction, merging of versions, patches and integrity checks."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import scoring


def recent_access(accesses: DataFrame, key: str, ts: str, now: Column) -> DataFrame:
    """(key, n_access, recent): the sum of 1 / days since each access before ``now``."""
    days = scoring.age_days(F.col(ts), now)
    return accesses.groupBy(key).agg(F.count(F.lit(1)).alias("n_access"), F.sum(F.when(days > 0, 1 / days)).alias("recent"))


def retention_scores(memories: DataFrame, accesses: DataFrame, key: str, kind: Column, confidence: Column, created: str, now: Column) -> DataFrame:
    """(key, score, tier)."""
    rows = memories.join(accesses, key, "left")
    base = scoring.salience(kind, confidence, F.col("n_access"))
    score = F.round(scoring.retention(base, scoring.age_days(F.col(created), now), F.coalesce("recent", F.lit(0.0))), 6)
    return rows.select(key, score.alias("score")).withColumn("tier", scoring.tier(F.col("score")))


def retention_evict(scores: DataFrame, key: str, below: float = 0.15, most: int = 50) -> DataFrame:
    """The rows to evict next: lowest scores first, 50 at most (1000 allowed)."""
    return scores.where(F.col("score") < below).orderBy("score", key).limit(min(most, 1000))


def active_weeks(activity: DataFrame, project: str, ts: str) -> DataFrame:
    """Distinct Mondays on which each project's active weeks begin."""
    return activity.select(F.col(project).alias("project"), F.date_trunc("WEEK", F.col(ts)).cast("date").alias("week")).distinct()


def weekly_decay(lessons: DataFrame, weeks: DataFrame, key: str, since: str, until: Column) -> DataFrame:
    """(key, weeks, confidence): lessons lose their rate for every active week of their project after ``since``."""
    monday = lambda c: F.date_trunc("WEEK", c).cast("date")
    hits = lessons.join(weeks, "project", "left").where(F.col("week").isNull() | ((F.col("week") > monday(F.col(since))) & (F.col("week") <= monday(until))))
    counts = hits.groupBy(key).agg(F.count("week").alias("weeks"))
    rows = lessons.join(counts, key, "left").withColumn("weeks", F.coalesce("weeks", F.lit(0)).cast("long"))
    return rows.select(key, "weeks", scoring.weekly_decay(F.col("confidence"), F.col("rate"), F.col("weeks")).alias("confidence"))


def reasons(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, reason): the first rule that applies to each row, in the order given."""
    first = reduce(lambda rest, item: F.when(item[1], item[0]).otherwise(rest), reversed(list(rules.items())), F.lit(None).cast("string"))
    return rows.select(key, first.alias("reason")).where("reason IS NOT NULL")


def beyond_cap(rows: DataFrame, group: str, order: list, cap: int) -> DataFrame:
    """Rows of a group beyond its first ``cap`` in the given order (what to keep comes first)."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") > cap).drop("_r")


def newest(rows: DataFrame, ts: str, key: str, n: int) -> DataFrame:
    return rows.orderBy(F.desc(ts), key).limit(n)


def last_writer_wins(left: DataFrame, right: DataFrame, key: str, updated: str) -> DataFrame:
    """Rows of both sides by key; the newer version wins, the left one on a tie."""
    names = [c for c in left.columns if c != key]
    a = left.select(key, F.struct(*names).alias("_a"))
    b = right.select(key, F.struct(*names).alias("_b"))
    theirs = F.col("_a").isNull() | (F.col(f"_b.{updated}") > F.col(f"_a.{updated}"))
    pick = F.when(F.col("_b").isNotNull() & theirs, F.col("_b")).otherwise(F.col("_a"))
    return a.join(b, key, "full").select(key, pick.alias("_v")).select(key, "_v.*")


def upsert(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``changes`` replace rows with their key and add the others."""
    return rows.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def conditional_upsert(rows: DataFrame, changes: DataFrame, key: str, updated: str, expected: str) -> DataFrame:
    """Upsert of those changes whose expected time is that of the stored row (null: there is no such row)."""
    held = rows.select(key, F.col(updated).alias("_held"))
    fit = changes.join(held, key, "left").where(F.col(expected).eqNullSafe(F.col("_held"))).drop("_held", expected)
    return upsert(rows, fit, key)


def patch(rows: DataFrame, where: Column, sets: dict[str, Column] | None = None, adds: dict[str, float] | None = None, merges: dict[str, Column] | None = None, removes: list[str] | None = None) -> DataFrame:
    """Set, increment, merge into a map (the right side wins) or clear columns of the rows that ``where`` names."""
    out = {c: v for c, v in (sets or {}).items()}
    out |= {c: F.coalesce(F.col(c), F.lit(0)) + n for c, n in (adds or {}).items()}
    for c, extra in (merges or {}).items():
        mine = F.coalesce(F.col(c), F.create_map().cast(dict(rows.dtypes)[c]))
        out[c] = F.map_concat(F.map_filter(mine, lambda k, _, e=extra: ~F.array_contains(F.map_keys(e), k)), extra)
    out |= {c: F.lit(None) for c in removes or []}
    return rows.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in out.items()})


def quota_sweep(images: DataFrame, key: str, size: str, used_at: str, quota: int) -> DataFrame:
    """The oldest images that must go until the rest fits; the total is summed by day before it is spread over rows."""
    days = images.groupBy(F.to_date(used_at).alias("_day")).agg(F.sum(size).alias("_bytes"))
    newer = days.withColumn("_above", F.coalesce(F.sum("_bytes").over(Window.orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = images.join(newer.select("_day", "_above"), F.to_date(used_at) == F.col("_day"))
    upto = F.col("_above") + F.sum(size).over(Window.partitionBy("_day").orderBy(F.desc(used_at), key))
    return rows.withColumn("_upto", upto).where(F.col("_upto") > quota).select(key)


def checks(parts: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(category, n_pass, n_fail) for each named table and condition that its rows should meet."""
    def one(name: str, rows: DataFrame, good: Column) -> DataFrame:
        ok = F.coalesce(good, F.lit(False))
        return rows.agg(F.count_if(ok).alias("n_pass"), F.count_if(~ok).alias("n_fail")).select(F.lit(name).alias("category"), "n_pass", "n_fail")

    return reduce(DataFrame.unionByName, [one(name, rows, good) for name, (rows, good) in parts.items()])


def suffix_join(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(want, path): paths that are equal or of which one ends in / and the other; joined on the last name."""
    clean = lambda c: F.regexp_replace(c, r"^(\./)+", "")
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    a = wanted.select(clean(F.col("path")).alias("want")).distinct().withColumn("_n", name(F.col("want")))
    b = files.select(clean(F.col("path")).alias("path")).distinct().withColumn("_n", name(F.col("path")))
    match = (F.col("want") == F.col("path")) | F.endswith("path", F.concat(F.lit("/"), "want")) | F.endswith("want", F.concat(F.lit("/"), "path"))
    return a.join(b, "_n").where(match).select("want", "path")
