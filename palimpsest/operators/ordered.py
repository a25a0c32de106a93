"""Operators on ordered rows: windows, as-of joins, sessions and folds in order."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType, _parse_datatype_string


def timeline(rows: DataFrame, anchor: Column, ts: str, key: str, before: int = 5, after: int = 5) -> DataFrame:
    """The row nearest to a time (ties: the earliest) with the k rows before and after it, and their positions.

    Three bounded top-k passes instead of one global order.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = F.abs(micros - F.unix_micros(anchor.cast("timestamp")))
    best = rows.where(F.col(ts).isNotNull()).orderBy(gap, ts, key).limit(1)
    at = best.select(F.col(ts).alias("_t"), F.col(key).alias("_k"))
    t, k = at.select("_t").scalar(), at.select("_k").scalar()
    earlier = rows.where((F.col(ts) < t) | ((F.col(ts) == t) & (F.col(key) < k))).orderBy(F.desc(ts), F.desc(key)).limit(before)
    later = rows.where((F.col(ts) > t) | ((F.col(ts) == t) & (F.col(key) > k))).orderBy(ts, key).limit(after)
    numbered = lambda df, order, sign: df.withColumn("position", (sign * F.row_number().over(Window.orderBy(*order))).cast("int"))
    return (numbered(earlier, [F.desc(ts), F.desc(key)], -1).unionByName(best.withColumn("position", F.lit(0)))
            .unionByName(numbered(later, [ts, key], 1)))


def neighbourhood(rows: DataFrame, session: str, order: list[str], value: str, before: int = 3, after: int = 2) -> DataFrame:
    """Adds the values around each row of its session."""
    frame = Window.partitionBy(session).orderBy(*order).rowsBetween(-before, after)
    return rows.withColumn("around", F.array_join(F.collect_list(F.col(value).cast("string")).over(frame), ","))


def fill_forward(rows: DataFrame, key: str, order: list[str], value: Column, name: str = "filled") -> DataFrame:
    """Carries the last value of a key forward."""
    return rows.withColumn(name, F.last(value, True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def follow_ups(searches: DataFrame, session: str, ts: str, key: str, seconds: float = 30) -> DataFrame:
    """Marks searches made within ``seconds`` of the search before them in their session."""
    previous = F.lag(ts).over(Window.partitionBy(session).orderBy(ts, key))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return searches.withColumn("follow_up", F.coalesce(micros(F.col(ts)) - micros(previous) <= F.lit(int(seconds * 1e6)), F.lit(False)))


def nearest(left: DataFrame, right: DataFrame, on: str, ts: str, left_key: str, right_key: str) -> DataFrame:
    """(left_key, right_key) of the row of ``right`` nearest in time with the same ``on``; ties: the earliest, then the smallest id.

    One pass over the union in time order instead of a join of all pairs.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    null = F.lit(None)
    a = left.select(F.col(on).alias("g"), micros.alias("t"), F.lit(1).alias("side"), F.col(left_key).alias("l"), null.cast("long").alias("r"))
    b = right.select(F.col(on).alias("g"), micros.alias("t"), F.lit(0).alias("side"), null.cast("long").alias("l"), F.col(right_key).alias("r"))
    mine = F.when(F.col("side") == 0, F.struct("t", "r"))
    firsts = b.groupBy("g", "t", "side").agg(F.min("l").alias("l"), F.min("r").alias("r"))
    rows = a.unionByName(firsts)
    back = Window.partitionBy("g").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("g").orderBy(F.desc("t"), F.desc("side")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("p", F.last(mine, True).over(back)).withColumn("n", F.last(mine, True).over(ahead)).where("side = 1")
    previous = F.col("p").isNotNull() & (F.col("n").isNull() | (F.col("t") - F.col("p.t") <= F.col("n.t") - F.col("t")))
    return rows.select(F.col("l").alias(left_key), F.when(previous, F.col("p.r")).otherwise(F.col("n.r")).alias(right_key))


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def valid_until_next(rows: DataFrame, key: list[str], order: list, since: str) -> DataFrame:
    """Version history: each version of a key is closed by the one after it (null: still open)."""
    return rows.withColumn("valid_end", F.lead(since).over(Window.partitionBy(*key).orderBy(*order)))


def as_of(edges: DataFrame, at: Column, commit: str, since: str, until: str = "valid_end") -> DataFrame:
    """Versions known and valid at a time; an end at exactly that time still counts."""
    return edges.where((F.col(commit) <= at) & (F.col(since) <= at) & (F.col(until).isNull() | (F.col(until) >= at)))


def sessions(rows: DataFrame, key: str, ts: str, gap: str = "6 hours") -> DataFrame:
    """Sessions that end after a gap: their first and last time and number of rows."""
    found = rows.groupBy(key, F.session_window(F.col(ts), gap).alias("w")).agg(F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.count(F.lit(1)).alias("n"))
    return found.drop("w")


def fold(rows: DataFrame, key: list[str], order: list[str], step: Callable[[tuple | None, tuple], tuple[tuple, object]], out: str, kind: str, uses: list[str]) -> DataFrame:
    """Adds a column computed by a fold over each key's rows in order.

    ``step(state, values of uses) -> (state, value)`` starts with state None at each key.
    Rows stream through a task in order, and only one state is held, so a key of
    any size needs no more memory than a small one.  Columns that are not used stay in Arrow.
    """
    schema = StructType([*rows.schema.fields, StructField(out, _parse_datatype_string(kind))])
    arrow = to_arrow_type(schema[out].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for batch in batches:
            values, n = [], len(key)
            for record in zip(*[batch.column(c).to_pylist() for c in [*key, *uses]], strict=True):
                if record[:n] != now:
                    now, state = record[:n], None
                state, value = step(state, record[n:])
                values.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, arrow)], names=[*batch.schema.names, out])

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)


def dedup_ttl(rows: DataFrame, key: list[str], ts: str, tie: str, seconds: float = 300) -> DataFrame:
    """Rows left when repeats within the time to live of the last kept row go; repeats don't extend it."""
    micros = rows.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))

    def step(state, row):
        fresh = state is None or row[0] - state[0] >= seconds * 1e6
        return ((row[0],) if fresh else state), fresh

    return fold(micros, key, ["_t", tie], step, "fresh", "boolean", ["_t"]).where("fresh").drop("fresh", "_t")


def chunk_pack(rows: DataFrame, key: str, order: str, tokens: str, budget: int) -> DataFrame:
    """Numbers runs of consecutive rows so that no run but one of a single row exceeds the budget."""
    def step(state, row):
        number, used = state or (0, 0)
        cost = int(row[0])
        if state and used + cost > budget:
            number, used = number + 1, 0
        return (number, used + cost), number

    return fold(rows, [key], [order], step, "chunk", "int", [tokens])


def greedy_pack(ranked: DataFrame, key: str, rank: str, item: str, tokens: str, budget: int) -> DataFrame:
    """(key, item, used): items taken in rank order; what doesn't fit is skipped and the next one tried.

    The lists are results of limited searches; the first item may be shortened to fit.
    """
    items = F.sort_array(F.collect_list(F.struct(F.col(rank).cast("long").alias("rank"), F.col(item).alias("item"), F.col(tokens).cast("long").alias("tokens"))))
    lists = ranked.groupBy(key).agg(items.alias("items"))
    cost = lambda x: F.when(x["rank"] == F.col("items")[0]["rank"], F.least(x["tokens"], F.lit(budget).cast("long"))).otherwise(x["tokens"])
    none = F.filter(F.transform("items", lambda x: F.struct(x["item"].alias("item"), cost(x).alias("used"))), lambda x: F.lit(False))
    start = F.struct(F.lit(0).cast("long").alias("total"), none.alias("taken"))

    def step(state, x):
        fits = state["total"] + cost(x) <= budget
        new = F.struct((state["total"] + cost(x)).alias("total"), F.concat(state["taken"], F.array(F.struct(x["item"].alias("item"), cost(x).alias("used")))).alias("taken"))
        return F.when(fits, new).otherwise(F.struct(state["total"].alias("total"), state["taken"].alias("taken")))

    packed = lists.select(key, F.aggregate("items", start, step).alias("p"))
    return packed.select(key, F.explode("p.taken").alias("t")).select(key, F.col("t.item").alias(item), F.col("t.used").alias("used"))


def budget_fold(rows: DataFrame, key: str, order: list[str], tokens: str, cap: str, always: str | None = None, start: str | None = None) -> DataFrame:
    """Adds ``taken`` and ``used`` up to the row: in order, a row is taken if it fits under its own cap with what is taken so far, or ``always``.

    What doesn't fit is skipped and later rows are tried.  ``cap`` may differ from row to row, as for sections that share
    a budget; ``start`` is what is used before the first row.
    """
    def step(state, row):
        used = state[0] if state else row[3] or 0
        fits = row[0] is not None and (bool(row[2]) or row[1] is None or used + row[0] <= row[1])
        used = used + row[0] if fits else used
        return (used,), {"taken": fits, "used": used}

    flat = rows.withColumns({"_always": F.col(always) if always else F.lit(False), "_start": F.col(start).cast("long") if start else F.lit(0).cast("long"),
                             "_cost": F.col(tokens).cast("long"), "_cap": F.col(cap).cast("long")})
    out = fold(flat, [key], order, step, "_f", "struct<taken: boolean, used: long>", ["_cost", "_cap", "_always", "_start"])
    return out.select(*rows.columns, F.col("_f.taken").alias("taken"), F.col("_f.used").alias("used"))


def playback(rows: DataFrame, session: str, ts: str, key: str, duration: Column) -> DataFrame:
    """Adds offset_ms from the start of each session; where all its times are equal, the durations so far."""
    whole = Window.partitionBy(session)
    before = whole.orderBy(ts, key).rowsBetween(Window.unboundedPreceding, -1)
    millis = F.floor((F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.min(ts).over(whole).cast("timestamp"))) / 1000)
    return rows.withColumn("offset_ms", F.when(F.min(ts).over(whole) == F.max(ts).over(whole), F.coalesce(F.sum(duration).over(before), F.lit(0))).otherwise(millis).cast("long"))


def after_covered(rows: DataFrame, covered: DataFrame, session: str, order: list[str], key: str) -> DataFrame:
    """Rows of each session that come after the last one a summary covers (session, covered); all where it covers none."""
    place = rows.withColumn("_n", F.row_number().over(Window.partitionBy(session).orderBy(*order)))
    hit = covered.select(F.col(session).alias("_s"), F.col("covered").alias("_c"))
    last = place.join(hit, (F.col(session) == F.col("_s")) & (F.col(key) == F.col("_c"))).groupBy(F.col(session).alias("_s")).agg(F.max("_n").alias("_last"))
    return place.join(last, F.col(session) == F.col("_s"), "left").where(F.col("_n") > F.coalesce("_last", F.lit(0))).drop("_n", "_s", "_last")


def within_budget(rows: DataFrame, group: str, order: list, tokens: str, budget: int) -> DataFrame:
    """The first rows of each group whose tokens together fit; what comes after them goes."""
    upto = F.sum(tokens).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_upto", upto).where(F.col("_upto") <= budget).drop("_upto")
