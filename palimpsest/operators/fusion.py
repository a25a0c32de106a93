"""Fusing ranked result lists: reciprocal ranks, diversity, recency, floors and near-twin caps.

Hits are rows (query_id, doc_id, score).  Every order ends with the id.
"""
from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import scoring


def ranked(hits: DataFrame, by: str = "score") -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col(by).desc(), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order))


def reciprocal_rank_fusion(legs: dict[str, tuple[DataFrame, float]], always: tuple[str, ...] = ("lexical",)) -> DataFrame:
    """(query_id, doc_id, score): sums of weight / (60 + rank), weights shared out over the legs that found something.

    The weight of a leg in ``always`` counts also where that leg is empty.
    """
    parts = [ranked(hits).select("query_id", "doc_id", F.lit(name).alias("leg"), (F.lit(weight) / (scoring.RRF_K + F.col("rank"))).alias("part"),
                                 F.lit(0.0 if name in always else weight).alias("weight"))
             for name, (hits, weight) in legs.items()]
    rows = reduce(DataFrame.unionByName, parts)
    base = sum(weight for name, (_, weight) in legs.items() if name in always)
    used = rows.groupBy("query_id", "leg").agg(F.max("weight").alias("weight")).groupBy("query_id").agg((F.sum("weight") + base).alias("total"))
    fused = rows.groupBy("query_id", "doc_id").agg(F.sum("part").alias("part"))
    return fused.join(used, "query_id").select("query_id", "doc_id", F.round(F.col("part") / F.col("total"), 9).alias("score"))


def min_max(score: Column) -> Column:
    """Scores of a query spread over 0 to 1; equal scores count 1."""
    whole = Window.partitionBy("query_id")
    low, high = F.min(score).over(whole), F.max(score).over(whole)
    return F.when(high > low, (score - low) / (high - low)).otherwise(1.0)


def diversify(hits: DataFrame, k: int, group: str, cap: int = 3) -> DataFrame:
    """The best k of a query with at most ``cap`` of a group before any other row of it; the rest fills up in rank order."""
    within = Window.partitionBy("query_id", group).orderBy(F.col("score").desc(), "doc_id")
    rows = hits.withColumn("_over", F.row_number().over(within) > cap)
    order = Window.partitionBy("query_id").orderBy("_over", F.col("score").desc(), "doc_id")
    return ranked(rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r", "_over"))


def with_recency(hits: DataFrame, ts: Column, now: Column) -> DataFrame:
    return hits.withColumn("score", F.col("score") * scoring.recency(ts, now))


def relevance_floor(hits: DataFrame, bm25: str = "score", cosine: str = "cosine", least: float = 3.5, share: float = 0.5, alike: float = 0.3) -> DataFrame:
    """Rows near the best lexical score of their query, or lexical hits whose vector is close."""
    best = F.max(bm25).over(Window.partitionBy("query_id"))
    near = F.col(bm25) >= F.greatest(F.lit(least), share * best)
    close = (F.col(bm25) > 0) & (F.coalesce(F.col(cosine), F.lit(0.0)) >= alike)
    return hits.withColumn("_ok", near | close).where("_ok").drop("_ok")


def max_merge(results: list[DataFrame]) -> DataFrame:
    """Results of several wordings of a query: the best score of each document."""
    return reduce(DataFrame.unionByName, results).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


def near_twin_cap(pool: DataFrame, factor: float = 0.99, alike: float = 0.5) -> DataFrame:
    """Caps each row of a pool at 0.99 of a newer, similar row's own capped score.

    ``pool`` has query_id, doc_id, ts, words (array) and score, and is already
    limited per query (a few hundred rows), as the cap is recursive.  Rows of
    the same time don't cap each other; rows without time or words stay.
    """
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "doc_id"], ascending=[False, True], na_position="last", ignore_index=True)
        words = [set(w) if w is not None else set() for w in rows["words"]]
        score = rows["score"].to_numpy(copy=True)
        for i in range(len(rows)):
            newer = [j for j in range(i) if rows["ts"][j] > rows["ts"][i] and words[i] and words[j]
                     and len(words[i] & words[j]) >= alike * len(words[i] | words[j])]
            score[i] = min([score[i], *(factor * score[j] for j in newer)])
        return rows.assign(score=score)[["query_id", "doc_id", "score"]]

    kind = dict(pool.dtypes)
    return pool.groupBy("query_id").applyInPandas(solve, f"query_id {kind['query_id']}, doc_id {kind['doc_id']}, score double")


def lift_shadowing(pool: DataFrame) -> DataFrame:
    """Moves each row that shadows a better ranked one right above it.

    ``pool``: query_id, doc_id, rank, shadows (the id it shadows or null); a
    limited pool, since each move depends on those before it.
    """
    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        order = rows["doc_id"].tolist()
        for mine, other in zip(rows["doc_id"], rows["shadows"], strict=True):
            if pd.notna(other) and other in order and order.index(other) < order.index(mine):
                order.remove(mine)
                order.insert(order.index(other), mine)
        return pd.DataFrame({"query_id": rows["query_id"].iloc[0], "doc_id": order, "rank": range(1, len(order) + 1)})

    kind = dict(pool.dtypes)
    return pool.groupBy("query_id").applyInPandas(place, f"query_id {kind['query_id']}, doc_id {kind['doc_id']}, rank int")
