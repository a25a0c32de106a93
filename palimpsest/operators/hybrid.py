"""Search over several legs: lexical, vector and graph hits of a scope, fused, spread over sessions, aged and capped.

The scope narrows every leg before its depth is counted, so a project whose hits all rank low in the whole store
still fills its page, and a page needs no second round.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import fusion, graph, lexical, recall, vector
from palimpsest.sources.shared import written

DEPTH, POOL, SEEDS = 100, 20, 5
WEIGHTS = {"lexical": 0.4, "vector": 0.6, "graph": 0.3}


def scoped(rows: DataFrame, allowed: DataFrame | None, key: str) -> DataFrame:
    return rows if allowed is None else rows.join(allowed.select(F.col("id").alias(key)), key, "left_semi")


def legs(index: lexical.Index, queries: DataFrame, depth: int = DEPTH, k: int = POOL, allowed: DataFrame | None = None, vectors: DataFrame | None = None,
         asked: DataFrame | None = None, tied: tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Written hits (query_id, doc_id, score) of each leg within a scope (id).

    ``vectors`` (vec_id, embedding) and ``asked`` (query_id, embedding) give the vector leg; ``tied`` are nodes, edges, entities
    (query_id, entity) and sources (node, id) of the graph leg, to which the surroundings of the first vector hits are added behind
    what the entities name.
    """
    out = {"lexical": written(lexical.top(scoped(lexical.search(index, queries, None), allowed, "doc_id"), depth), "lexical-leg")}
    if vectors is not None and asked is not None:
        out["vector"] = written(vector.vector_search_many(scoped(vectors, allowed, "vec_id"), asked, depth), "vector-leg")
    if tied is not None:
        nodes, edges, entities, sources = tied
        sources = scoped(sources, allowed, "id")
        named = graph.search_entities(nodes, edges, entities, sources, 2, k).select("query_id", F.col("id").alias("doc_id"), (F.col("score") + 1).alias("score"))
        if "vector" in out:
            first = fusion.ranked(out["vector"]).where(F.col("rank") <= SEEDS).select("query_id", F.col("doc_id").alias("id"))
            named = named.unionByName(graph.expand_hits(edges, first, sources, 1, 5).withColumnRenamed("id", "doc_id"))
        out["graph"] = written(named.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), "graph-leg")
    return out


def fused(found: dict[str, DataFrame], weights: dict[str, float] | None = None, boosts: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score): fused legs; ``boosts`` (id, boost) multiplies the scores of a layer."""
    weights = weights or WEIGHTS
    out = fusion.reciprocal_rank_fusion({name: (hits, weights[name]) for name, hits in found.items()})
    if boosts is None:
        return out
    more = boosts.select(F.col("id").alias("doc_id"), "boost")
    return out.join(more, "doc_id", "left").select("query_id", "doc_id", F.round(F.col("score") * F.coalesce("boost", F.lit(1.0)), 9).alias("score"))


def norm_fused(found: dict[str, DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """As ``fused`` on magnitudes: lexical scores spread over 0 to 1 per query, cosines moved to 0 to 1, graph hits by reciprocal rank."""
    weights = weights or WEIGHTS
    whole = Window.partitionBy("query_id")
    low, high = F.min("score").over(whole), F.max("score").over(whole)
    shares = {"lexical": (F.col("score") - low) / F.when(high > low, high - low).otherwise(1.0), "vector": (F.col("score") + 1) / 2,
              "graph": 1 / (60 + F.row_number().over(whole.orderBy(F.desc("score"), "doc_id")))}
    parts = None
    for name, hits in found.items():
        part = hits.withColumn("part", shares[name] * weights[name]).select("query_id", "doc_id", F.lit(name).alias("leg"), "part", F.lit(0.0 if name == "lexical" else weights[name]).alias("weight"))
        parts = part if parts is None else parts.unionByName(part)
    used = parts.groupBy("query_id", "leg").agg(F.max("weight").alias("weight")).groupBy("query_id").agg((F.sum("weight") + weights["lexical"]).alias("total"))
    sums = parts.groupBy("query_id", "doc_id").agg(F.sum("part").alias("part"))
    return sums.join(used, "query_id").select("query_id", "doc_id", F.round(F.col("part") / F.col("total"), 9).alias("score"))


def hybrid_search(found: dict[str, DataFrame], records: DataFrame, now: Column, k: int = 20, weights: dict[str, float] | None = None, cap: int = 3, twins: bool = True,
                  norm: bool = False, boosts: DataFrame | None = None) -> DataFrame:
    """(query_id, id, rank, score, bm25, cosine): the best k of fused legs.

    Of the fused hits the best ``max(k, 20)`` stay, at most ``cap`` of a session before others of it; their scores fade with age,
    and a hit is capped behind a newer one that says nearly the same.  ``records``: id, session_id, ts, body; hits without a record go.
    """
    hits = norm_fused(found, weights) if norm else fused(found, weights, boosts)
    known = records.select(F.col("id").alias("doc_id"), "session_id", "ts", "body")
    pool = fusion.diversify(hits.join(known.select("doc_id", "session_id"), "doc_id"), max(k, POOL), "session_id", cap).select("query_id", "doc_id", "score")
    aged = fusion.with_recency(written(pool, "pool").join(known, "doc_id"), F.col("ts"), now).withColumn("score", F.round("score", 9))
    if twins:
        aged = fusion.near_twin_cap(aged.select("query_id", "doc_id", "ts", "score", text.word_set(F.col("body")).alias("words"))).withColumn("score", F.round("score", 9))
    out = fusion.ranked(aged.select("query_id", "doc_id", "score")).where(F.col("rank") <= k)
    for name, column in (("lexical", "bm25"), ("vector", "cosine")):
        if name in found:
            out = out.join(found[name].withColumnRenamed("score", column), ["query_id", "doc_id"], "left")
        else:
            out = out.withColumn(column, F.lit(None).cast("double"))
    return out.select("query_id", F.col("doc_id").alias("id"), F.col("rank").cast("int").alias("rank"), "score", "bm25", "cosine")


def smart_search(found: dict[str, DataFrame], records: DataFrame, now: Column, k: int = 20, more: dict[str, DataFrame] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, kind, id, rank, score): hits above the floor, newer ones above those they repeat, and what other recalls found.

    ``records`` as in ``hybrid_search``, with ``kind``, the kind of a record within which newer ones repeat older ones.  ``more``: by kind (lesson, insight,
    fact) the hits (query_id, id, score) of its recall, of which the best ``min(k, 10)`` follow.
    """
    pool = hybrid_search(found, records, now, max(10 * k, DEPTH), weights)
    floor = fusion.relevance_floor(pool.withColumn("bm25", F.coalesce("bm25", F.lit(0.0))), bm25="bm25")
    out = recall.page(floor.select("query_id", "id", "score"), records.select("id", "ts", "kind", "body"), k)
    out = out.select("query_id", F.lit("record").alias("kind"), F.col("id").cast("string").alias("id"), "rank", "score")
    for kind, hits in (more or {}).items():
        ranked = fusion.ranked(hits.select("query_id", F.col("id").alias("doc_id"), "score")).where(F.col("rank") <= min(k, 10))
        out = out.unionByName(ranked.select("query_id", F.lit(kind).alias("kind"), F.col("doc_id").cast("string").alias("id"), F.col("rank").cast("int").alias("rank"), "score"))
    return out
