"""Exact vector search by cosine, chunk families and upkeep of a vector table."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import scoring

from .lexical import top

MAX_QUERIES = 4096


def vector_search(vectors: DataFrame, query: Sequence[float], k: int = 20, key: str = "vec_id", column: str = "embedding", parent: str | None = None) -> DataFrame:
    """The k best rows for one vector, by cosine to 6 places, then id; with ``parent`` the best chunk of each parent counts."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    hits = vectors.select(F.col(parent or key).alias("id"), F.round(scoring.cosine(F.col(column), wanted), 6).alias("score"))
    if parent:
        hits = hits.groupBy("id").agg(F.max("score").alias("score"))
    return hits.orderBy(F.desc("score"), "id").limit(k)


def vector_search_many(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", column: str = "embedding", query_id: str = "query_id") -> DataFrame:
    """(query_id, doc_id, score) for a query set of any size.

    Queries go to every task in blocks of one vector length and at most MAX_QUERIES;
    each block reads all vectors.  Each Arrow batch of vectors keeps its own best k
    per query (with all ties at the k-th score), so little is shuffled.  A query
    meets vectors of its own length only.
    """
    blocks: dict[int, list] = {}
    hits = None
    asked = queries.select(F.col(query_id).alias("q"), F.col(column).alias("v")).where("v IS NOT NULL")

    def add(block: list) -> None:
        nonlocal hits
        part = _block_hits(vectors, block, k, key, column)
        hits = part if hits is None else hits.unionByName(part)

    for r in asked.toLocalIterator():
        block = blocks.setdefault(len(r.v), [])
        block.append(r)
        if len(block) == MAX_QUERIES:
            add(blocks.pop(len(r.v)))
    for block in blocks.values():
        add(block)
    return top(_block_hits(vectors, [], k, key, column) if hits is None else hits, k)


def _block_hits(vectors: DataFrame, asked: list, k: int, key: str, column: str) -> DataFrame:
    """At least the best k vectors for each query of a block; all of its vectors have one length."""
    width = len(asked[0].v) if asked else 0
    ids = np.array([r.q for r in asked], dtype=np.int64)
    matrix = np.array([r.v for r in asked], dtype=np.float64).reshape(len(asked), width)
    norms = np.linalg.norm(matrix, axis=1)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, v) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if v is not None and len(v) == width]
            if not rows or not len(ids):
                continue
            found = np.array([i for i, _ in rows], dtype=np.int64)
            block = np.array([v for _, v in rows], dtype=np.float64)
            lengths = np.linalg.norm(block, axis=1)
            scale = np.outer(norms, lengths)
            scores = np.round(np.divide(matrix @ block.T, scale, out=np.zeros_like(scale), where=scale > 0), 6)
            if len(rows) > k:
                edge = np.partition(scores, len(rows) - k, axis=1)[:, len(rows) - k]
            else:
                edge = np.full(len(ids), -np.inf)
            at, of = np.nonzero(scores >= edge[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(found[of]), pa.array(scores[at, of])], ["query_id", "doc_id", "score"])

    return vectors.select(F.col(key).cast("long"), column).mapInArrow(best, "query_id long, doc_id long, score double")


def dimension_audit(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    return vectors.groupBy(F.size(column).alias("dimensions")).agg(F.count(F.lit(1)).alias("n_vectors"))


def fill_diff(corpus: DataFrame, vectors: DataFrame, key: str = "id", digest: str = "input_hash") -> DataFrame:
    """(id, action): embed what is new or changed, prune what the corpus no longer holds."""
    a, b = corpus.select(key, F.col(digest).alias("_want")), vectors.select(key, F.col(digest).alias("_have"))
    both = a.join(b, key, "full")
    action = F.when(F.col("_want").isNull(), "prune").when(F.col("_have").isNull(), "embed").when(F.col("_want") != F.col("_have"), "re-embed")
    return both.select(key, action.alias("action")).where("action IS NOT NULL")


def replace_family(vectors: DataFrame, added: DataFrame, parent: str = "parent_id") -> DataFrame:
    """Re-adding a parent drops all its old chunks."""
    return vectors.join(added.select(parent).distinct(), parent, "left_anti").unionByName(added)


def vision_search(images: DataFrame, asked: DataFrame, k: int = 10, key: str = "vec_id", column: str = "embedding", session: str = "session_id") -> DataFrame:
    """(query_id, doc_id, score): the best k images (1 to 50) of each query (query_id, embedding, session_id), of its session where it names one.

    The session narrows before the limit: it is a join, and only images of asked sessions meet a query.
    """
    k = min(50, max(1, k))
    own = asked.where(F.col(session).isNotNull()).select("query_id", F.col(column).alias("_asked"), F.col(session).alias("_s"))
    near = images.select(F.col(key).cast("long").alias("doc_id"), column, session).join(own, F.col(session) == F.col("_s"))
    near = near.where(F.size(column) == F.size("_asked")).select("query_id", "doc_id", F.round(scoring.cosine(F.col(column), F.col("_asked")), 6).alias("score"))
    free = vector_search_many(images, asked.where(F.col(session).isNull()).select("query_id", column), k, key, column)
    return top(near, k).unionByName(free)
