"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

The index of documents is written first and timed as a query of its own, ``document_index``.
"""
from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from palimpsest.plans import catalog, retrieval

HEADLINE = ["bm25_topk", "bm25_prefix_max", "bm25_stemmed", "vector_topk", "vector_batch_topk", "rrf_fusion", "session_diversified", "search_scoped", "smart_search", "co_change_pairs",
            "profile_topk", "context_window", "nearest_anchor_asof", "session_window", "retention_score", "lww_merge", "graph_bfs", "graph_heuristic_edges", "entity_search", "dedup_ttl",
            "secret_scrub", "ir_metrics", "context_blocks", "file_context", "semantic_recall"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["keyset_page"](spark, sf_dir).collect()
    took = {}
    began = time.perf_counter()
    retrieval.document_index(spark, sf_dir)
    took["document_index"] = round(time.perf_counter() - began, 3)
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
