"""Mining, ordered, graph and lifecycle queries over the test tables, with their oracle SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import graph, lifecycle, mining, ordered
from palimpsest.plans import retrieval
from palimpsest.sources.tables import table

ORDERS_NOW, EVENTS_NOW = "2002-01-01 00:00:00", "2024-02-01 00:00:00"
WANTED = [("quality", "1"), ("toxic", "0")]


def at(moment: str):
    return F.lit(moment).cast("timestamp_ntz")


# ---------------------------------------------------------------- mining


def co_change_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.co_change_pairs(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


def error_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.error_repeats(table(spark, sf_dir, "events").where("event_type = 'error'"), F.col("props"), "user_id")


def rule_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all files of a session, unlike ``co_change_pairs``; a rule takes four sessions."""
    return mining.rules(mining.all_co_change_pairs(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", 4), error_repeats(spark, sf_dir))


def profile_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.top_values(table(spark, sf_dir, "documents"), "lang", text.distinctive_terms(F.col("text")))


def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("target_id"), F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic"))
    return rows.unpivot("target_id", ["quality", "toxic"], "dimension", "value")


def facet_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.facet_rollup(facets(spark, sf_dir))


def facet_match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.facet_match(facets(spark, sf_dir), WANTED, True)


def facet_match_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.facet_match(facets(spark, sf_dir), WANTED, False)


def facet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.facet_values(facets(spark, sf_dir))


def concept_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.concept_groups(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", "o_orderkey")


def thread_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.threads(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


def injection_use_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.use_share(table(spark, sf_dir, "events"), "event_type", F.coalesce(F.col("value") > 10, F.lit(False)))


def injection_use_range_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views followed by a purchase of the same thing by the same user."""
    events = table(spark, sf_dir, "events")
    views = events.where("event_type = 'view'").select("event_id", "user_id", "props", "ts").alias("v")
    last = events.where("event_type = 'purchase'").groupBy("user_id", "props").agg(F.max("ts").alias("last")).alias("p")
    return views.join(last, (F.col("v.user_id") == F.col("p.user_id")) & (F.col("v.props") == F.col("p.props")) & (F.col("last") > F.col("ts")), "left_semi").select("event_id")


def majority_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.majority(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus")


def nearest_rank_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.nearest_rank(table(spark, sf_dir, "events"), "event_type", "value", 95)


def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector search judged by labels: rows with the query's label are relevant."""
    from palimpsest.operators.fusion import ranked

    vectors = table(spark, sf_dir, "embeddings")
    labels = retrieval.item_vectors(spark, sf_dir).select("query_id").join(vectors.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    relevant = labels.join(vectors.select(F.col("vec_id").alias("doc_id"), "label"), "label").select("query_id", "doc_id")
    return mining.ir_metrics(ranked(retrieval.vector_batch_topk(spark, sf_dir, 10)), relevant, 10)


# ---------------------------------------------------------------- order


def timeline_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.timeline(table(spark, sf_dir, "events"), at("2024-01-15 12:00:00"), "ts", "event_id").select("event_id", "ts", "position")


def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.neighbourhood(table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role", "text"], "turn").select("conv_id", "turn", "role", "around")


def session_fill_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = F.when(F.col("event_type") == "purchase", F.col("value"))
    return ordered.fill_forward(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], paid).select("event_id", "filled")


def followup_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = table(spark, sf_dir, "events").where("event_type = 'view'")
    return ordered.follow_ups(views, "user_id", "ts", "event_id", 3600).select("event_id", "follow_up")


def followup_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return followup_lag(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_searches"), F.count_if("follow_up").alias("n_follow_ups"))


def nearest_anchor_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return ordered.nearest(events.where("event_type = 'purchase'").withColumnRenamed("event_id", "purchase_id"), events.where("event_type = 'view'").withColumnRenamed("event_id", "view_id"),
                           "user_id", "ts", "purchase_id", "view_id")


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    return ordered.latest(rows, ["o_custkey", "o_orderstatus"], [F.desc("o_orderdate"), "o_orderkey"])


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    return ordered.valid_until_next(rows, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"], "o_orderdate")


def bitemporal_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.as_of(versions(spark, sf_dir), at("1998-06-01 00:00:00"), "o_orderdate", "o_orderdate")


def differential_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.changes(versions(spark, sf_dir), at("1998-06-01 00:00:00"), at("1998-09-01 00:00:00"), "o_orderdate")


def session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.sessions(table(spark, sf_dir, "events"), "user_id", "ts")


def idle_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_at"))
    return last.where(F.col("last_at") < at("2024-01-30 18:00:00"))


def dedup_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.dedup_ttl(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id", 3600)


def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.token_estimate(F.col("text")).alias("tokens"))
    return ordered.chunk_pack(turns, "conv_id", "turn", "tokens", 200)


def budget_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.operators.fusion import ranked

    docs = table(spark, sf_dir, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))
    return ordered.greedy_pack(ranked(retrieval.bm25_topk(spark, sf_dir, 20)).join(docs, "doc_id"), "query_id", "rank", "doc_id", "tokens", 2000)


# ---------------------------------------------------------------- lifecycle

KINDS = {"1-URGENT": "architecture", "2-HIGH": "preference", "3-MEDIUM": "pattern", "4-NOT SPECIFIED": "bug", "5-LOW": "fact"}


def retention_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = at(ORDERS_NOW)
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), F.col("o_orderpriority"))
    uses = lifecycle.recent_access(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "l_shipdate", now)
    return lifecycle.retention_scores(table(spark, sf_dir, "orders"), uses, "o_orderkey", kind, F.lit(0.0), "o_orderdate", now)


def retention_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention_score(spark, sf_dir).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


def retention_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.retention_evict(retention_score(spark, sf_dir), "o_orderkey", 0.3).select("o_orderkey", "score")


def active_weeks_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    lessons = events.groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("project"), F.min("ts").alias("since"))
    lessons = lessons.withColumns({"confidence": F.lit(0.5), "rate": F.lit(0.05)})
    return lifecycle.weekly_decay(lessons, lifecycle.active_weeks(events, "event_type", "ts"), "user_id", "since", at(EVENTS_NOW))


def evict_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.reasons(table(spark, sf_dir, "orders"), "o_orderkey", {
        "expired": (F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < at("1996-01-01")), "low_value": F.col("o_totalprice") < 20000,
        "stale": F.col("o_orderdate") < at("1995-06-01")})


def session_cap_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.beyond_cap(table(spark, sf_dir, "events"), "user_id", [F.desc("value"), F.desc("ts"), F.desc("event_id")], 50).select("event_id")


def project_cap_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.beyond_cap(table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_totalprice"), "o_orderkey"], 5).select("o_orderkey")


def audit_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.newest(table(spark, sf_dir, "events"), "ts", "event_id", 1000).select("event_id", "ts")


def lww_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    here = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated_at"), F.col("o_totalprice").alias("amount"))
    there = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_shipdate").alias("updated_at"), F.sum("l_quantity").alias("amount"))
    return lifecycle.last_writer_wins(here, there, "id", "updated_at")


def quota_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.quota_sweep(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", "o_orderdate", 1_000_000)


def missing_reference_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


def stale_latest_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    orders = table(spark, sf_dir, "orders")
    return orders.join(late.groupBy("o_orderkey").agg(F.max("l_shipdate").alias("last")), "o_orderkey").where("last > o_orderdate").select("o_orderkey")


def summary_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_orderdate").alias("last_at"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(made, "c_custkey", "left")


def file_suffix_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^https?://([^?#]*)", 1).alias("path"))
    return lifecycle.suffix_join(path.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("path")), path)


def diagnostics_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lifecycle.checks({
        "text present": (docs, F.char_length("text") > 0), "language known": (docs, F.col("lang").isNotNull()), "length agrees": (docs, F.col("n_chars") == F.char_length("text")),
        "events priced": (table(spark, sf_dir, "events"), F.col("value") > 0), "pages rooted": (table(spark, sf_dir, "pages"), F.col("url").startswith("http"))})


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderkey > 100").orderBy("o_orderkey").limit(500).select("o_orderkey", "o_custkey")


def scope_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.octet_length("text")).alias("n_bytes"), F.count(F.lit(1)).alias("n"))


def key_probe_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id").join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_semi")


# ---------------------------------------------------------------- graph


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda kind, column: F.concat(F.lit(kind + ":"), F.col(column).cast("string"))
    parts = [table(spark, sf_dir, "customer").select(name("customer", "c_custkey").alias("src"), name("nation", "c_nationkey").alias("dst")),
             table(spark, sf_dir, "supplier").select(name("supplier", "s_suppkey").alias("src"), name("nation", "s_nationkey").alias("dst")),
             table(spark, sf_dir, "nation").select(name("nation", "n_nationkey").alias("src"), name("region", "n_regionkey").alias("dst"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def graph_degree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_degree(places(spark, sf_dir), 500)


def graph_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bfs(places(spark, sf_dir), spark.createDataFrame([("region:0",)], "node string"), 2)


def graph_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and brands, joined by shares of line items; cheapest ways from supplier 0 within three steps."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    edges = items.groupBy(F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("src"), F.col("p_brand").alias("dst")).agg((F.count(F.lit(1)) / 100).alias("weight"))
    return graph.cheapest_paths(edges, spark.createDataFrame([("supplier:0",)], "node string"), 3)


def graph_heuristic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.heuristic_edges(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", "l_returnflag")


def merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return graph.merge_edges(events.select(F.col("user_id").alias("src"), F.col("props").alias("dst"), F.col("event_type").alias("type"), F.col("value").alias("weight")))


def provenance_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that only orders of status F or O have."""
    sources = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("node"), F.col("o_orderkey").alias("source"))
    live = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("source"))
    return graph.orphans(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node")), sources, live)


def relation_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers of a nation and nations of a region are related; what is near the benchmark's first customers."""
    links = places(spark, sf_dir).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0.8).alias("confidence"))
    starts = table(spark, sf_dir, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("start"))
    return graph.related(links, starts, 2)


def entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers near the nations and regions that a name stands for."""
    names = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("node"), F.col("n_name").alias("name")).unionByName(
        table(spark, sf_dir, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("node"), F.col("r_name").alias("name")))
    ends = places(spark, sf_dir)
    sources = ends.select(F.col("src").alias("node"), F.col("src").alias("id")).distinct()
    asked = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("query_id"), F.col("r_name").alias("entity")).unionByName(
        table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).alias("query_id"), F.concat(F.lit("in "), F.lower("n_name")).alias("entity")))
    return graph.search_entities(names, ends.withColumn("weight", F.lit(0.4)), asked, sources, 2, 20)


# ---------------------------------------------------------------- texts


def secret_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.scrub(F.col("text")).alias("scrubbed"))


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.chunk_column("text")).alias("at", "chunk"))


def token_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(text.token_estimate(F.col("text"))).alias("n_tokens"))


def content_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that repeat, with the first document of each."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("fingerprint"))
    return rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    co_change_pairs, error_repeats, rule_generation, profile_topk, facet_rollup, facet_match_all, facet_match_any, facet_values, concept_groups, thread_summary,
    injection_use_share, injection_use_range_semi, majority_project, nearest_rank_p95, ir_metrics, timeline_window, context_window, session_fill_forward, followup_lag,
    followup_rate, nearest_anchor_asof, latest_per_key, bitemporal_asof, differential_state, session_window, idle_close, dedup_ttl, chunk_pack, budget_pack,
    retention_score, retention_tiers, retention_evict, active_weeks_decay, evict_reasons, session_cap_evict, project_cap_evict, audit_newest, lww_merge, quota_sweep,
    missing_reference_anti, stale_latest_semi, summary_left_join, file_suffix_theta, diagnostics_counts, keyset_page, scope_bytes, key_probe_semi,
    graph_degree_topk, graph_bfs, graph_shortest_path, graph_heuristic_edges, merge_edges, provenance_orphans, relation_walk, entity_search, secret_scrub, text_chunks, token_sums, content_fingerprints)}

PAIRS = """WITH f AS (SELECT DISTINCT l_orderkey AS s, l_suppkey AS f FROM lineitem), c AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY f) AS r FROM f),
pairs AS (SELECT a.f AS file_a, b.f AS file_b, count(*) AS n_sessions FROM c a JOIN c b ON a.s = b.s AND a.f < b.f WHERE a.r <= 50 AND b.r <= 50 GROUP BY 1, 2 HAVING count(*) >= 3),
errors AS (SELECT lower(props) AS title, count(*) AS n, count(DISTINCT user_id) AS n_sessions FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 2)"""
ALL_PAIRS = """WITH f AS (SELECT DISTINCT l_orderkey AS s, l_suppkey AS f FROM lineitem),
pairs AS (SELECT a.f AS file_a, b.f AS file_b, count(*) AS n_sessions FROM f a JOIN f b ON a.s = b.s AND a.f < b.f GROUP BY 1, 2),
errors AS (SELECT lower(props) AS title, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1)"""
FACETS = """WITH x AS (SELECT doc_id AS target_id, 'quality' AS dimension, quality::VARCHAR AS value FROM labels WHERE quality IS NOT NULL
UNION ALL SELECT doc_id, 'toxic', toxic::VARCHAR FROM labels WHERE toxic IS NOT NULL)"""
MATCHED = FACETS + """ SELECT target_id, count(DISTINCT dimension || ':' || value) AS n_matched FROM x WHERE (dimension = 'quality' AND value = '1') OR (dimension = 'toxic' AND value = '0')
GROUP BY target_id"""
VERSIONS = """WITH v AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate,
lead(o_orderdate) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS valid_end FROM orders)"""
AGE = "(epoch_us(TIMESTAMP '2002-01-01') / 1e6 - epoch_us({0}) / 1e6) / 86400.0"
SCORES = f"""WITH a AS (SELECT l_orderkey, count(*) AS n, sum(CASE WHEN d > 0 THEN 1 / d END) AS recent FROM (SELECT l_orderkey, {AGE.format('l_shipdate')} AS d FROM lineitem) GROUP BY 1),
b AS (SELECT o_orderkey, {AGE.format('o_orderdate')} AS days, coalesce(n, 0) AS n, coalesce(recent, 0) AS recent,
 CASE o_orderpriority WHEN '1-URGENT' THEN 0.9 WHEN '2-HIGH' THEN 0.85 WHEN '3-MEDIUM' THEN 0.8 WHEN '4-NOT SPECIFIED' THEN 0.7 ELSE 0.5 END::DOUBLE AS w FROM orders LEFT JOIN a ON l_orderkey = o_orderkey),
c AS (SELECT o_orderkey, round(least(1.0::DOUBLE, least(1.0::DOUBLE, w + least(0.2::DOUBLE, 0.02::DOUBLE * n)) * exp(-0.01::DOUBLE * days) + 0.3::DOUBLE * recent), 6) AS score FROM b),
s AS (SELECT *, CASE WHEN score >= 0.7 THEN 'hot' WHEN score >= 0.4 THEN 'warm' WHEN score >= 0.15 THEN 'cold' ELSE 'evictable' END AS tier FROM c)"""
EDGES = """e AS (SELECT 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation)"""

ORACLES = {
    "co_change_pairs": PAIRS + " SELECT * FROM pairs",
    "error_repeats": PAIRS + " SELECT * FROM errors",
    "rule_generation": ALL_PAIRS + """ SELECT 'When ' || file_a || ' changes, check ' || file_b || ' (' || n_sessions || ' sessions)' AS rule, n_sessions AS frequency FROM pairs WHERE n_sessions >= 4
UNION ALL SELECT 'Recurring error: ' || title || ' (' || n || ' times)', n FROM errors WHERE n >= 3""",
    "profile_topk": f"""WITH t AS (SELECT lang AS project, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]{{3,}}'))) AS value FROM documents),
c AS (SELECT project, value, count(*) AS n FROM t WHERE NOT list_contains({retrieval.STOP}, value) GROUP BY 1, 2)
SELECT project, value, n FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY n DESC, value) AS r FROM c) WHERE r <= 15""",
    "facet_rollup": FACETS + " SELECT dimension, value, count(*) AS n FROM x GROUP BY ROLLUP (dimension, value)",
    "facet_match_all": MATCHED + " HAVING count(DISTINCT dimension || ':' || value) = 2",
    "facet_match_any": MATCHED,
    "facet_values": FACETS + " SELECT target_id, dimension, string_agg(DISTINCT value, ',' ORDER BY value) AS vals FROM x GROUP BY 1, 2",
    "concept_groups": """SELECT o_orderpriority, o_orderkey, o_totalprice, n FROM (SELECT *, count(*) OVER (PARTITION BY o_orderpriority) AS n,
row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_totalprice >= 5) WHERE n >= 3 AND r <= 8""",
    "thread_summary": "SELECT conv_id, count(*) AS n_messages, max(turn) AS last_at, string_agg(DISTINCT role, ',' ORDER BY role) AS participants FROM conversations GROUP BY conv_id",
    "injection_use_share": "SELECT event_type, count(*) AS n_scored, count(*) FILTER (WHERE value > 10) AS n_used FROM events GROUP BY ROLLUP (event_type)",
    "injection_use_range_semi": """SELECT event_id FROM events v WHERE event_type = 'view' AND EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = v.user_id
AND p.props = v.props AND p.ts > v.ts)""",
    "majority_project": """WITH c AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1, 2)
SELECT o_custkey, o_orderstatus, n, total FROM (SELECT *, sum(n) OVER (PARTITION BY o_custkey)::BIGINT AS total FROM c) WHERE n * 2 > total""",
    "nearest_rank_p95": """SELECT event_type, min(value) AS percentile FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r,
count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE r >= ceil(0.95::DOUBLE * n) GROUP BY event_type""",
    "ir_metrics": f"""WITH {retrieval.VECTOR_LEG}, vt AS ({retrieval.top_sql('vl', 10)}),
h AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM vt),
q AS (SELECT item_id AS query_id, label FROM benchmark JOIN embeddings ON vec_id = item_id),
g AS (SELECT h.*, (q.label = e.label)::INT AS gold FROM h JOIN q USING (query_id) JOIN embeddings e ON e.vec_id = h.doc_id),
r AS (SELECT q.query_id, count(*) AS relevant FROM q JOIN embeddings e ON e.label = q.label GROUP BY 1),
i AS (SELECT query_id, relevant, (SELECT sum(1 / log2(x + 1)) FROM generate_series(1, 10) t(x) WHERE x <= relevant) AS ideal FROM r)
SELECT query_id, round(sum(gold)::DOUBLE / any_value(relevant), 6) AS recall, round(sum(gold)::DOUBLE / count(*), 6) AS prec, round(sum(gold / log2(rank + 1)) / any_value(ideal), 6) AS ndcg,
round(coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE gold = 1), 0), 6) AS mrr FROM g JOIN i USING (query_id) GROUP BY query_id""",
    "timeline_window": """WITH o AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS r FROM events),
a AS (SELECT r FROM o ORDER BY abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')), ts, event_id LIMIT 1)
SELECT event_id, ts, (o.r - a.r)::INT AS position FROM o, a WHERE o.r BETWEEN a.r - 5 AND a.r + 5""",
    "context_window": """SELECT conv_id, turn, role, array_to_string(list(turn::VARCHAR) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING), ',') AS around
FROM conversations""",
    "session_fill_forward": """SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM events""",
    "followup_lag": """SELECT event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 3600000000, false) AS follow_up
FROM events WHERE event_type = 'view'""",
    "followup_rate": """SELECT count(*) AS n_searches, count(*) FILTER (WHERE f) AS n_follow_ups FROM (SELECT coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))
<= 3600000000, false) AS f FROM events WHERE event_type = 'view')""",
    "nearest_anchor_asof": """SELECT purchase_id, view_id FROM (SELECT p.event_id AS purchase_id, v.event_id AS view_id,
row_number() OVER (PARTITION BY p.event_id ORDER BY abs(epoch_us(p.ts) - epoch_us(v.ts)), v.ts, v.event_id) AS r
FROM events p LEFT JOIN events v ON v.user_id = p.user_id AND v.event_type = 'view' WHERE p.event_type = 'purchase') WHERE r = 1""",
    "latest_per_key": """SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) AS r
FROM orders) WHERE r = 1""",
    "bitemporal_asof": VERSIONS + " SELECT * FROM v WHERE o_orderdate <= TIMESTAMP '1998-06-01' AND (valid_end IS NULL OR valid_end >= TIMESTAMP '1998-06-01')",
    "differential_state": VERSIONS + " SELECT * FROM v WHERE o_orderdate BETWEEN TIMESTAMP '1998-06-01' AND TIMESTAMP '1998-09-01'",
    "session_window": """WITH s AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n FROM g GROUP BY user_id, k""",
    "idle_close": "SELECT user_id, max(ts) AS last_at FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-30 18:00:00'",
    "retention_score": SCORES + " SELECT * FROM s",
    "retention_tiers": SCORES + " SELECT tier, count(*) AS n FROM s GROUP BY tier",
    "retention_evict": SCORES + " SELECT o_orderkey, score FROM s WHERE score < 0.3 ORDER BY score, o_orderkey LIMIT 50",
    "active_weeks_decay": """WITH l AS (SELECT user_id, arg_min(event_type, (ts, event_id)) AS project, min(ts) AS since FROM events GROUP BY user_id),
w AS (SELECT DISTINCT event_type AS project, date_trunc('week', ts)::DATE AS week FROM events),
c AS (SELECT user_id, count(week) AS weeks FROM l LEFT JOIN w ON w.project = l.project AND week > date_trunc('week', since)::DATE AND week <= date_trunc('week', TIMESTAMP '2024-02-01')::DATE GROUP BY 1)
SELECT user_id, weeks, round(greatest(0.05::DOUBLE, 0.5::DOUBLE - 0.05::DOUBLE * weeks), 3) AS confidence FROM c""",
    "evict_reasons": """SELECT * FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-01-01' THEN 'expired' WHEN o_totalprice < 20000 THEN 'low_value'
WHEN o_orderdate < TIMESTAMP '1995-06-01' THEN 'stale' END AS reason FROM orders) WHERE reason IS NOT NULL""",
    "session_cap_evict": "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts DESC, event_id DESC) AS r FROM events) WHERE r > 50",
    "project_cap_evict": "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r > 5",
    "audit_newest": "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 1000",
    "lww_merge": """WITH t AS (SELECT l_orderkey AS id, max(l_shipdate) AS updated_at, sum(l_quantity) AS amount FROM lineitem GROUP BY 1)
SELECT coalesce(o_orderkey, t.id) AS id, CASE WHEN t.id IS NOT NULL AND (o_orderkey IS NULL OR t.updated_at > o_orderdate) THEN t.updated_at ELSE o_orderdate END AS updated_at,
CASE WHEN t.id IS NOT NULL AND (o_orderkey IS NULL OR t.updated_at > o_orderdate) THEN t.amount ELSE o_totalprice END AS amount FROM orders FULL JOIN t ON t.id = o_orderkey""",
    "quota_sweep": "SELECT o_orderkey FROM (SELECT o_orderkey, sum(o_custkey) OVER (ORDER BY o_orderdate DESC, o_orderkey) AS upto FROM orders) WHERE upto > 1000000",
    "missing_reference_anti": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "stale_latest_semi": "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate)",
    "summary_left_join": "SELECT c_custkey, c_name, n_orders, last_at FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, max(o_orderdate) AS last_at FROM orders GROUP BY 1) ON o_custkey = c_custkey",
    "file_suffix_theta": r"""WITH p AS (SELECT DISTINCT regexp_extract(url, '^https?://([^?#]*)', 1) AS path FROM pages), w AS (SELECT DISTINCT regexp_extract(path, '([^/]+/[^/]+)$', 1) AS want FROM p)
SELECT want, path FROM w JOIN p ON string_split(want, '/')[-1] = string_split(path, '/')[-1] AND (want = path OR ends_with(path, '/' || want) OR ends_with(want, '/' || path))""",
    "diagnostics_counts": """SELECT 'text present' AS category, count(*) FILTER (WHERE length(text) > 0) AS n_pass, count(*) FILTER (WHERE NOT coalesce(length(text) > 0, false)) AS n_fail FROM documents
UNION ALL SELECT 'language known', count(lang), count(*) - count(lang) FROM documents
UNION ALL SELECT 'length agrees', count(*) FILTER (WHERE n_chars = length(text)), count(*) FILTER (WHERE NOT coalesce(n_chars = length(text), false)) FROM documents
UNION ALL SELECT 'events priced', count(*) FILTER (WHERE value > 0), count(*) FILTER (WHERE NOT coalesce(value > 0, false)) FROM events
UNION ALL SELECT 'pages rooted', count(*) FILTER (WHERE url LIKE 'http%'), count(*) FILTER (WHERE NOT coalesce(url LIKE 'http%', false)) FROM pages""",
    "keyset_page": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 500",
    "scope_bytes": "SELECT source, sum(strlen(text))::BIGINT AS n_bytes, count(*) AS n FROM documents GROUP BY source",
    "key_probe_semi": "SELECT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)",
    "graph_degree_topk": f"WITH {EDGES} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node ORDER BY degree DESC, node LIMIT 500",
    "graph_bfs": f"""WITH RECURSIVE {EDGES}, s AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)),
b(node, depth) AS (SELECT 'region:0', 0 UNION SELECT dst, depth + 1 FROM b JOIN s ON src = node WHERE depth < 2) SELECT node, min(depth)::INT AS depth FROM b GROUP BY node""",
    "graph_heuristic_edges": """WITH c AS (SELECT o, v, row_number() OVER (PARTITION BY o ORDER BY v) AS r FROM (SELECT DISTINCT l_orderkey AS o, l_suppkey::VARCHAR AS v FROM lineitem)),
f AS (SELECT o, v, row_number() OVER (PARTITION BY o ORDER BY v) AS r FROM (SELECT DISTINCT l_orderkey AS o, l_returnflag AS v FROM lineitem)),
p AS (SELECT c.v AS src, f.v AS dst, row_number() OVER (PARTITION BY c.o ORDER BY c.v, f.v) AS r FROM c JOIN f ON c.o = f.o WHERE c.r <= 12 AND f.r <= 12)
SELECT src, dst, count(*) AS n_observations, 0.4::DOUBLE AS weight FROM p WHERE r <= 12 GROUP BY 1, 2""",
    "merge_edges": "SELECT user_id AS src, props AS dst, event_type AS type, max(value) AS weight, count(*) AS n FROM events GROUP BY 1, 2, 3",
    "provenance_orphans": """SELECT c_custkey AS node FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""",
    "relation_walk": f"""WITH RECURSIVE {EDGES}, s AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)),
w(start, id, hop) AS (SELECT 'region:' || r_regionkey, 'region:' || r_regionkey, 0 FROM region UNION SELECT start, dst, hop + 1 FROM w JOIN s ON src = id WHERE hop < 2)
SELECT start, id, min(hop)::INT AS hop, 0.8::DOUBLE AS confidence FROM w GROUP BY start, id HAVING min(hop) > 0""",
    "entity_search": f"""WITH {EDGES}, s AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)),
n AS (SELECT 'nation:' || n_nationkey AS node, lower(n_name) AS name FROM nation UNION ALL SELECT 'region:' || r_regionkey, lower(r_name) FROM region),
q AS (SELECT r_regionkey AS query_id, lower(r_name) AS entity FROM region UNION ALL SELECT n_nationkey + 100, 'in ' || lower(n_name) FROM nation),
st AS (SELECT DISTINCT query_id, node AS start FROM q, n WHERE contains(name, entity) OR contains(entity, name)),
pt AS (SELECT query_id, start, start AS node, 0 AS hops FROM st UNION ALL SELECT query_id, start, dst, 1 FROM st JOIN s ON src = start
 UNION ALL SELECT query_id, start, y.dst, 2 FROM st JOIN s x ON x.src = start JOIN s y ON y.src = x.dst),
best AS (SELECT query_id, start, node, min(hops) AS hops FROM pt GROUP BY ALL),
hit AS (SELECT query_id, node AS id, arg_min(CASE WHEN hops = 0 THEN 1.0 ELSE 0.4::DOUBLE / (hops + 1) END, (start, hops = 0, hops)) AS score FROM best WHERE node IN (SELECT src FROM e) GROUP BY query_id, node)
SELECT query_id, id, round(score, 9) AS score FROM hit QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 20""",
    "graph_shortest_path": """WITH RECURSIVE g AS (SELECT 'supplier:' || l_suppkey AS src, p_brand AS dst, 1 / greatest(count(*) / 100.0::DOUBLE, 0.01) AS step FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
s AS (SELECT * FROM g UNION ALL SELECT dst, src, step FROM g),
w(node, cost, hops) AS (SELECT 'supplier:0', 0::DOUBLE, 0 UNION ALL SELECT dst, cost + step, hops + 1 FROM w JOIN s ON src = node WHERE hops < 3)
SELECT node, arg_min(cost, (cost, hops)) AS cost, arg_min(hops, (cost, hops))::INT AS hops FROM w GROUP BY node""",
    "dedup_ttl": """WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT event_id, user_id, event_type, n, ts AS kept_at, true AS fresh FROM r WHERE n = 1
 UNION ALL SELECT r.event_id, r.user_id, r.event_type, r.n, CASE WHEN r.ts - f.kept_at >= INTERVAL 3600 SECONDS THEN r.ts ELSE f.kept_at END, r.ts - f.kept_at >= INTERVAL 3600 SECONDS
 FROM f JOIN r ON r.user_id = f.user_id AND r.event_type = f.event_type AND r.n = f.n + 1)
SELECT events.* FROM events JOIN f USING (event_id) WHERE f.fresh""",
    "chunk_pack": """WITH RECURSIVE r AS (SELECT conv_id, turn, ceil(length(coalesce(text, '')) / 3.0)::BIGINT AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
f AS (SELECT conv_id, turn, tokens, n, tokens AS used, 0 AS chunk FROM r WHERE n = 1
 UNION ALL SELECT r.conv_id, r.turn, r.tokens, r.n, CASE WHEN f.used + r.tokens > 200 THEN r.tokens ELSE f.used + r.tokens END, f.chunk + CASE WHEN f.used + r.tokens > 200 THEN 1 ELSE 0 END
 FROM f JOIN r ON r.conv_id = f.conv_id AND r.n = f.n + 1)
SELECT conv_id, turn, tokens, chunk FROM f""",
    "budget_pack": f"""{retrieval.BASE.replace('WITH d', 'WITH RECURSIVE d')}, lt AS ({retrieval.top_sql('e', 20)}),
h AS (SELECT query_id, lt.doc_id, ceil(length(coalesce(text, '')) / 3.0)::BIGINT AS tokens, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lt.doc_id) AS n FROM lt JOIN documents USING (doc_id)),
c AS (SELECT query_id, doc_id, n, CASE WHEN n = 1 THEN least(tokens, 2000) ELSE tokens END AS tokens FROM h),
k AS (SELECT query_id, doc_id, n, tokens AS used, tokens AS total, true AS took FROM c WHERE n = 1
 UNION ALL SELECT c.query_id, c.doc_id, c.n, c.tokens, k.total + CASE WHEN k.total + c.tokens <= 2000 THEN c.tokens ELSE 0 END, k.total + c.tokens <= 2000 FROM k JOIN c ON c.query_id = k.query_id AND c.n = k.n + 1)
SELECT query_id, doc_id, used FROM k WHERE took""",
    "token_sums": "SELECT lang, sum(ceil(length(coalesce(text, '')) / 3.0))::BIGINT AS n_tokens FROM documents GROUP BY lang",
    "content_fingerprints": "SELECT substring(sha256(text), 1, 16) AS fingerprint, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1",
}
