"""Scope, store, recall and context queries over the test tables, with their oracle SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import scoring, text
from palimpsest.operators import fusion, graph, hybrid, lexical, lifecycle, mining, recall, scope, store
from palimpsest.plans import retrieval
from palimpsest.plans.records import ctes, record
from palimpsest.sources.shared import written
from palimpsest.sources.tables import table
from palimpsest.streaming import marks

PROJECT = "BUILDING"
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    """Registers a query with its SQL."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- store


@query("SELECT k.item_id AS o_orderkey, o_custkey, o_orderstatus FROM (SELECT DISTINCT item_id FROM benchmark) k LEFT JOIN orders ON o_orderkey = k.item_id")
def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("o_orderkey"))
    return store.lookup(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), keys, "o_orderkey")


@query("SELECT DISTINCT source FROM documents WHERE starts_with(source, 'src1')")
def scopes_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.scopes_by_prefix(table(spark, sf_dir, "documents"), "source", "src1")


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey = 7")
def scopes_with_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.scopes_with_key(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", 7)


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written over customers: their keys overlap."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")


@query("""SELECT s_suppkey AS c_custkey, s_name AS c_name, s_nationkey AS c_nationkey, s_acctbal AS c_acctbal FROM supplier
 UNION ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def bulk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.upsert(customers(spark, sf_dir), changed(spark, sf_dir), "c_custkey")


@query("""WITH x AS (SELECT s_suppkey AS c_custkey, s_name AS c_name, s_nationkey AS c_nationkey, s_acctbal AS c_acctbal FROM supplier s LEFT JOIN customer c ON c.c_custkey = s.s_suppkey
 WHERE s.s_nationkey IS NOT DISTINCT FROM c.c_nationkey)
SELECT * FROM x UNION ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM x)""")
def conditional_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = changed(spark, sf_dir).withColumn("expected", F.col("c_nationkey"))
    return lifecycle.conditional_upsert(customers(spark, sf_dir), new, "c_custkey", "c_nationkey", "expected")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def bulk_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"))
    return store.delete(table(spark, sf_dir, "customer"), gone, "c_custkey").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = c.c_custkey AND s.s_nationkey = c.c_nationkey)")
def conditional_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.conditional_delete(customers(spark, sf_dir), changed(spark, sf_dir).withColumn("expected", F.col("c_nationkey")), "c_custkey", "c_nationkey", "expected").select("c_custkey")


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'blocked' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_acctbal < 0 THEN c_acctbal + 10 ELSE c_acctbal END AS c_acctbal,
 CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END AS c_name FROM customer""")
def patch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_name")
    return lifecycle.patch(rows, F.col("c_acctbal") < 0, sets={"c_mktsegment": F.lit("blocked")}, adds={"c_acctbal": 10}, removes=["c_name"])


@query(f"WITH {ctes('observations', 'memories')} SELECT id FROM observations WHERE id NOT IN (SELECT item_id FROM benchmark) AND session_id NOT IN (SELECT s_suppkey FROM supplier)")
def forget_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = record(spark, sf_dir, "memories")
    ids = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    return store.forget(record(spark, sf_dir, "observations"), memories, ids, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("session_id")))[0].select("id")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 50 OFFSET 100")
def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.page(table(spark, sf_dir, "orders"), [F.desc("o_totalprice"), "o_orderdate", "o_orderkey"], 50, 100).select("o_orderkey")


@query("SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(p_name)) ORDER BY p_partkey) AS r FROM part) WHERE r = 1")
def distinct_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.first_by_key(table(spark, sf_dir, "part"), F.lower(F.trim("p_name")), ["p_partkey"]).select("p_partkey", "p_name")


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) >= 2")
def shared_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.in_several(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("owner"), "l_partkey"), "l_partkey")


@query("""WITH l AS (SELECT user_id, list(props ORDER BY ts, event_id) AS props FROM events GROUP BY user_id)
SELECT user_id, array_to_string(list_reverse(list_slice(list_filter(list_reverse(props), lambda x, i: list_position(list_reverse(props), x) = i), 1, 5)), ';') AS kept FROM l""")
def tail_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    lists = events.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "props"))), lambda x: x.props).alias("props"))
    return lists.select("user_id", F.array_join(store.last_distinct(F.array().cast("array<string>"), F.col("props"), 5), ";").alias("kept"))


@query(f"""WITH {ctes('observations', 'memories')} SELECT type, count(*) AS n, count(narrative) AS n_narratives FROM (SELECT id, type, narrative FROM observations
 UNION ALL SELECT id, 'decision', content FROM memories) GROUP BY type""")
def joint_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = record(spark, sf_dir, "memories").withColumn("concepts", F.array("type"))
    both = store.joint_corpus(record(spark, sf_dir, "observations").select("id", "type", "narrative"), memories)
    return both.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count("narrative").alias("n_narratives"))


@query(f"WITH {ctes('memories')} SELECT id, session_id, created_at AS ts, 'decision' AS type, title, content AS narrative, content AS fact, strength AS importance FROM memories")
def memory_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.memory_documents(record(spark, sf_dir, "memories").withColumn("concepts", F.array("type")))
    return docs.select("id", "session_id", "ts", "type", "title", "narrative", F.col("facts")[0].alias("fact"), "importance")


@query(f"WITH {ctes('lessons')} SELECT id, left(content, 120) AS title, context AS narrative, CASE WHEN content = context THEN 0 ELSE 1 END AS n_facts FROM lessons")
def lesson_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.lesson_documents(record(spark, sf_dir, "lessons").withColumn("tags", F.array("tag")), slim=True)
    return docs.select("id", "title", "narrative", F.size("facts").alias("n_facts"))


# ---------------------------------------------------------------- scope


@query(f"WITH {ctes('memories')} SELECT id FROM memories WHERE coalesce(is_latest, true)")
def latest_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.latest_only(record(spark, sf_dir, "memories")).select("id")


@query("SELECT event_id FROM events WHERE NOT (starts_with(event_type, 'sign') OR starts_with(event_type, 'err'))")
def index_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.not_excluded(table(spark, sf_dir, "events"), "event_type", ["sign", "err"]).select("event_id")


MATCH = f"""(SELECT m.id, m.session_id, coalesce(m.is_global, false) OR coalesce(s.project, m.project, nullif(u.project, '')) IS NULL
  OR coalesce(s.project, m.project, nullif(u.project, '')) = '{PROJECT}' AS ok
 FROM memories m LEFT JOIN sessions s ON s.session_id = m.session_id LEFT JOIN summaries u ON u.session_id = m.session_id)"""


@query(f"WITH {ctes('memories', 'sessions', 'summaries')} SELECT id, session_id FROM {MATCH} WHERE ok")
def project_matcher(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = record(spark, sf_dir, "memories")
    return scope.in_project(memories.select("id", "session_id"), PROJECT, memories, record(spark, sf_dir, "sessions"), record(spark, sf_dir, "summaries"))


@query(f"WITH {ctes('memories')} SELECT id FROM memories WHERE agent_id = 'F' OR agent_id IS NULL")
def agent_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.by_agent(record(spark, sf_dir, "memories"), scope.agent_of(" F ", True, None), orphans=True).select("id")


@query(f"""WITH {ctes('observations', 'sessions')} SELECT id FROM observations o LEFT JOIN sessions s ON s.session_id = o.session_id
WHERE s.session_id IS NULL OR s.cwd = '/w/building/n3'""")
def cwd_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.by_cwd(record(spark, sf_dir, "observations"), record(spark, sf_dir, "sessions"), "/w/building/n3").select("id")


@query(f"{retrieval.BASE}, lt AS ({retrieval.top_sql('e', 100)}) SELECT query_id, doc_id, score FROM lt JOIN documents USING (doc_id) WHERE lang = 'en'")
def layer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.bm25_topk(spark, sf_dir, 100).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return scope.by_layer(hits, "memory", F.col("lang") == "en").select("query_id", "doc_id", "score")


@query(f"""{retrieval.BASE}, lt AS ({retrieval.top_sql('e', 100)}),
h AS (SELECT query_id, doc_id AS id, score, max(score) OVER (PARTITION BY query_id) AS best FROM lt JOIN documents USING (doc_id) WHERE source <> 'src3')
SELECT h.query_id, h.id, h.score FROM h JOIN documents d ON d.doc_id = h.id WHERE score >= greatest(5.0, 0.5 * best) AND coalesce(d.text, '') <> '' AND id NOT IN (SELECT item_id FROM benchmark)""")
def prompt_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("session_id"), F.col("text").alias("narrative"))
    hits = retrieval.bm25_topk(spark, sf_dir, 100).withColumnRenamed("doc_id", "id").join(docs, "id")
    seen = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    return scope.prompt_floor(hits, F.lit("src3"), seen).select("query_id", "id", "score")


@query(f"""WITH {ctes('memories')} SELECT id FROM memories WHERE project = '1-URGENT' AND type IN ('1-URGENT', '2-HIGH') AND created_at >= TIMESTAMP '1995-01-01' AND created_at <= TIMESTAMP '1998-01-01'
 AND strength < 4""")
def governance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return scope.governance(record(spark, sf_dir, "memories"), "1-URGENT", ["1-URGENT", "2-HIGH"], day("1995-01-01"), day("1998-01-01"), 4.0).select("id")


@query(f"""WITH {ctes('memories')} SELECT id FROM memories WHERE coalesce(is_latest, true) AND (agent_id = 'O' OR agent_id IS NULL) AND (project = '2-HIGH' OR coalesce(is_global, false))
ORDER BY created_at DESC, id LIMIT 40 OFFSET 20""")
def memory_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.memory_page(record(spark, sf_dir, "memories"), "2-HIGH", "O", True, 40, 20).select("id")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha"), F.col("o_orderstatus").alias("branch"), F.col("o_orderpriority").alias("repo"), F.col("o_orderdate").alias("linked_at"),
                                                 F.array("o_custkey").alias("sessions"))


@query("SELECT o_orderkey AS sha FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW' ORDER BY o_orderdate DESC, o_orderkey LIMIT 500")
def commit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.commit_page(commits(spark, sf_dir), "F", "5-LOW", 1000).select("sha")


@query(f"WITH {ctes('sessions')} SELECT session_id FROM sessions WHERE cwd = '/w/building' OR starts_with(cwd, '/w/building/') OR project = '/w/building' OR starts_with(project, '/w/building/')")
def branch_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.branch_sessions(record(spark, sf_dir, "sessions"), "/w/building").select("session_id")


TERSE = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in scope.TERSE_STOP) + "]"


@query(f"""SELECT conv_id, turn, len(list_filter(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9_./-]*[a-z0-9]|[a-z0-9]')),
 lambda t: length(t) >= 3 AND NOT list_contains({TERSE}, t))) < 3 AS terse FROM conversations""")
def terse_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", scope.is_terse(F.col("text")).alias("terse"))


@query("SELECT doc_id FROM documents WHERE contains(lower(coalesce(text, '')), 'license') OR contains(lower(coalesce(source, '')), 'license')")
def keyword_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(scope.has_keyword("License", "text", "source")).select("doc_id")


# ---------------------------------------------------------------- joins


@query(f"""WITH {ctes('observations', 'memories')}, h AS (SELECT item_id AS query_id, item_id AS id, 1.0::DOUBLE AS score FROM benchmark UNION ALL SELECT item_id, item_id * 100, 0.5 FROM benchmark)
SELECT h.query_id, h.id, h.score, CASE WHEN o.id IS NOT NULL THEN o.title ELSE m.title END AS title, CASE WHEN o.id IS NOT NULL THEN o.type ELSE m.type END AS type
FROM h LEFT JOIN observations o ON o.id = h.id LEFT JOIN memories m ON m.id = h.id WHERE o.id IS NOT NULL OR m.id IS NOT NULL""")
def hit_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    hits = items.select("query_id", F.col("query_id").alias("id"), F.lit(1.0).alias("score")).unionByName(items.select("query_id", (F.col("query_id") * 100).alias("id"), F.lit(0.5).alias("score")))
    return recall.enrich(hits, record(spark, sf_dir, "observations"), record(spark, sf_dir, "memories"), ["title", "type"])


@query(f"""WITH {ctes('memories', 'sessions', 'summaries')} SELECT m.session_id, replace(coalesce(s.project, u.project, concat(chr(0), m.session_id)), chr(0), '@') AS project
FROM (SELECT DISTINCT session_id FROM memories) m LEFT JOIN sessions s USING (session_id) LEFT JOIN summaries u USING (session_id)""")
def session_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recall.session_projects(record(spark, sf_dir, "memories"), record(spark, sf_dir, "sessions"), record(spark, sf_dir, "summaries"))
    return rows.select("session_id", F.replace("project", F.lit("\0"), F.lit("@")).alias("project"))


@query(f"""WITH {ctes('observations', 'summaries')} SELECT o.id, u.summary_id FROM observations o LEFT JOIN summaries u ON u.session_id = o.session_id
 AND CASE WHEN u.covered_through IS NOT NULL THEN o.ts < u.covered_through ELSE o.ts <= u.created_at END""")
def covering_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.covering_summary(record(spark, sf_dir, "observations"), record(spark, sf_dir, "summaries")).select("id", "summary_id")


@query(f"""WITH {ctes('observations', 'sessions')} SELECT DISTINCT l_orderkey AS memory_id, o.id AS observation_id, o.session_id, s.project FROM lineitem JOIN observations o ON o.id = l_partkey
LEFT JOIN sessions s ON s.session_id = o.session_id""")
def citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_partkey").alias("sources"))
    return recall.citations(memories, record(spark, sf_dir, "observations"), record(spark, sf_dir, "sessions"))


FACTS = "SELECT p.id, s.project FROM (SELECT DISTINCT l_orderkey AS id, l_suppkey AS session_id FROM lineitem) p JOIN sessions s USING (session_id)"


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_suppkey").alias("sessions"))


@query(f"WITH {ctes('sessions')}, c AS ({FACTS}) SELECT DISTINCT id FROM c WHERE project = '{PROJECT}'")
def facts_any_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.facts_in_project(order_facts(spark, sf_dir), record(spark, sf_dir, "sessions"), PROJECT).select("id")


@query(f"WITH {ctes('sessions')}, c AS ({FACTS}) SELECT id FROM c GROUP BY id HAVING bool_and(project <> 'x') AND max(project) = min(project) AND max(project) = '{PROJECT}'")
def facts_all_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.facts_in_project(order_facts(spark, sf_dir), record(spark, sf_dir, "sessions"), PROJECT, every=True).select("id")


@query(f"WITH {ctes('sessions')} SELECT o_orderkey AS sha, session_id, project FROM orders JOIN sessions ON session_id = o_custkey")
def commit_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.commits_with_sessions(commits(spark, sf_dir), record(spark, sf_dir, "sessions"))


def sourced(spark: SparkSession, sf_dir: str, k: int = 100) -> DataFrame:
    """Lexical hits with their source as the session."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("session_id"))
    return retrieval.bm25_topk(spark, sf_dir, k).withColumnRenamed("doc_id", "id").join(docs, "id").select("query_id", "id", "session_id", "score")


BEST = f"""{retrieval.BASE}, lt AS ({retrieval.top_sql('e', 100)}),
b AS (SELECT query_id, doc_id AS id, source AS session_id, score FROM (SELECT lt.*, source, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS r FROM lt JOIN documents USING (doc_id)) WHERE r = 1)"""


@query(f"{BEST} SELECT query_id, id, session_id, score FROM b")
def best_per_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.best_per_session(sourced(spark, sf_dir))


@query(f"""{BEST}, w AS (SELECT *, coalesce(max(CASE WHEN session_id = 'src1' THEN score END) OVER (PARTITION BY query_id), 0) AS own FROM b),
r AS (SELECT *, row_number() OVER x AS r, lead(score) OVER x AS next FROM w WHERE session_id <> 'src1' WINDOW x AS (PARTITION BY query_id ORDER BY score DESC, id))
SELECT query_id, id, session_id, score FROM r WHERE r = 1 AND score >= 0.35 * own AND (next IS NULL OR score >= 1.25 * next)""")
def amendment_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.amendment(sourced(spark, sf_dir).withColumn("own", F.lit("src1")), "own")


# ---------------------------------------------------------------- aggregates and order


@query("SELECT type, count(*) AS n_edges, count(DISTINCT src) AS n_sources FROM (SELECT event_type AS type, user_id AS src FROM events) GROUP BY type")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_stats(table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), F.col("user_id").alias("src")))


@query(f"WITH {ctes('memories')} SELECT count(*) AS n_latest, count(*) FILTER (WHERE project IS NULL AND NOT coalesce(is_global, false)) AS n_unscoped FROM memories WHERE coalesce(is_latest, true)")
def unscoped_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scope.latest_only(record(spark, sf_dir, "memories"))
    return rows.agg(F.count(F.lit(1)).alias("n_latest"), F.count_if(F.col("project").isNull() & ~F.coalesce("is_global", F.lit(False))).alias("n_unscoped"))


@query("SELECT event_type AS name, count(*) AS calls, count(*) FILTER (WHERE value < 20) AS succeeded, round(avg(value), 6) AS mean_latency FROM events GROUP BY event_type")
def function_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.call_metrics(table(spark, sf_dir, "events"), "event_type", F.col("value") < 20, "value")


@query("""WITH c AS (SELECT lang, w, count(*) AS n FROM (SELECT lang, source AS w FROM documents) GROUP BY lang, w),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS r FROM c)
SELECT d.lang AS team, d.n_members, d.n_items, r.w AS value, r.n FROM (SELECT lang, count(DISTINCT source) AS n_members, count(*) AS n_items FROM documents GROUP BY lang) d
JOIN r ON r.lang IS NOT DISTINCT FROM d.lang WHERE r.r <= 10""")
def team_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("team"), F.col("source").alias("member"), F.array("source").alias("values"))
    return mining.team_profile(rows)


@query("""WITH r AS (SELECT o_orderkey AS id, o_orderpriority AS title, o_custkey AS query_id, o_totalprice AS score, o_orderdate AS claimed FROM orders),
p AS (SELECT query_id, title, score, row_number() OVER (PARTITION BY query_id, title ORDER BY score DESC, id) AS n FROM r),
q AS (SELECT query_id, title, id, claimed, row_number() OVER (PARTITION BY query_id, title ORDER BY claimed DESC, score DESC, id) AS n FROM r)
SELECT query_id, id, title, claimed, p.score FROM q JOIN p USING (query_id, title, n)""")
def newest_first_within_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("claimed"))
    return recall.newest_first_within_title(hits, F.col("title"), "claimed")


@query("""WITH a AS (SELECT *, min(ts) OVER (PARTITION BY user_id) AS first, max(ts) OVER (PARTITION BY user_id) AS last FROM events)
SELECT event_id, CASE WHEN first = last THEN coalesce(sum(floor(value * 10)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
 ELSE (epoch_us(ts) - epoch_us(first)) // 1000 END::BIGINT AS offset_ms FROM a""")
def playback_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.operators import ordered

    return ordered.playback(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", F.floor(F.col("value") * 10)).select("event_id", "offset_ms")


@query("""SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) c
WHERE r > (SELECT coalesce(max(r2), 0) FROM (SELECT conv_id AS k, turn AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r2 FROM conversations) x WHERE x.k = c.conv_id AND x.t = 1)""")
def uncovered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.operators import ordered

    rows = table(spark, sf_dir, "conversations")
    covered = rows.where("turn = 1").select("conv_id", F.col("turn").alias("covered"))
    return ordered.after_covered(rows, covered, "conv_id", ["turn"], "turn").select("conv_id", "turn")


@query("SELECT p_partkey FROM part ORDER BY p_size DESC, p_retailprice DESC, p_partkey LIMIT 25")
def multi_key_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.page(table(spark, sf_dir, "part"), [F.desc("p_size"), F.desc("p_retailprice"), "p_partkey"], 25).select("p_partkey")


@query("SELECT o_orderkey FROM orders ORDER BY floor(o_totalprice / 50000 / 0.2) DESC, o_orderdate DESC, o_orderkey LIMIT 100")
def strength_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength in steps of 0.2, then recency: an order where the pairwise rule has none."""
    bucket = F.floor(F.col("o_totalprice") / 50000 / 0.2)
    return store.page(table(spark, sf_dir, "orders"), [bucket.desc(), F.desc("o_orderdate"), "o_orderkey"], 100).select("o_orderkey")


@query(f"""{retrieval.BASE}, lt AS ({retrieval.top_sql('e', 100)}) SELECT query_id, doc_id, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END, 6) AS score
FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM lt)""")
def min_max_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25_topk(spark, sf_dir, 100).withColumn("score", F.round(fusion.min_max(F.col("score")), 6))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS first_at, count(*) AS n FROM events GROUP BY 1")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks.windows(table(spark, sf_dir, "events"), "ts", "1 hour")


@query("""WITH m AS (SELECT user_id, max(ts) AS mark FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT event_id FROM events LEFT JOIN m USING (user_id) WHERE mark IS NULL OR ts > mark""")
def beyond_high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    held = marks.next_marks(events.where("event_type = 'signup'"), spark.createDataFrame([], "user_id long, mark timestamp_ntz"), "user_id", "ts")
    return marks.beyond_mark(events, held, "user_id", "ts").select("event_id")


@query("""WITH p AS (SELECT user_id, min(ts) AS oldest FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT event_id FROM events LEFT JOIN p USING (user_id) WHERE oldest IS NULL OR ts < oldest OR ts <= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 1 HOUR""")
def held_for_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return marks.ready(events, events.where("event_type = 'error'"), "user_id", "ts", F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("event_id")


@query("""WITH l AS (SELECT user_id, max(ts) AS listed_at FROM events GROUP BY user_id), p AS (SELECT user_id, min(ts) AS oldest FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT user_id, least(listed_at, coalesce(oldest, listed_at)) AS covered_through FROM l LEFT JOIN p USING (user_id)""")
def coverage_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return marks.coverage(events.groupBy("user_id").agg(F.max("ts").alias("listed_at")), events.where("event_type = 'error'"), "user_id", "ts")


@query("""WITH s AS (SELECT event_id, user_id, ts, CASE WHEN value > 30 THEN 'slow' ELSE 'healthy' END AS v FROM events),
a AS (SELECT *, CASE WHEN lag(v) OVER w IS DISTINCT FROM v THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a),
c AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) = 2 THEN v END AS switched FROM b)
SELECT event_id, coalesce(last_value(switched IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'healthy') AS verdict FROM c""")
def steady_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("value") > 30, "slow").otherwise("healthy"))
    return marks.steady(samples, "user_id", ["ts", "event_id"], "v", 2).select("event_id", "verdict")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def running_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks.running_counts(table(spark, sf_dir, "events"), "user_id")


# ---------------------------------------------------------------- text


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\\s*\\n+\\s*', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS line FROM documents")
def one_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.trim(text.one_line(F.col("text"))).alias("line"))


@query("SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages")
def xml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.xml_escaped(F.col("html")).alias("escaped"))


@query("""SELECT doc_id, left(text, 16000) AS clipped, CASE WHEN length(text) <= 80 THEN text ELSE left(text, 80) || '...' END AS head,
 CASE WHEN length(text) <= 2000 THEN text ELSE left(text, 997) || chr(10) || '...' || chr(10) || right(text, 997) END AS middle FROM documents""")
def truncations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.left(t, F.lit(16000)).alias("clipped"), text.shortened(t, 80).alias("head"), text.middle_out(t).alias("middle"))


@query(r"SELECT page_id, array_to_string(list_filter(list_transform(regexp_extract_all(html, '<p(?:\s[^>]*)?>([\s\S]*?)</p>', 1), lambda x: trim(x)), lambda x: NOT contains(x, '<')), '|') AS paragraphs FROM pages")
def xml_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.filter(text.xml_values(F.col("html"), "p"), lambda x: ~F.contains(x, F.lit("<")))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(found, "|").alias("paragraphs"))


# ---------------------------------------------------------------- recalls


@query(f"""{retrieval.BASE}, {ctes('lessons')}, lt AS (SELECT query_id, doc_id, round(score, 6) AS score FROM e),
sc AS (SELECT query_id, l.id, round(confidence * (score / max(score) OVER (PARTITION BY query_id)) / (1 + 0.01 * days), 3) AS score, confidence, project FROM lt LEFT JOIN lessons l ON l.id = lt.doc_id),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM sc WHERE id IS NOT NULL AND confidence >= 0.2 AND (project IS NULL OR project = 'PROMO'))
SELECT query_id, id, score FROM t WHERE r <= 10""")
def lesson_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by id are the lessons' texts."""
    hits = retrieval.bm25_topk(spark, sf_dir, None).withColumnRenamed("doc_id", "id")
    return recall.lesson_recall(hits, record(spark, sf_dir, "lessons").select("id", "project", "confidence", "days"), "PROMO", 0.2)


@query(f"WITH {ctes('lessons')} SELECT id, round((CASE WHEN project = 'PROMO' THEN 1.5 ELSE 1.0 END) * confidence / (1 + 0.01 * days), 6) AS score FROM lessons")
def lesson_context_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.lesson_rank(record(spark, sf_dir, "lessons"), "PROMO")


def asked_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand and type asks for the words of its own name."""
    parts = table(spark, sf_dir, "part")
    return parts.select(F.lower(F.concat_ws(" ", F.element_at(F.split("p_name", " "), 1), "p_type", F.lit("x"))).alias("text")).distinct().select(F.col("text").alias("query_id"), "text")


ASKED = "SELECT DISTINCT lower(concat_ws(' ', string_split(p_name, ' ')[1], p_type, 'x')) AS query_id FROM part"


def share_sql(longer: int, weight: str, aged: str, match: str) -> str:
    return f"""WITH {ctes('lessons')}, q AS ({ASKED}), t AS (SELECT query_id, list_distinct(list_filter(string_split(query_id, ' '), lambda x: length(x) > {longer})) AS terms FROM q),
m AS (SELECT query_id, id, len(list_filter(terms, lambda x: {match})) AS n, len(terms) AS k, confidence, days FROM t, (SELECT *, lower(concat_ws(' ', content, context)) AS body FROM lessons)),
s AS (SELECT query_id, id, round({weight} * (n / k){aged}, 6) AS score FROM m WHERE n > 0)
SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s) WHERE r <= 10"""


def shares(spark: SparkSession, sf_dir: str, longer: int, days: str | None, starts: bool) -> DataFrame:
    rows = record(spark, sf_dir, "lessons")
    terms = recall.semantic_terms(F.col("text")) if starts else recall.split_terms(F.col("text"), longer)
    return recall.share_search(asked_words(spark, sf_dir), terms, rows, F.concat_ws(" ", "content", "context"), "confidence", days, starts)


@query(share_sql(1, "confidence", " / (1 + 0.01 * days)", "contains(body, x)"))
def insight_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(spark, sf_dir, 1, "days", False)


@query(share_sql(2, "confidence", "", "contains(body, x)"))
def skill_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(spark, sf_dir, 2, None, False)


@query(share_sql(1, "confidence", "", "regexp_matches(body, '(^|[^a-z0-9])' || x)"))
def semantic_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(spark, sf_dir, 1, None, True)


@query("""WITH m AS (SELECT l_orderkey AS id, list(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY l_orderkey), o AS (SELECT o_orderkey AS id, o_custkey, epoch(TIMESTAMP '2002-01-01' - o_orderdate) / 86400 AS age FROM orders),
r AS (SELECT o_custkey, id, lead(id) OVER (PARTITION BY o_custkey ORDER BY id) AS other FROM o)
SELECT r.id, r.other, round(greatest(0, least(1, 0.5::DOUBLE + least(0.1 * len(list_intersect(coalesce(a.s, []), coalesce(b.s, []))), 0.3)
 + CASE WHEN x.age < 7 AND y.age < 7 THEN 0.1 WHEN x.age > 90 AND y.age > 90 THEN -0.1 ELSE 0 END + 0.1)), 6) AS confidence
FROM r JOIN o x ON x.id = r.id JOIN o y ON y.id = r.other LEFT JOIN m a ON a.id = r.id LEFT JOIN m b ON b.id = r.other""")
def relation_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_suppkey").alias("s"))
    now = F.lit("2002-01-01").cast("timestamp_ntz")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", scoring.age_days(F.col("o_orderdate"), now).alias("age")).join(lists, "id", "left")
    rows = rows.withColumn("s", F.coalesce("s", F.array().cast("array<bigint>")))
    pairs = rows.withColumn("o", F.lead(F.struct("id", "age", "s")).over(Window.partitionBy("o_custkey").orderBy("id"))).where("o IS NOT NULL")
    value = scoring.relation_confidence(F.size(F.array_intersect("s", "o.s")), F.col("age"), F.col("o.age"), F.lit("supersedes"))
    return pairs.select("id", F.col("o.id").alias("other"), F.round(value, 6).alias("confidence"))


@query(f"WITH {ctes('lessons')} SELECT id, round(0.5 * (confidence * 10) / 10 + 0.3 / (1 + 0.1 * days) + 0.2 * log2(id + 1) / 10, 6) AS score FROM lessons")
def core_entry_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record(spark, sf_dir, "lessons").select("id", F.round(scoring.core_entry(F.col("confidence") * 10, F.col("days"), F.col("id")), 6).alias("score"))


@query(f"""WITH {ctes('lessons')}, t AS (SELECT id, project, days, score, sum(tokens) OVER (PARTITION BY project ORDER BY score DESC, id) AS upto FROM
 (SELECT *, round(confidence / (1 + 0.1 * days), 6) AS score, ceil(length(content) / 3.0)::BIGINT AS tokens FROM lessons)) SELECT id FROM t WHERE upto <= 300""")
def working_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.operators import ordered

    rows = record(spark, sf_dir, "lessons").select("id", "project", F.round(F.col("confidence") / (1 + 0.1 * F.col("days")), 6).alias("score"), text.token_estimate(F.col("content")).alias("tokens"))
    return ordered.within_budget(rows, "project", [F.desc("score"), "id"], "tokens", 300).select("id")


# ---------------------------------------------------------------- composed searches


def sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions and summaries by source, and documents as memories: the project is the language most of a session's documents have."""
    docs = table(spark, sf_dir, "documents")
    labels = docs.join(table(spark, sf_dir, "labels").select("doc_id", "toxic").distinct(), "doc_id")
    sessions = labels.where("toxic = 1").groupBy(F.col("source").alias("session_id")).agg(F.min("lang").alias("project"))
    summaries = labels.where("toxic = 0").groupBy(F.col("source").alias("session_id")).agg(F.max("lang").alias("project"))
    return sessions, summaries, docs.select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("project"), (F.col("lang") == "fr").alias("is_global"))


SOURCES = """s2 AS (SELECT source AS session_id, min(lang) AS project FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY source),
u2 AS (SELECT source AS session_id, max(lang) AS project FROM documents JOIN labels USING (doc_id) WHERE toxic = 0 GROUP BY source),
ok AS (SELECT d.doc_id FROM documents d LEFT JOIN s2 ON s2.session_id = d.source LEFT JOIN u2 ON u2.session_id = d.source
 WHERE d.lang IS NOT DISTINCT FROM 'fr' OR coalesce(s2.project, u2.project) IS NULL OR coalesce(s2.project, u2.project) = 'en')"""


@query(f"""{retrieval.BASE}, {SOURCES}, h AS (SELECT query_id, doc_id, round(score, 6) AS score, max(round(score, 6)) OVER (PARTITION BY query_id) AS best FROM e WHERE doc_id IN (SELECT doc_id FROM ok)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM h WHERE score >= greatest(3.5, 0.5 * best))
SELECT query_id, doc_id AS id, rank, score FROM r WHERE rank <= 10""")
def search_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical search in a project: scope, then floor, then limit."""
    sessions, summaries, memories = sources(spark, sf_dir)
    hits = sourced(spark, sf_dir, None)
    scoped = scope.in_project(hits, "en", memories, sessions, summaries)
    floor = fusion.relevance_floor(scoped.withColumn("cosine", F.lit(None).cast("double")))
    return recall.page(floor, None, 10, None)


HYBRID_NOW = "2024-01-01 00:00:00"


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: a day for each of the ids of its last thousand."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.col("source").alias("session_id"), F.timestamp_seconds(F.lit(1_704_067_200) - F.pmod(F.col("doc_id"), F.lit(1000)) * 86_400).cast("timestamp_ntz").alias("ts"),
                       F.col("lang").alias("kind"), F.col("text").alias("body"))


def in_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id) of the documents of the project ``en``."""
    sessions, summaries, memories = sources(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("session_id"))
    return scope.in_project(docs, "en", memories, sessions, summaries).select("id")


def scoped_legs(spark: SparkSession, sf_dir: str, tied: bool) -> dict[str, DataFrame]:
    docs = table(spark, sf_dir, "documents").where("source IS NOT NULL AND lang IS NOT NULL")
    source = lambda: F.concat(F.lit("source:"), "source")
    graph_parts = None
    if tied:  # sources and languages are the nodes, and a query names the source with its own number
        nodes = docs.select(source().alias("node"), F.col("source").alias("name")).distinct()
        edges = docs.select(source().alias("src"), F.concat(F.lit("lang:"), "lang").alias("dst"), F.lit(0.5).alias("weight")).distinct()
        names = docs.select("source").distinct().select("source", F.regexp_extract("source", r"(\d+)$", 1).alias("_n"))
        entities = retrieval.asked(spark, sf_dir).join(names, F.col("query_id").cast("string") == F.col("_n")).select("query_id", F.col("source").alias("entity"))
        graph_parts = nodes, edges, entities, docs.select(source().alias("node"), F.col("doc_id").alias("id"))
    return hybrid.legs(retrieval.document_index(spark, sf_dir), retrieval.asked(spark, sf_dir), 100, 20, written(in_english(spark, sf_dir), "in-scope"), table(spark, sf_dir, "embeddings"), retrieval.item_vectors(spark, sf_dir), graph_parts)


@query(f"""{retrieval.BASE}, {retrieval.VECTOR_LEG}, {SOURCES}, e1 AS (SELECT * FROM e WHERE doc_id IN (SELECT doc_id FROM ok)), v1 AS (SELECT * FROM vl WHERE doc_id IN (SELECT doc_id FROM ok)),
lt AS ({retrieval.top_sql('e1', 100)}), vt AS ({retrieval.top_sql('v1', 100)}),
parts AS (SELECT query_id, doc_id, 0.4 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)) AS part, 0.0 AS w FROM lt
 UNION ALL SELECT query_id, doc_id, 0.6 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)), 0.6 FROM vt),
tot AS (SELECT query_id, 0.4 + max(w) AS total FROM parts GROUP BY query_id),
fused AS (SELECT query_id, doc_id, source, round(sum(part) / any_value(total), 9) AS score FROM parts JOIN tot USING (query_id) JOIN documents USING (doc_id) GROUP BY query_id, doc_id, source),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) > 3 AS over FROM fused),
hp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY over, score DESC, doc_id) AS n FROM o) WHERE n <= 20),
g AS (SELECT query_id, doc_id AS id, round(score * CASE WHEN doc_id % 1000 = 0 THEN 1.0::DOUBLE ELSE 0.6::DOUBLE + 0.4::DOUBLE * pow(0.5::DOUBLE, (doc_id % 1000) / 180.0) END, 9) AS score FROM hp),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM g)
SELECT query_id, id, rank::INT AS rank, score FROM r WHERE rank <= 10""")
def hybrid_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two legs in a project, fused, spread over sources and aged."""
    found = scoped_legs(spark, sf_dir, False)
    return hybrid.hybrid_search(found, document_records(spark, sf_dir), F.lit(HYBRID_NOW).cast("timestamp_ntz"), 10, twins=False).select("query_id", "id", "rank", "score")


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three legs in a project, fused, spread over sources, aged and capped behind newer twins."""
    return hybrid.hybrid_search(scoped_legs(spark, sf_dir, True), document_records(spark, sf_dir), F.lit(HYBRID_NOW).cast("timestamp_ntz"), 10)


QUERIES["hybrid_search"] = hybrid_search


def smart_search(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """Three legs in a project, above the floor, newer records above those they repeat, with lessons."""
    return hybrid.smart_search(scoped_legs(spark, sf_dir, True), document_records(spark, sf_dir), F.lit(HYBRID_NOW).cast("timestamp_ntz"), k, {"lesson": lesson_recall(spark, sf_dir)})


QUERIES["smart_search"] = smart_search


@query(f"""WITH {ctes('observations')}, f AS (SELECT DISTINCT title AS file FROM observations), n AS (SELECT session_id, row_number() OVER (ORDER BY first DESC, session_id) AS recency FROM
 (SELECT session_id, min(ts) AS first FROM observations GROUP BY session_id) QUALIFY recency <= 15),
r AS (SELECT title AS file, id, importance, row_number() OVER (PARTITION BY title ORDER BY importance DESC, recency, id) AS rank FROM observations JOIN n USING (session_id) WHERE importance >= 1)
SELECT file, id, importance, rank FROM r WHERE rank <= 5""")
def file_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = record(spark, sf_dir, "observations").withColumn("files", F.array("title"))
    paths = rows.select(F.col("title").alias("path")).distinct()
    touched = lifecycle.suffix_join(paths, paths)
    started = rows.groupBy("session_id").agg(F.min("ts").alias("first")).orderBy(F.desc("first"), "session_id").limit(15)
    from pyspark.sql import Window

    recent = started.select("session_id", F.row_number().over(Window.orderBy(F.desc("first"), "session_id")).alias("recency"))
    return recall.file_context(paths.withColumnRenamed("path", "file"), rows, touched, recent, least=1)


HIGHLIGHTS = """hl AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY importance DESC, ts DESC, id) AS rank FROM observations WHERE title IS NOT NULL AND title <> '' AND trim(narrative) <> '' QUALIFY rank <= 5)"""


@query(f"WITH {ctes('observations')}, {HIGHLIGHTS} SELECT session_id, id, rank FROM hl")
def session_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.session_highlights(record(spark, sf_dir, "observations")).select("session_id", "id", "rank")


BLOCKS = f"""WITH {ctes('observations', 'sessions', 'summaries')}, {HIGHLIGHTS},
rs AS (SELECT project, session_id, row_number() OVER (PARTITION BY project ORDER BY started_at DESC, session_id) AS rank FROM sessions QUALIFY rank <= 10),
sh AS (SELECT session_id, string_agg('- [' || type || '] ' || title || ': ' || narrative, chr(10) ORDER BY rank) AS shown FROM hl GROUP BY session_id),
bl AS (SELECT project, session_id, CASE WHEN u.body IS NOT NULL THEN 'summary' ELSE 'observation' END AS kind, '## Session ' || session_id || chr(10) || coalesce(u.body, shown) AS content, rank
 FROM rs LEFT JOIN summaries u USING (session_id) LEFT JOIN sh USING (session_id) WHERE u.body IS NOT NULL OR shown IS NOT NULL)"""


@query(f"{BLOCKS} SELECT *, ceil(length(content) / 3.0)::BIGINT AS tokens FROM bl".replace("project, session_id, CASE WHEN u.body", "rs.project, rs.session_id, CASE WHEN u.body"))
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.context_blocks(record(spark, sf_dir, "sessions").select("session_id", "project", "started_at"), record(spark, sf_dir, "summaries").select("session_id", "body"),
                                 recall.session_highlights(record(spark, sf_dir, "observations")))


def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of each project that fit a budget of tokens, newest first."""
    from palimpsest.operators import ordered

    return ordered.greedy_pack(context_blocks(spark, sf_dir), "project", "rank", "session_id", "tokens", 120)


QUERIES["context_pack"] = context_pack
