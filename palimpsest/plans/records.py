"""Record kinds derived from the test tables by SQL that Spark and DuckDB both run.

Events play observations, customers sessions and summaries, orders memories and
commits, parts lessons, skills and facts.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.sources.tables import table

VIEWS = {
    "observations": ("events", """SELECT event_id AS id, user_id AS session_id, event_id AS ts, event_type AS type, props AS title,
        CASE WHEN event_type = 'signup' THEN NULL ELSE concat(event_type, ' ', props) END AS narrative, CAST(floor(value / 50) AS INT) AS importance,
        CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS agent_id FROM {events}"""),
    "sessions": ("customer", """SELECT c_custkey AS session_id, c_mktsegment AS project, concat('/w/', lower(c_mktsegment), '/n', c_nationkey) AS cwd, c_custkey AS started_at
        FROM {customer} WHERE c_acctbal >= 0"""),
    "summaries": ("customer", """SELECT c_custkey AS session_id, c_custkey AS summary_id, CASE WHEN c_nationkey < 3 THEN '' ELSE c_mktsegment END AS project,
        CASE WHEN c_nationkey < 12 THEN 40 * c_nationkey END AS covered_through, 10 * c_nationkey AS created_at, concat('summary of ', c_name) AS body FROM {customer} WHERE c_acctbal < 4000"""),
    "memories": ("orders", """SELECT o_orderkey AS id, o_custkey AS session_id, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderpriority END AS project, o_orderstatus = 'P' AS is_global,
        CASE WHEN o_orderstatus = 'F' THEN false WHEN o_orderstatus = 'O' THEN true END AS is_latest, o_orderdate AS created_at, o_totalprice / 50000 AS strength, o_orderpriority AS type,
        concat('order ', o_orderkey) AS title, concat('order of ', o_custkey, ' for ', o_orderpriority) AS content, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS agent_id FROM {orders}"""),
    "lessons": ("part", """SELECT p_partkey AS id, p_name AS content, CASE WHEN p_size < 10 THEN p_name ELSE p_type END AS context, p_brand AS tag, CASE WHEN p_size > 40 THEN NULL ELSE p_type END AS project,
        p_size / 50.0E0 AS confidence, p_retailprice / 10 AS days FROM {part}"""),
}


def record(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, sql = VIEWS[name]
    return spark.sql(sql, **{source: table(spark, sf_dir, source)})


def ctes(*names: str) -> str:
    return ", ".join(f"{n} AS ({VIEWS[n][1].format(**{VIEWS[n][0]: VIEWS[n][0]})})" for n in names)
