"""Table loading, and the football-shaped views that the queries read.

A view is one SELECT over the star schema and the event stream: orders are matches, line items shots, customers
teams, suppliers players, region and order year a competition's season. The text runs on Spark and on DuckDB alike,
so both sides of a correctness check see the same rows; what is checked, the operators, is written twice.
"""

from __future__ import annotations

from functools import cache
from string import Formatter

from pyspark.sql import DataFrame, SparkSession

from .shared import shares

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "matches": """
SELECT o.o_orderkey AS match_id, CAST(o.o_orderdate AS DATE) AS match_date, CAST(n.n_regionkey AS BIGINT) AS competition_id, CAST(year(o.o_orderdate) AS BIGINT) AS season_id,
 o.o_custkey AS home_team_id, CASE WHEN o.o_custkey > 1 THEN o.o_custkey - 1 ELSE 2 END AS away_team_id,
 o.o_orderkey % 5 AS home_score, nullif((o.o_orderkey + 2) % 7, 6) AS away_score, CASE WHEN o.o_orderkey % 10 = 0 THEN NULL ELSE o.o_orderpriority END AS stage_name
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey""",
    "shots": """
SELECT (l.l_orderkey * 10 + l.l_linenumber) * 100000 + l.l_partkey % 100000 AS event_id, l.l_orderkey AS match_id, CAST(l.l_linenumber AS BIGINT) AS event_index,
 CASE WHEN l.l_linenumber % 2 = 1 THEN o.o_custkey WHEN o.o_custkey > 1 THEN o.o_custkey - 1 ELSE 2 END AS team_id,
 CASE WHEN l.l_partkey % 97 = 0 THEN NULL ELSE l.l_suppkey END AS player_id,
 CAST(nullif(l.l_linenumber % 6, 0) AS BIGINT) AS period, l.l_partkey % 95 AS minute, l.l_suppkey % 60 AS second,
 CASE WHEN l.l_partkey % 53 = 0 THEN NULL WHEN l.l_returnflag = 'R' THEN 'Goal' WHEN l.l_returnflag = 'A' THEN 'Saved' ELSE 'Off T' END AS outcome_name,
 CASE WHEN l.l_partkey % 61 = 0 THEN NULL WHEN l.l_partkey % 20 = 0 THEN 'Penalty' WHEN l.l_partkey % 20 = 1 THEN 'Free Kick' ELSE 'Open Play' END AS shot_type_name,
 CASE WHEN l.l_partkey % 31 = 0 THEN NULL WHEN l.l_suppkey % 4 = 0 THEN 'Head' WHEN l.l_suppkey % 4 = 1 THEN 'Left Foot' ELSE 'Right Foot' END AS body_part_name,
 CASE WHEN l.l_partkey % 7 = 0 THEN 'Volley' WHEN l.l_partkey % 7 = 1 THEN 'Half Volley' WHEN l.l_partkey % 97 = 2 THEN 'Backheel' ELSE 'Normal' END AS technique_name,
 CASE (l.l_orderkey + l.l_linenumber) % 6 WHEN 1 THEN 'From Counter' WHEN 2 THEN 'From Corner' WHEN 3 THEN 'From Throw In' WHEN 4 THEN NULL ELSE 'Regular Play' END AS play_pattern_name,
 CASE WHEN l.l_partkey % 3 = 0 THEN true END AS under_pressure, CASE WHEN l.l_suppkey % 5 = 0 THEN true END AS first_time, CASE WHEN l.l_partkey % 9 = 0 THEN true WHEN l.l_partkey % 9 = 1 THEN false END AS open_goal,
 CASE WHEN l.l_partkey % 83 = 0 THEN NULL ELSE CAST((l.l_orderkey * 7 + l.l_linenumber * 131) % 1202 AS DOUBLE) / CAST(10 AS DOUBLE) END AS x,
 CASE WHEN l.l_partkey % 83 <= 1 THEN NULL ELSE CAST((l.l_partkey * 13 + l.l_linenumber) % 801 AS DOUBLE) / CAST(10 AS DOUBLE) END AS y,
 CAST(l.l_quantity AS DOUBLE) AS end_x, CAST(l.l_partkey % 90 AS DOUBLE) AS end_y, CASE WHEN l.l_partkey % 2 = 0 THEN CAST(l.l_partkey % 5 AS DOUBLE) END AS end_z,
 CASE WHEN l.l_partkey % 4 = 0 THEN NULL ELSE l.l_tax * CAST(10 AS DOUBLE) END AS duration
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey""",
    "memberships": """
SELECT DISTINCT l.l_orderkey AS match_id, CASE WHEN l.l_linenumber % 2 = 1 THEN o.o_custkey WHEN o.o_custkey > 1 THEN o.o_custkey - 1 ELSE 2 END AS team_id, l.l_suppkey AS player_id
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey WHERE l.l_partkey % 11 <> 0""",
    "positions": """
SELECT l.l_orderkey AS match_id, CASE WHEN l.l_linenumber % 2 = 1 THEN o.o_custkey WHEN o.o_custkey > 1 THEN o.o_custkey - 1 ELSE 2 END AS team_id, l.l_suppkey AS player_id,
 row_number() OVER (PARTITION BY l.l_orderkey, l.l_linenumber % 2, l.l_suppkey ORDER BY l.l_linenumber, l.l_partkey, l.l_quantity) AS source_order, CASE WHEN l.l_partkey % 3 = 0 THEN 'Forward' ELSE 'Midfield' END AS position_name,
 lpad(CAST(l.l_partkey % 95 AS VARCHAR(9)), 2, '0') || ':' || lpad(CAST(l.l_suppkey % 61 AS VARCHAR(9)), 2, '0') AS from_clock
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey WHERE l.l_partkey % 11 <> 0 AND l.l_linenumber <= 3""",
    "stream": """
SELECT event_id, user_id AS match_id, CAST(ts AS DATE) AS possession_id, event_id AS event_index, event_type AS type_name, CAST(event_id % 3 AS BIGINT) AS team_id,
 CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(user_id % 40 AS BIGINT) END AS player_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS duration,
 CASE WHEN event_id % 50 = 0 THEN NULL ELSE value END AS x, props FROM {events}""",
    "relations": """
SELECT event_id AS source_event_id, CASE WHEN event_id % 17 = 0 THEN -event_id ELSE event_id + 1 END AS related_event_id, CAST(1 AS BIGINT) AS source_order FROM {events} WHERE event_id % 2 = 0
UNION ALL SELECT event_id, CASE WHEN event_id > 2 THEN event_id - 2 ELSE event_id END, CAST(2 AS BIGINT) FROM {events} WHERE event_id % 6 = 0""",
    "scored": """
SELECT event_id AS row_id, user_id AS cluster_id, user_id % 5 AS fold, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y, least(greatest(value, CAST(0 AS DOUBLE)) / CAST(500 AS DOUBLE), CAST(1 AS DOUBLE)) AS p,
 least(greatest(round(value, 0), CAST(0 AS DOUBLE)) / CAST(400 AS DOUBLE), CAST(1 AS DOUBLE)) AS p_other, event_type AS type_name FROM {events}""",
}


def fields(sql: str) -> list[str]:
    return sorted({name for _, name, _, _ in Formatter().parse(sql) if name})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a lazy DataFrame. Line items of large tables are dealt out by order, and other shuffles begin, with so
    many partitions that a task's share doesn't grow with the tables."""
    sql = VIEWS[name]
    n = shares(spark, *(f"{sf_dir}/{t}.parquet" for t in fields(sql)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", n)
    if "lineitem" in fields(sql) and n > int(spark.conf.get("spark.sql.shuffle.partitions")):
        return dealt(spark, sf_dir, name)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in fields(sql)})


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over line items that are dealt out by their order first, into shares that don't grow with the table: what is
    grouped by match after it needs no other shuffle."""
    n = shares(spark, *(f"{sf_dir}/{t}.parquet" for t in ("lineitem", "orders")))
    return spark.sql(VIEWS[name], lineitem=table(spark, sf_dir, "lineitem").repartition(n, "l_orderkey"), orders=table(spark, sf_dir, "orders"))


@cache
def _cte(name: str) -> str:
    return f"{name} AS ({VIEWS[name].format(**{t: t for t in TABLES}).strip()})"


def sql_over(*names: str, body: str) -> str:
    """SQL for DuckDB: the named views as common table expressions (already with a comma if body starts with one)."""
    body = body.strip()
    return "WITH " + ", ".join(_cte(n) for n in names) + (body if body.startswith(",") else "\n" + body)
