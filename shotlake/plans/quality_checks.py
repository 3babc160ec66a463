"""Expectation suites and reconciliation reports over the views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json_text import has_key
from ..operators import quality as Q
from ..registry import query
from ..sources import documents as D
from ..sources.tables import sql_over, table, view
from .cohort import SCOPE_SQL, SCOPES
from .grains import grain_sql, grains
from .normalization import documents

# Rule names with their conditions in SQL that both engines read alike.
SHOT_RULES = {
    "ids_positive": "event_id > 0 AND match_id > 0", "period_range": "period BETWEEN 1 AND 5", "second_range": "second BETWEEN 0 AND 59", "minute_not_negative": "minute >= 0", "duration_not_negative": "duration >= 0",
    "location_complete": "(x IS NULL) = (y IS NULL)", "x_bounds": "x BETWEEN 0 AND 120", "y_bounds": "y BETWEEN 0 AND 80", "type_not_blank": "trim(shot_type_name) <> ''", "order_positive": "event_index > 0",
}
MATCH_RULES = {"distinct_teams": "home_team_id <> away_team_id", "score_complete": "(home_score IS NULL) = (away_score IS NULL)", "score_not_negative": "home_score >= 0 AND coalesce(away_score, 0) >= 0", "dated": "match_date IS NOT NULL"}


def rules_sql(rules: dict[str, str], source: str, value: str = "violations") -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS name, count(*) FILTER (WHERE NOT ({r})) AS {value} FROM {source}" for k, r in rules.items())


@query(sql_over("shots", "matches", body=rules_sql(SHOT_RULES, "shots") + " UNION ALL " + rules_sql(MATCH_RULES, "matches")))
def expect_row_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = Q.expect_rules(view(spark, sf_dir, "shots"), {k: F.expr(r) for k, r in SHOT_RULES.items()})
    return shots.unionByName(Q.expect_rules(view(spark, sf_dir, "matches"), {k: F.expr(r) for k, r in MATCH_RULES.items()}))


UNIQUE = {"shots": ("shots", ["event_id"]), "matches": ("matches", ["match_id"]), "relations_order": ("relations", ["source_event_id", "source_order"]), "positions": ("positions", ["match_id", "team_id", "player_id", "source_order"]), "shot_players": ("shots", ["match_id", "player_id"])}


@query(sql_over("shots", "matches", "relations", "positions", body=" UNION ALL ".join(f"SELECT '{k}' AS name, count(*) FILTER (WHERE k > 1) AS violations FROM (SELECT count(*) AS k FROM {t} GROUP BY {', '.join(c)})" for k, (t, c) in UNIQUE.items())))
def expect_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.union_all([Q.expect_unique(view(spark, sf_dir, t), c, k) for k, (t, c) in UNIQUE.items()])


@query(sql_over("shots", "memberships", "positions", body="""
SELECT 'shot_membership' AS name, count(*) AS violations FROM shots s WHERE player_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM memberships m WHERE m.match_id = s.match_id AND m.team_id = s.team_id AND m.player_id = s.player_id)
UNION ALL SELECT 'position_membership', count(*) FROM positions s WHERE NOT EXISTS (SELECT 1 FROM memberships m WHERE m.match_id = s.match_id AND m.team_id = s.team_id AND m.player_id = s.player_id)
UNION ALL SELECT 'shot_team', count(*) FROM shots s WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = team_id)"""))
def expect_foreign_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["match_id", "team_id", "player_id"]
    shots, members = view(spark, sf_dir, "shots"), view(spark, sf_dir, "memberships")
    return Q.union_all([Q.expect_foreign_key(shots, key, members, key, "shot_membership"), Q.expect_foreign_key(view(spark, sf_dir, "positions"), key, members, key, "position_membership"), Q.expect_foreign_key(shots, ["team_id"], table(spark, sf_dir, "customer"), ["c_custkey"], "shot_team")])


@query(sql_over("matches", "shots", "memberships", "positions", body=grain_sql(f"JOIN {SCOPE_SQL} USING (competition_id, season_id)")))
def scoped_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all sixteen grains within the chosen seasons."""
    return Q.row_counts(grains(spark, sf_dir, spark.createDataFrame(SCOPES, "competition_id int, season_id int")))


@query(sql_over("matches", "memberships", body=", t AS (SELECT DISTINCT match_id, team_id FROM memberships) SELECT match_id, count(team_id) AS teams FROM matches LEFT JOIN t USING (match_id) GROUP BY 1 HAVING count(team_id) <> 2"))
def matches_without_two_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    teams = view(spark, sf_dir, "memberships").select("match_id", "team_id").distinct()
    return view(spark, sf_dir, "matches").select("match_id").join(teams, "match_id", "left").groupBy("match_id").agg(F.count("team_id").alias("teams")).filter("teams <> 2")


@query(sql_over("shots", body="""
SELECT 'time' AS name, count(*) FILTER (WHERE NOT coalesce(minute BETWEEN 0 AND 90, true) OR NOT coalesce(second BETWEEN 0 AND 59, true) OR (minute IS NULL) <> (second IS NULL)) AS n FROM shots
UNION ALL SELECT 'location', count(*) FILTER (WHERE NOT coalesce(x BETWEEN 0 AND 120, true) OR NOT coalesce(y BETWEEN 0 AND 80, true) OR (x IS NULL) <> (y IS NULL)) FROM shots
UNION ALL SELECT 'end_location', count(*) FILTER (WHERE NOT coalesce(end_x BETWEEN 0 AND 120, true) OR NOT coalesce(end_y BETWEEN 0 AND 80, true) OR (end_x IS NULL) <> (end_y IS NULL)) FROM shots
UNION ALL SELECT 'freeze_frame', 2 * count(*) FILTER (WHERE NOT coalesce(x BETWEEN 0 AND 120, true) OR NOT coalesce(y BETWEEN 0 AND 80, true) OR (x IS NULL) <> (y IS NULL)) FROM shots WHERE event_index % 2 = 0"""))
def out_of_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    actors = Q.out_of_bounds(D.explode_freeze_frame(documents(spark, sf_dir, "events")), {"freeze_frame": (("x", 0, 120), ("y", 0, 80))})
    return actors.unionByName(_event_bounds(spark, sf_dir))


def _event_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.out_of_bounds(view(spark, sf_dir, "shots"), {"time": (("minute", 0, 90), ("second", 0, 59)), "location": (("x", 0, 120), ("y", 0, 80)), "end_location": (("end_x", 0, 120), ("end_y", 0, 80))})


@query(sql_over("relations", "stream", body="""
SELECT count(*) FILTER (WHERE s.event_id IS NULL) AS no_source, count(*) FILTER (WHERE t.event_id IS NULL) AS no_target, count(*) FILTER (WHERE s.event_id IS NULL OR t.event_id IS NULL) AS orphans
FROM relations LEFT JOIN stream s ON s.event_id = source_event_id LEFT JOIN stream t ON t.event_id = related_event_id"""))
def orphan_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.orphan_edges(view(spark, sf_dir, "relations"), view(spark, sf_dir, "stream"), "event_id", "source_event_id", "related_event_id")


@query("SELECT event_type AS type_name, count(*) FILTER (WHERE json_exists(props, '$.k')) AS with_key, count(*) FILTER (WHERE json_exists(props, '$.forbidden')) AS with_forbidden FROM events GROUP BY 1")
def forbidden_json_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.col("props")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("type_name")).agg(F.count_if(has_key(props, "k")).alias("with_key"), F.count_if(has_key(props, "forbidden")).alias("with_forbidden"))


@query(sql_over("stream", body="""
, d AS (SELECT event_id FROM stream WHERE (type_name = 'purchase' AND event_id % 10 <> 0) OR event_id % 97 = 0)
SELECT count(*) FILTER (WHERE type_name = 'purchase' AND d.event_id IS NULL) AS no_detail, count(*) FILTER (WHERE type_name <> 'purchase' AND d.event_id IS NOT NULL) AS stray_detail FROM stream s LEFT JOIN d USING (event_id)"""))
def type_detail_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "stream").select("event_id", "type_name")
    detail = s.filter("(type_name = 'purchase' AND event_id % 10 <> 0) OR event_id % 97 = 0").select("event_id", F.lit(True).alias("there"))
    typed, there = F.col("type_name") == "purchase", F.col("there").isNotNull()
    return s.join(detail, "event_id", "left").agg(F.count_if(typed & ~there).alias("no_detail"), F.count_if(~typed & there).alias("stray_detail"))


# Ids and names of six categories, with planted halves.
PAIRS = {
    "outcome": ("nullif(l_returnflag, 'A')", "l_returnflag"), "body_part": ("l_linestatus", "CASE WHEN l_linenumber = 1 THEN NULL ELSE l_linestatus END"), "technique": ("nullif(l_suppkey % 7, 0)", "nullif(l_suppkey % 14, 7)"),
    "shot_type": ("nullif(l_partkey % 20, 0)", "nullif(l_partkey % 20, 0)"), "play_pattern": ("nullif((l_orderkey + l_linenumber) % 6, 4)", "l_returnflag"), "position": ("l_partkey", "nullif(l_partkey % 3, 1)"),
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS name, count(*) FILTER (WHERE ({a}) IS NULL <> (({b}) IS NULL)) AS n FROM lineitem" for k, (a, b) in PAIRS.items()))
def id_name_pair_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.named_counts(table(spark, sf_dir, "lineitem"), {k: F.expr(a).isNull() != F.expr(b).isNull() for k, (a, b) in PAIRS.items()})


MAPPINGS = {"outcome": ("p_size", "p_brand"), "body_part": ("p_type", "p_brand"), "technique": ("p_partkey % 10", "p_type"), "shot_type": ("p_brand", "p_brand"), "play_pattern": ("nullif(p_size % 5, 0)", "p_size % 10"), "position": ("p_partkey", "nullif(p_size % 3, 0)")}


@query("WITH p AS (" + " UNION ".join(f"SELECT DISTINCT '{k}' AS field, ({i})::VARCHAR AS id, ({n})::VARCHAR AS name FROM part" for k, (i, n) in MAPPINGS.items()) + """),
f AS (SELECT field, 'id with names' AS kind FROM p WHERE id IS NOT NULL AND name IS NOT NULL GROUP BY field, id HAVING count(*) > 1 UNION ALL SELECT field, 'name with ids' FROM p WHERE id IS NOT NULL AND name IS NOT NULL GROUP BY field, name HAVING count(*) > 1)
SELECT field, kind, count(*) AS n FROM f GROUP BY 1, 2""")
def category_mapping_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.mapping_conflicts(table(spark, sf_dir, "part"), {k: (F.expr(i), F.expr(n)) for k, (i, n) in MAPPINGS.items()})


# Ten measures by the grain that is their denominator; shots are the events of that type.
SHOT_COVERAGE = {"shots_without_location": "x IS NULL", "shots_without_player": "player_id IS NULL", "shots_missing_any_field": "player_id IS NULL OR period IS NULL OR x IS NULL OR outcome_name IS NULL OR body_part_name IS NULL OR technique_name IS NULL OR shot_type_name IS NULL"}
COVERAGE = {"at_raw_boundary": "x = 120.1", "no_player": "player_id IS NULL", "no_location": "x IS NULL OR y IS NULL", "no_play_pattern": "play_pattern_name IS NULL", "no_duration": "duration IS NULL"}
MEMBER = "EXISTS (SELECT 1 FROM {t} m WHERE m.match_id = s.match_id AND m.team_id = s.team_id AND m.player_id = s.player_id)"
BP = "coalesce(n * 10000 // nullif(total, 0), 0) AS bp"


def coverage_sql(measures: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS name, count(*) FILTER (WHERE {v}) AS n, count(*) AS total FROM {source}" for k, v in measures.items())


@query(sql_over("shots", "memberships", "positions", body=f""", c AS ({coverage_sql(COVERAGE, "shots")} UNION ALL {coverage_sql(SHOT_COVERAGE, "shots WHERE event_index % 2 = 0")}
 UNION ALL SELECT 'memberships_without_position', count(*) FILTER (WHERE NOT {MEMBER.format(t="positions")}), count(*) FROM memberships s UNION ALL SELECT 'actors_without_membership', count(*) FILTER (WHERE NOT {MEMBER.format(t="memberships")}), count(*) FROM shots s WHERE player_id IS NOT NULL)
SELECT name, n, total, {BP} FROM c"""))
def coverage_bp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten measures as counts and basis points of their own grain."""
    key = ["match_id", "team_id", "player_id"]
    events, members = view(spark, sf_dir, "shots"), view(spark, sf_dir, "memberships")

    def without(rows: DataFrame, others: DataFrame, name: str) -> DataFrame:
        marked = rows.select(*key).join(others.select(*key, F.lit(True).alias("there")).distinct(), key, "left")
        return Q.coverage(marked, {name: F.col("there").isNull()})

    expressions = lambda measures: {k: F.expr(v) for k, v in measures.items()}
    return Q.union_all([
        Q.coverage(events, expressions(COVERAGE)), Q.coverage(events.filter("event_index % 2 = 0"), expressions(SHOT_COVERAGE)),
        without(members, view(spark, sf_dir, "positions"), "memberships_without_position"), without(events.dropna(subset=["player_id"]), members, "actors_without_membership"),
    ])


@query(sql_over("shots", "memberships", body="SELECT 'actor_membership_gap' AS name, count(*) AS n FROM shots s WHERE player_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM memberships m WHERE m.match_id = s.match_id AND m.team_id = s.team_id AND m.player_id = s.player_id)"))
def actor_membership_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.gap(view(spark, sf_dir, "shots"), view(spark, sf_dir, "memberships"), ["match_id", "team_id", "player_id"], "actor_membership_gap")


@query(sql_over("positions", "memberships", body="SELECT 'membership_without_position' AS name, count(*) AS n FROM memberships s WHERE NOT EXISTS (SELECT 1 FROM positions m WHERE m.match_id = s.match_id AND m.team_id = s.team_id AND m.player_id = s.player_id)"))
def membership_without_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.gap(view(spark, sf_dir, "memberships"), view(spark, sf_dir, "positions"), ["match_id", "team_id", "player_id"], "membership_without_position")


@query(sql_over("shots", "matches", "memberships", body="""
, a AS (SELECT 'shots' AS name, count(*) AS source FROM lineitem UNION ALL SELECT 'matches', count(*) FROM orders UNION ALL SELECT 'players', count(*) FROM supplier),
b AS (SELECT 'shots' AS name, count(*) AS stored FROM shots UNION ALL SELECT 'matches', count(*) FROM matches UNION ALL SELECT 'players', count(DISTINCT player_id) FROM memberships WHERE match_id % 50 = 0)
SELECT name, source, stored, CASE WHEN source = stored THEN 'OK' ELSE 'MISMATCH' END AS status FROM a FULL OUTER JOIN b USING (name)"""))
def source_target_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = Q.row_counts({"shots": table(spark, sf_dir, "lineitem"), "matches": table(spark, sf_dir, "orders"), "players": table(spark, sf_dir, "supplier")})
    stored = Q.row_counts({"shots": view(spark, sf_dir, "shots"), "matches": view(spark, sf_dir, "matches"), "players": view(spark, sf_dir, "memberships").filter("match_id % 50 = 0").select("player_id").distinct()})
    return Q.reconcile(source, stored)


@query(sql_over("shots", "memberships", "positions", body=" UNION ALL ".join(f"SELECT 'error' AS section, '{k}' AS name, count(*) FILTER (WHERE NOT ({r})) AS n, NULL::BIGINT AS total, CASE WHEN count(*) FILTER (WHERE NOT ({r})) > 0 THEN 'FAIL' ELSE 'OK' END AS status FROM shots" for k, r in SHOT_RULES.items())
    + " UNION ALL SELECT 'warning', 'membership_without_position', count(*), NULL, CASE WHEN count(*) > 0 THEN 'WARN' ELSE 'OK' END FROM memberships s WHERE NOT EXISTS (SELECT 1 FROM positions m WHERE m.match_id = s.match_id AND m.team_id = s.team_id AND m.player_id = s.player_id)"
    + "".join(f" UNION ALL SELECT 'coverage', '{k}', count(*) FILTER (WHERE {v}), count(*), 'INFO' FROM shots" for k, v in COVERAGE.items())))
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = Q.expect_rules(view(spark, sf_dir, "shots"), {k: F.expr(r) for k, r in SHOT_RULES.items()}).withColumnRenamed("violations", "n")
    return Q.report(errors, membership_without_position(spark, sf_dir), Q.coverage(view(spark, sf_dir, "shots"), {k: F.expr(v) for k, v in COVERAGE.items()}))


COUNTED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query(sql_over("matches", "shots", "memberships", "positions", body=grain_sql()))
def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.row_counts(grains(spark, sf_dir))


@query(sql_over("relations", "stream", "shots", "matches", "scored", body="""
SELECT (SELECT count(*) FROM events WHERE json_exists(props, '$.forbidden')) AS forbidden, (SELECT count(*) FROM relations WHERE source_event_id NOT IN (SELECT event_id FROM stream)) AS no_source, (SELECT count(*) FROM relations WHERE related_event_id NOT IN (SELECT event_id FROM stream)) AS no_target,
 (SELECT count(*) FROM shots WHERE match_id NOT IN (SELECT match_id FROM matches)) AS shots_without_match, (SELECT count(*) FROM scored WHERE row_id % 97 <> 0 AND row_id + CASE WHEN row_id % 89 = 0 THEN 1000000000 ELSE 0 END NOT IN (SELECT event_id FROM stream)) AS scores_without_event, 0::BIGINT AS leaking_columns"""))
def leakage_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks and orphans in one row; some scores are moved to events that don't exist."""
    one = F.lit(1).alias("k")
    forbidden = table(spark, sf_dir, "events").agg(F.count_if(has_key(F.col("props"), "forbidden")).alias("forbidden")).select("*", one)
    orphans = orphan_relations(spark, sf_dir).select("no_source", "no_target", one)
    shots = view(spark, sf_dir, "shots").join(view(spark, sf_dir, "matches"), "match_id", "left_anti").agg(F.count("*").alias("shots_without_match")).select("*", one)
    moved = view(spark, sf_dir, "scored").filter("row_id % 97 <> 0").select((F.col("row_id") + F.when(F.col("row_id") % 89 == 0, 1_000_000_000).otherwise(0)).alias("event_id"))
    scores = moved.join(view(spark, sf_dir, "stream"), "event_id", "left_anti").agg(F.count("*").alias("scores_without_event")).select("*", one)
    columns = Q.columns_like(spark, {t: table(spark, sf_dir, t) for t in COUNTED}, r"(?i)expected_goal|_xg$").agg(F.count("*").alias("leaking_columns")).select("*", one)
    return forbidden.join(orphans, "k").join(shots, "k").join(scores, "k").join(columns, "k").drop("k")
