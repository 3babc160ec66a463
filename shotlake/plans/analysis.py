"""Descriptive questions about matches, events and shots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import counting as C
from ..registry import query
from ..sources.tables import sql_over, table, view

SEASON = ["competition_id", "season_id"]
ELIGIBLE = "outcome_name IS NOT NULL AND body_part_name IS NOT NULL AND technique_name IS NOT NULL AND shot_type_name IS NOT NULL AND period IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND player_id IS NOT NULL AND shot_type_name <> 'Penalty' AND period <> 5"


@query(sql_over("matches", "shots", body="""
, s AS (SELECT match_id, count(*) AS shots FROM shots GROUP BY 1),
seasons AS (SELECT DISTINCT season_id FROM matches), every AS (SELECT CAST(r_regionkey AS BIGINT) AS competition_id, season_id FROM region, seasons),
t AS (SELECT competition_id, season_id, count(DISTINCT team_id) AS teams FROM (SELECT competition_id, season_id, home_team_id AS team_id FROM matches UNION SELECT competition_id, season_id, away_team_id FROM matches) GROUP BY 1, 2),
m AS (SELECT competition_id, season_id, count(*) AS matches, min(match_date)::VARCHAR AS first_date, max(match_date)::VARCHAR AS last_date, sum(coalesce(shots, 0))::BIGINT AS shots FROM matches LEFT JOIN s USING (match_id) GROUP BY 1, 2)
SELECT competition_id, season_id, coalesce(matches, 0) AS matches, coalesce(teams, 0) AS teams, first_date, last_date, coalesce(shots, 0)::BIGINT AS shots FROM every LEFT JOIN m USING (competition_id, season_id) LEFT JOIN t USING (competition_id, season_id)"""))
def q01_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = view(spark, sf_dir, "matches")
    shots = C.counts_by(view(spark, sf_dir, "shots"), ["match_id"], "shots")
    seasons = matches.select("season_id").distinct()
    years = seasons.agg(F.collect_set("season_id").alias("years")).withColumn("k", F.lit(1))  # a few dozen
    every = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("competition_id"), F.lit(1).alias("k")).join(years, "k").select("competition_id", F.explode("years").alias("season_id"))
    teams = matches.select(*SEASON, F.explode(F.array("home_team_id", "away_team_id")).alias("team_id")).groupBy(*SEASON).agg(F.countDistinct("team_id").alias("teams"))
    by_season = matches.join(shots, "match_id", "left").groupBy(*SEASON).agg(F.count("*").alias("matches"), F.min("match_date").cast("string").alias("first_date"), F.max("match_date").cast("string").alias("last_date"), F.sum(F.coalesce("shots", F.lit(0))).alias("shots"))
    return every.join(by_season, SEASON, "left").join(teams, SEASON, "left").select(*SEASON, F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce("teams", F.lit(0)).alias("teams"), "first_date", "last_date", F.coalesce("shots", F.lit(0)).alias("shots"))


@query(sql_over("matches", "shots", body="""
, s AS (SELECT match_id, count(*) AS events, count(DISTINCT team_id) AS attacking_teams, count(DISTINCT minute % 4) AS possessions FROM shots GROUP BY 1), g AS (SELECT match_id, count(*) AS goals FROM shots WHERE outcome_name = 'Goal' GROUP BY 1)
SELECT m.match_id, h.c_name AS home_team, a.c_name AS away_team, coalesce(possessions, 0) AS possessions, coalesce(s.events, 0) AS events, coalesce(attacking_teams, 0) AS attacking_teams, coalesce(goals, 0) AS goals
FROM matches m JOIN customer h ON h.c_custkey = home_team_id JOIN customer a ON a.c_custkey = away_team_id LEFT JOIN s USING (match_id) LEFT JOIN g USING (match_id)"""))
def q02_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = view(spark, sf_dir, "shots").groupBy("match_id").agg(F.count("*").alias("events"), F.countDistinct("team_id").alias("attacking_teams"), F.countDistinct(F.col("minute") % 4).alias("possessions"), F.count_if(F.col("outcome_name") == "Goal").alias("goals"))
    teams = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    home, away = teams.toDF("home_team_id", "home_team"), teams.toDF("away_team_id", "away_team")
    joined = view(spark, sf_dir, "matches").join(home, "home_team_id").join(away, "away_team_id").join(shots, "match_id", "left")
    return joined.select("match_id", "home_team", "away_team", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("possessions", "events", "attacking_teams", "goals")])


@query(sql_over("matches", body="""
, p AS (SELECT home_team_id AS team_id, home_score AS scored, away_score AS conceded FROM matches UNION ALL SELECT away_team_id, away_score, home_score FROM matches)
SELECT team_id, count(*) AS played, count(*) FILTER (WHERE scored > conceded) AS won, count(*) FILTER (WHERE scored = conceded) AS drawn, count(*) FILTER (WHERE scored < conceded) AS lost,
 sum(scored)::BIGINT AS goals_for, sum(conceded)::BIGINT AS goals_against, sum(CASE WHEN scored > conceded THEN 3 WHEN scored = conceded THEN 1 WHEN scored < conceded THEN 0 END)::BIGINT AS points FROM p GROUP BY 1"""))
def q03_team_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = F.explode(F.array(F.struct(F.col("home_team_id").alias("team_id"), F.col("home_score").alias("scored"), F.col("away_score").alias("conceded")), F.struct(F.col("away_team_id").alias("team_id"), F.col("away_score").alias("scored"), F.col("home_score").alias("conceded"))))
    s, c = F.col("scored"), F.col("conceded")
    return view(spark, sf_dir, "matches").select(sides.alias("side")).select("side.*").groupBy("team_id").agg(
        F.count("*").alias("played"), F.count_if(s > c).alias("won"), F.count_if(s == c).alias("drawn"), F.count_if(s < c).alias("lost"), F.sum("scored").alias("goals_for"), F.sum("conceded").alias("goals_against"),
        F.sum(F.when(s > c, 3).when(s == c, 1).when(s < c, 0)).alias("points"),
    )


@query(sql_over("matches", "memberships", body="""
SELECT count(*) AS matches, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM memberships b WHERE b.match_id = m.match_id AND b.team_id = m.home_team_id)) AS no_home_lineup,
 count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM memberships b WHERE b.match_id = m.match_id AND b.team_id = m.away_team_id)) AS no_away_lineup,
 count(*) FILTER (WHERE (home_score IS NULL) <> (away_score IS NULL)) AS half_scores, count(*) FILTER (WHERE home_team_id = away_team_id) AS same_team FROM matches m"""))
def q04_role_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    teams = view(spark, sf_dir, "memberships").select("match_id", "team_id").distinct().withColumn("there", F.lit(True))
    home, away = teams.toDF("match_id", "home_team_id", "home_there"), teams.toDF("match_id", "away_team_id", "away_there")
    joined = view(spark, sf_dir, "matches").join(home, ["match_id", "home_team_id"], "left").join(away, ["match_id", "away_team_id"], "left")
    return joined.agg(
        F.count("*").alias("matches"), F.count_if(F.col("home_there").isNull()).alias("no_home_lineup"), F.count_if(F.col("away_there").isNull()).alias("no_away_lineup"),
        F.count_if(F.col("home_score").isNull() != F.col("away_score").isNull()).alias("half_scores"), F.count_if(F.col("home_team_id") == F.col("away_team_id")).alias("same_team"),
    )


@query(sql_over("matches", "shots", body=f"""
SELECT competition_id, season_id, count(*) AS shots, count(*) FILTER (WHERE outcome_name = 'Goal') AS goals, round(100.0::DOUBLE * count(*) FILTER (WHERE outcome_name = 'Goal') / count(*), 2) AS conversion_pct
FROM shots JOIN matches USING (match_id) WHERE {ELIGIBLE} GROUP BY 1, 2"""))
def q05_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = view(spark, sf_dir, "shots").filter(ELIGIBLE).join(view(spark, sf_dir, "matches"), "match_id")
    goals = F.count_if(F.col("outcome_name") == "Goal")
    return shots.groupBy(*SEASON).agg(F.count("*").alias("shots"), goals.alias("goals"), C.percent(goals, F.count("*")).alias("conversion_pct"))


@query(sql_over("shots", body="""
SELECT player_id, s_name AS player_name, count(*) AS shots, count(*) FILTER (WHERE outcome_name = 'Goal') AS goals FROM shots JOIN supplier ON s_suppkey = player_id GROUP BY 1, 2 ORDER BY shots DESC, goals DESC, player_id LIMIT 25"""))
def q06_player_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = view(spark, sf_dir, "shots").filter("player_id IS NOT NULL").groupBy("player_id").agg(F.count("*").alias("shots"), F.count_if(F.col("outcome_name") == "Goal").alias("goals"))
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("player_id"), F.col("s_name").alias("player_name"))
    return counts.join(names, "player_id").orderBy(F.desc("shots"), F.desc("goals"), "player_id").limit(25).select("player_id", "player_name", "shots", "goals")


@query(sql_over("stream", body="SELECT type_name, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS pct FROM stream GROUP BY 1"))
def q07_type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.share_of_total(view(spark, sf_dir, "stream"), ["type_name"])


@query(sql_over("stream", body="""
SELECT type_name, count(*) AS events, count(*) FILTER (WHERE player_id IS NULL) AS no_player, round(100.0::DOUBLE * count(*) FILTER (WHERE player_id IS NULL) / count(*), 2) AS no_player_pct,
 count(*) FILTER (WHERE duration IS NULL) AS no_duration, round(100.0::DOUBLE * count(*) FILTER (WHERE duration IS NULL) / count(*), 2) AS no_duration_pct,
 count(*) FILTER (WHERE x IS NULL) AS no_x, round(100.0::DOUBLE * count(*) FILTER (WHERE x IS NULL) / count(*), 2) AS no_x_pct FROM stream GROUP BY 1"""))
def q08_missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = {c: F.count_if(F.col(c).isNull()) for c in ("player_id", "duration", "x")}
    named = {"player_id": "no_player", "duration": "no_duration", "x": "no_x"}
    return view(spark, sf_dir, "stream").groupBy("type_name").agg(F.count("*").alias("events"), *[c.alias(named[k]) for k, c in missing.items()], *[C.percent(c, F.count("*")).alias(f"{named[k]}_pct") for k, c in missing.items()])


@query(sql_over("memberships", "positions", "shots", body="""
, p AS (SELECT DISTINCT match_id, team_id, player_id, true AS positioned FROM positions), e AS (SELECT DISTINCT match_id, team_id, player_id, true AS acted FROM shots WHERE player_id IS NOT NULL)
SELECT count(*) AS memberships, count(*) FILTER (WHERE positioned) AS with_position, count(*) FILTER (WHERE acted) AS with_event, count(*) FILTER (WHERE positioned IS NULL AND acted IS NULL) AS with_neither
FROM memberships LEFT JOIN p USING (match_id, team_id, player_id) LEFT JOIN e USING (match_id, team_id, player_id)"""))
def q09_participation(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["match_id", "team_id", "player_id"]
    placed = view(spark, sf_dir, "positions").select(*key).distinct().withColumn("positioned", F.lit(True))
    acted = view(spark, sf_dir, "shots").select(*key).dropna().distinct().withColumn("acted", F.lit(True))
    joined = view(spark, sf_dir, "memberships").join(placed, key, "left").join(acted, key, "left")
    return joined.agg(F.count("*").alias("memberships"), F.count("positioned").alias("with_position"), F.count("acted").alias("with_event"), F.count_if(F.col("positioned").isNull() & F.col("acted").isNull()).alias("with_neither"))


@query(sql_over("stream", body="""
, b AS (SELECT type_name, lag(type_name) OVER (PARTITION BY match_id, possession_id ORDER BY event_index) AS before FROM stream)
SELECT coalesce(before, '[first event in possession]') AS previous, count(*) AS n FROM b WHERE type_name = 'purchase' GROUP BY 1"""))
def q10_pre_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.previous_in_group(view(spark, sf_dir, "stream"), ["match_id", "possession_id"], "event_index", "type_name", F.col("type_name") == "purchase", "[first event in possession]")


@query(sql_over("shots", body="SELECT 'shot_type' AS field, shot_type_name AS level, count(*) AS n FROM shots GROUP BY 2 UNION ALL SELECT 'period', period::VARCHAR, count(*) FROM shots GROUP BY 2"))
def shot_type_period_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.level_counts(view(spark, sf_dir, "shots"), {"shot_type": F.col("shot_type_name"), "period": F.col("period")})


@query(sql_over("matches", "shots", body="""
SELECT s.event_id, s.match_id, m.match_date::VARCHAR AS match_date, t.c_name AS team_name, o.c_name AS opponent_name, p.s_name AS player_name, s.outcome_name, s.x, s.y FROM shots s JOIN matches m USING (match_id) JOIN customer t ON t.c_custkey = s.team_id
JOIN customer o ON o.c_custkey = CASE WHEN s.team_id = m.home_team_id THEN m.away_team_id ELSE m.home_team_id END LEFT JOIN supplier p ON p.s_suppkey = s.player_id"""))
def shot_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    teams = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    players = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("player_id"), F.col("s_name").alias("player_name"))
    shots = view(spark, sf_dir, "shots").join(view(spark, sf_dir, "matches"), "match_id").withColumn("opponent_id", F.when(F.col("team_id") == F.col("home_team_id"), F.col("away_team_id")).otherwise(F.col("home_team_id")))
    named = shots.join(teams.toDF("team_id", "team_name"), "team_id").join(teams.toDF("opponent_id", "opponent_name"), "opponent_id").join(players, "player_id", "left")
    return named.select("event_id", "match_id", F.col("match_date").cast("string").alias("match_date"), "team_name", "opponent_name", "player_name", "outcome_name", "x", "y")


@query(sql_over("matches", "shots", body=f"""
SELECT count(*) AS shots, count(*) FILTER (WHERE outcome_name = 'Goal') AS goals, round(count(*) FILTER (WHERE outcome_name = 'Goal')::DOUBLE / nullif(count(*), 0), 12) AS rate, CASE WHEN count(*) = 0 THEN 'empty' ELSE 'ok' END AS status
FROM shots JOIN matches USING (match_id) WHERE competition_id = 1 AND {ELIGIBLE}"""))
def base_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = view(spark, sf_dir, "shots").filter(ELIGIBLE).join(view(spark, sf_dir, "matches").filter("competition_id = 1"), "match_id", "left_semi")
    goals, n = F.count_if(F.col("outcome_name") == "Goal"), F.count("*")
    return shots.agg(n.alias("shots"), goals.alias("goals"), F.round(goals / F.nullif(n, F.lit(0)), 12).alias("rate"), F.when(n == 0, "empty").otherwise("ok").alias("status"))
