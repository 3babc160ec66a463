"""The shot cohort and its audits: what is eligible, why the rest is not, what the columns hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scores as S
from ..operators import counting as C
from ..operators.ranges import exact_quantiles
from ..registry import query
from ..sources.tables import sql_over, view
from .analysis import ELIGIBLE, SEASON

SCOPES = [(0, 1994), (1, 1995), (2, 1996), (3, 1997)]
SCOPE_SQL = f"(VALUES {', '.join(map(str, SCOPES))}) AS sc(competition_id, season_id)"
FIELDS = ("shot_type_name", "body_part_name", "technique_name", "play_pattern_name")
FLAGS = ("under_pressure", "first_time", "open_goal")


def scoped_matches(spark: SparkSession, sf_dir: str, scopes: list[tuple[int, int]] = SCOPES) -> DataFrame:
    """Matches of the chosen competition seasons; the scope list is short and broadcast."""
    wanted = F.broadcast(spark.createDataFrame(scopes, "competition_id long, season_id long"))
    return view(spark, sf_dir, "matches").join(wanted, SEASON, "left_semi")


def eligible_shots(shots: DataFrame) -> DataFrame:
    return shots.filter(ELIGIBLE)


def scoped_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "shots").join(scoped_matches(spark, sf_dir).select("match_id", *SEASON, "match_date", "home_team_id", "away_team_id"), "match_id")


COHORT = f", c AS (SELECT shots.*, competition_id, season_id, match_date, home_team_id, away_team_id FROM shots JOIN matches USING (match_id) JOIN {SCOPE_SQL} USING (competition_id, season_id)), e AS (SELECT * FROM c WHERE {ELIGIBLE})"


def over_cohort(body: str) -> str:
    return sql_over("matches", "shots", body=COHORT + body)


COHORT_COLUMNS = ["event_id", "match_id", *SEASON, "team_id", "player_id", "period", "minute", "second", *FIELDS, *FLAGS, "x", "y"]


@query(over_cohort(f"SELECT {', '.join(COHORT_COLUMNS)}, match_date::VARCHAR AS match_date, CASE WHEN team_id = home_team_id THEN away_team_id ELSE home_team_id END AS opponent_id, CASE WHEN outcome_name = 'Goal' THEN 1 ELSE 0 END AS is_goal FROM e"))
def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    opponent = F.when(F.col("team_id") == F.col("home_team_id"), F.col("away_team_id")).otherwise(F.col("home_team_id"))
    return eligible_shots(scoped_shots(spark, sf_dir)).select(*COHORT_COLUMNS, F.col("match_date").cast("string").alias("match_date"), opponent.alias("opponent_id"), (F.col("outcome_name") == "Goal").cast("int").alias("is_goal"))


RECONCILE = {
    "all_shots": "true", "no_outcome": "outcome_name IS NULL", "no_body_part": "body_part_name IS NULL", "no_technique": "technique_name IS NULL", "no_type": "shot_type_name IS NULL", "no_period": "period IS NULL", "no_x": "x IS NULL", "no_y": "y IS NULL", "no_player": "player_id IS NULL",
    "half_location": "(x IS NULL) <> (y IS NULL)", "penalties": "shot_type_name = 'Penalty'", "shootout": "period = 5", "shootout_open_play": "period = 5 AND shot_type_name <> 'Penalty'", "eligible": ELIGIBLE, "eligible_goals": f"{ELIGIBLE} AND outcome_name = 'Goal'",
}


@query(over_cohort(" UNION ALL ".join(f"SELECT '{k}' AS name, count(*) FILTER (WHERE {v}) AS n FROM c" for k, v in RECONCILE.items())))
def cohort_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.named_counts(scoped_shots(spark, sf_dir), {k: F.expr(v) for k, v in RECONCILE.items()})


@query(over_cohort(" UNION ALL ".join(f"SELECT '{f}' AS field, coalesce({f}, '[missing]') AS level, count(*) AS n FROM e GROUP BY 2" for f in FIELDS)))
def category_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.level_counts(eligible_shots(scoped_shots(spark, sf_dir)), {f: F.coalesce(f, F.lit("[missing]")) for f in FIELDS})


@query(sql_over("matches", "shots", body=f"""
SELECT sc.competition_id::BIGINT AS competition_id, sc.season_id::BIGINT AS season_id, count(DISTINCT m.match_id) AS matches, count(s.event_id) AS shots, count(*) FILTER (WHERE shot_type_name = 'Penalty' AND period <> 5) AS regulation_penalties, count(*) FILTER (WHERE shot_type_name = 'Penalty' AND period = 5) AS shootout_penalties
FROM {SCOPE_SQL} LEFT JOIN matches m USING (competition_id, season_id) LEFT JOIN shots s USING (match_id) GROUP BY 1, 2"""))
def penalty_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    penalty = F.coalesce(F.col("shot_type_name") == "Penalty", F.lit(False))
    per_match = view(spark, sf_dir, "shots").groupBy("match_id").agg(F.count("*").alias("s"), F.count_if(penalty & (F.col("period") != 5)).alias("r"), F.count_if(penalty & (F.col("period") == 5)).alias("o"))
    scopes = spark.createDataFrame(SCOPES, "competition_id long, season_id long")
    joined = scopes.join(scoped_matches(spark, sf_dir), SEASON, "left").join(per_match, "match_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return joined.groupBy(*SEASON).agg(F.count("match_id").alias("matches"), total("s").alias("shots"), total("r").alias("regulation_penalties"), total("o").alias("shootout_penalties"))


@query(over_cohort("SELECT event_id, match_id, competition_id, season_id, x, y FROM e"))
def geometry_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligible_shots(scoped_shots(spark, sf_dir)).select("event_id", "match_id", *SEASON, "x", "y")


BOUNDARY = {
    "n": "count(*)", "x_min": "min(x)", "x_max": "max(x)", "y_min": "min(y)", "y_max": "max(y)", "no_x": "count(*) FILTER (WHERE x IS NULL)", "no_y": "count(*) FILTER (WHERE y IS NULL)",
    "past_line": "count(*) FILTER (WHERE x > 120)", "on_line": "count(*) FILTER (WHERE x = 120)", "at_zero": "count(*) FILTER (WHERE x = 0)", "on_side": "count(*) FILTER (WHERE y = 0 OR y = 80)", "past_side": "count(*) FILTER (WHERE y > 80)",
    "in_circle": "count(*) FILTER (WHERE (120 - x) * (120 - x) + (y - 40) * (y - 40) < 16)", "on_circle": "count(*) FILTER (WHERE (120 - x) * (120 - x) + (y - 40) * (y - 40) = 16)",
}


@query(over_cohort("SELECT " + ", ".join(f"{v} AS {k}" for k, v in BOUNDARY.items()) + " FROM c"))
def boundary_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoped_shots(spark, sf_dir).agg(*[F.expr(v).alias(k) for k, v in BOUNDARY.items()])


IN_SCOPE = {f"in_{c}_{s}": f"competition_id = {c} AND season_id = {s}" for c, s in SCOPES}


@query(over_cohort(" UNION ALL ".join(f"SELECT '{f}' AS field, coalesce({f}, '[missing]') AS level, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE {v}) AS {k}" for k, v in IN_SCOPE.items()) + " FROM e GROUP BY 2" for f in FIELDS)))
def categorical_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.level_counts(eligible_shots(scoped_shots(spark, sf_dir)), {f: F.coalesce(f, F.lit("[missing]")) for f in FIELDS}, **{k: F.expr(v) for k, v in IN_SCOPE.items()})


@query(over_cohort(" UNION ALL ".join(f"SELECT '{f}' AS flag, count(*) FILTER (WHERE {f}) AS n_true, count(*) FILTER (WHERE NOT {f}) AS n_false, count(*) FILTER (WHERE {f} IS NULL) AS n_absent, " + ", ".join(f"count(*) FILTER (WHERE {f} AND {v}) AS {k}" for k, v in IN_SCOPE.items()) + " FROM e" for f in FLAGS)))
def annotation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = eligible_shots(scoped_shots(spark, sf_dir)).unpivot(SEASON, list(FLAGS), "flag", "value")
    v = F.col("value")
    return flat.groupBy("flag").agg(F.count_if(v).alias("n_true"), F.count_if(~v).alias("n_false"), F.count_if(v.isNull()).alias("n_absent"), *[F.count_if(v & F.expr(s)).alias(k) for k, s in IN_SCOPE.items()])


@query(over_cohort(f", n AS (SELECT match_id, count(*) AS k FROM e GROUP BY 1) SELECT match_id, competition_id, season_id, match_date::VARCHAR AS match_date, coalesce(k, 0) AS eligible_shots FROM matches JOIN {SCOPE_SQL} USING (competition_id, season_id) LEFT JOIN n USING (match_id)"))
def split_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = C.counts_by(eligible_shots(view(spark, sf_dir, "shots")), ["match_id"], "k")
    return scoped_matches(spark, sf_dir).join(counts, "match_id", "left").select("match_id", *SEASON, F.col("match_date").cast("string").alias("match_date"), F.coalesce("k", F.lit(0)).alias("eligible_shots"))


@query(over_cohort("SELECT event_id, match_id FROM e"))
def split_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligible_shots(scoped_shots(spark, sf_dir)).select("event_id", "match_id")


# Column functions

ERROR = "CASE WHEN x IS NULL OR y IS NULL THEN 'missing' WHEN x < 0 OR x > 120.1 + 1e-12 THEN 'x out of range' WHEN y < 0 OR y > 80 THEN 'y out of range' WHEN CASE WHEN x > 120 AND x <= 120.1 + 1e-12 THEN 120.0::DOUBLE ELSE x END = 120 AND y IN (36, 44) THEN 'on a post' END"
GEOMETRY = f", g AS (SELECT event_id, x, y, CASE WHEN x > 120 AND x <= 120.1::DOUBLE + 1e-12::DOUBLE THEN 120.0::DOUBLE ELSE x END AS x_eff, {ERROR.replace('120.1 + 1e-12', '120.1::DOUBLE + 1e-12::DOUBLE')} AS error FROM shots), f AS (SELECT *, sqrt((120 - x_eff) * (120 - x_eff) + (y - 40) * (y - 40)) AS distance, atan2((120 - x_eff) * 8, (120 - x_eff) * (120 - x_eff) + (36 - y) * (44 - y)) AS angle FROM g WHERE error IS NULL)"


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return view(spark, sf_dir, "shots").withColumn("x_eff", G.effective_x(x)).withColumn("error", G.location_error(x, y))


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x_eff"), F.col("y")
    return located(spark, sf_dir).filter("error IS NULL").withColumn("distance", G.distance_to_goal(x, y)).withColumn("angle", G.visible_goal_angle(x, y))


@query(sql_over("shots", body=GEOMETRY + "SELECT coalesce(error, 'ok') AS status, count(*) AS n, round(sum(x_eff), 3) AS sum_x FROM g GROUP BY 1"))
def effective_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return located(spark, sf_dir).groupBy(F.coalesce("error", F.lit("ok")).alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("x_eff"), 3).alias("sum_x"))


@query(sql_over("shots", body=GEOMETRY + "SELECT event_id, round(distance, 9) AS distance FROM f"))
def distance_to_goal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir).select("event_id", F.round("distance", 9).alias("distance"))


@query(sql_over("shots", body=GEOMETRY + "SELECT event_id, round(angle, 9) AS angle FROM f"))
def visible_goal_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir).select("event_id", F.round("angle", 9).alias("angle"))


@query(sql_over("shots", body=GEOMETRY + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(min({c}), 6) AS least, round(quantile_cont({c}, 0.05), 6) AS p05, round(quantile_cont({c}, 0.5), 6) AS median, round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.95), 6) AS p95, round(max({c}), 6) AS most FROM f" for c in ("distance", "angle"))))
def geometry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles are exact, by ranges of distinct values."""
    columns = ["distance", "angle"]
    rows = measured(spark, sf_dir).select(*columns)
    stats = rows.unpivot([], columns, "feature", "v").groupBy("feature").agg(F.min("v").alias("least"), F.avg("v").alias("mean"), F.max("v").alias("most"))
    shares = {"p05": 0.05, "median": 0.5, "p95": 0.95}
    found = exact_quantiles(rows, columns, list(shares.values())).groupBy(F.col("name").alias("feature"))
    quantiles = found.agg(*[F.max(F.when(F.col("share") == q, F.col("value"))).alias(k) for k, q in shares.items()])
    return stats.join(quantiles, "feature").select("feature", *[F.round(c, 6).alias(c) for c in ("least", "p05", "median", "mean", "p95", "most")])


@query(sql_over("shots", body="SELECT team_id, sum(CASE WHEN outcome_name = 'Goal' THEN 1 ELSE 0 END)::BIGINT AS goals, round(100.0::DOUBLE * sum(CASE WHEN outcome_name = 'Goal' THEN 1 ELSE 0 END) / nullif(count(outcome_name), 0), 2) AS conversion_pct FROM shots GROUP BY 1"))
def conversion_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    goals = F.count_if(F.col("outcome_name") == "Goal")
    return view(spark, sf_dir, "shots").groupBy("team_id").agg(goals.alias("goals"), C.percent(goals, F.count("outcome_name")).alias("conversion_pct"))


@query(sql_over("shots", body="SELECT event_id, CASE WHEN under_pressure THEN 1 ELSE 0 END AS under_pressure, CASE WHEN open_goal THEN 1 ELSE 0 END AS open_goal FROM shots"))
def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "shots").select("event_id", *[S.presence(F.col(c)).alias(c) for c in ("under_pressure", "open_goal")])


@query(sql_over("scored", body="SELECT row_id, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-(1.25::DOUBLE * ln(greatest(least(p, 1 - 1e-12), 1e-12) / (1 - greatest(least(p, 1 - 1e-12), 1e-12))) + 0.5::DOUBLE))), 9) AS calibrated FROM scored"))
def platt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "scored").select("row_id", F.round(S.platt(S.logit(F.col("p")), 1.25, 0.5), 9).alias("calibrated"))


@query(sql_over("shots", body=GEOMETRY + """
SELECT CASE WHEN distance >= 30 THEN '>=30' WHEN distance >= 20 THEN '[20,30)' WHEN distance >= 10 THEN '[10,20)' ELSE '<10' END AS distance_band,
 CASE WHEN angle >= 0.6 THEN '>=0.6' WHEN angle >= 0.4 THEN '[0.4,0.6)' WHEN angle >= 0.2 THEN '[0.2,0.4)' ELSE '<0.2' END AS angle_band, count(*) AS n FROM f GROUP BY 1, 2"""))
def numeric_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir).groupBy(S.band_label(F.col("distance"), S.DISTANCE_EDGES).alias("distance_band"), S.band_label(F.col("angle"), S.ANGLE_EDGES).alias("angle_band")).agg(F.count("*").alias("n"))


@query(sql_over("scored", body="SELECT least((floor(p / 0.2))::INT, 4) AS equal_width, CASE WHEN p >= 0.8 THEN 4 WHEN p >= 0.6 THEN 3 WHEN p >= 0.4 THEN 2 WHEN p >= 0.2 THEN 1 ELSE 0 END AS raw_anchor, count(*) AS n FROM scored GROUP BY 1, 2"))
def score_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "scored").groupBy(S.edge_bin(F.col("p"), S.EQUAL_WIDTH_EDGES).alias("equal_width"), S.edge_bin(F.col("p"), S.RAW_ANCHOR_EDGES).alias("raw_anchor")).agg(F.count("*").alias("n"))
