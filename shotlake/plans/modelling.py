"""Features, fits and scores of the shot cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import boosting as B
from ..operators import features as X
from ..operators import models as M
from ..operators import networks as N
from ..registry import query
from ..sources.shared import written
from ..sources.tables import sql_over, view
from .analysis import ELIGIBLE
from .cohort import eligible_shots

REFERENCE = {"body_part_name": "Right Foot", "technique_name": "Normal", "play_pattern_name": "Regular Play", "shot_type_name": "Open Play"}
LEAST = 400
FEATURES = f""", e AS (SELECT event_id AS row_id, match_id, (match_id % 5)::INT AS fold, CASE WHEN outcome_name = 'Goal' THEN 1 ELSE 0 END AS y, body_part_name, technique_name, play_pattern_name, shot_type_name, under_pressure, first_time,
 CASE WHEN x > 120 THEN 120.0::DOUBLE ELSE x END AS x, y AS yy FROM shots WHERE {ELIGIBLE} AND y <= 80),
f AS (SELECT *, sqrt((120 - x) * (120 - x) + (yy - 40) * (yy - 40)) AS distance, atan2((120 - x) * 8, (120 - x) * (120 - x) + (36 - yy) * (44 - yy)) AS angle FROM e WHERE NOT (x = 120 AND yy IN (36, 44))),
l AS ({" UNION ALL ".join(f"SELECT '{k}' AS field, coalesce({k}, 'None') AS level, count(*) AS n FROM f GROUP BY 2" for k in REFERENCE)}),
v AS (SELECT *, CASE {" ".join(f"WHEN field = '{k}' AND level = '{r}' THEN 'reference'" for k, r in REFERENCE.items())} WHEN n >= {LEAST} THEN 'kept' ELSE 'rare' END AS role FROM l)"""


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible shots that can be placed, with label, fold, distance and angle."""
    shots = eligible_shots(view(spark, sf_dir, "shots")).filter(G.location_error(F.col("x"), F.col("y")).isNull()).withColumn("x", G.effective_x(F.col("x")))
    return shots.select(
        F.col("event_id").alias("row_id"), "match_id", (F.col("match_id") % 5).cast("int").alias("fold"), (F.col("outcome_name") == "Goal").cast("int").alias("y"), *REFERENCE, "under_pressure", "first_time",
        G.distance_to_goal(F.col("x"), F.col("y")).alias("distance"), G.visible_goal_angle(F.col("x"), F.col("y")).alias("angle"),
    )


@query(sql_over("shots", body=FEATURES + " SELECT field, level, n FROM l"))
def level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.fit_vocabulary(feature_rows(spark, sf_dir), REFERENCE, LEAST).select("field", "level", "n")


@query(sql_over("shots", body=FEATURES + " SELECT field, level, n, role, CASE WHEN role = 'kept' THEN row_number() OVER (PARTITION BY field, role ORDER BY level) WHEN role = 'rare' THEN count(*) FILTER (WHERE role = 'kept') OVER (PARTITION BY field) + 1 END AS position FROM v"))
def fit_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.fit_vocabulary(feature_rows(spark, sf_dir), REFERENCE, LEAST)


@query(sql_over("shots", body=FEATURES + """, r AS (SELECT row_id, field, level FROM (SELECT row_id, coalesce(body_part_name, 'None') AS body_part_name, coalesce(technique_name, 'None') AS technique_name, coalesce(play_pattern_name, 'None') AS play_pattern_name, coalesce(shot_type_name, 'None') AS shot_type_name FROM f) UNPIVOT (level FOR field IN (body_part_name, technique_name, play_pattern_name, shot_type_name)))
SELECT field || '=' || CASE WHEN role = 'rare' THEN 'rare' ELSE level END AS column_name, count(*) AS ones FROM r JOIN v USING (field, level) WHERE role <> 'reference' GROUP BY 1"""))
def encode_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feature_rows(spark, sf_dir)
    vocabulary = X.fit_vocabulary(rows, REFERENCE, LEAST).collect()  # bounded by the levels
    encoded = X.encode(rows, vocabulary, list(REFERENCE))
    columns = [c for c in encoded.columns if "=" in c]
    one = encoded.agg(*[F.sum(F.col(f"`{c}`")).alias(c) for c in columns])
    return one.unpivot([], [F.col(f"`{c}`") for c in columns], "column_name", "ones")


@query(sql_over("shots", body=FEATURES + ", k AS (SELECT unnest([0, 1, 2, 3, 4]) AS fold) " + " UNION ALL ".join(f"SELECT k.fold, '{c}' AS \"column\", round(avg({c}), 8) AS mean, round(stddev_pop({c}), 8) AS sd FROM k JOIN f ON f.fold <> k.fold GROUP BY 1" for c in ("distance", "angle"))))
def fit_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.fold_scalers(feature_rows(spark, sf_dir), ["distance", "angle"])
    return s.select("fold", "column", F.round("mean", 8).alias("mean"), F.round("sd", 8).alias("sd"))


def encoded_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """(rows with all feature columns scaled over the whole cohort, their names in order). Vocabulary, moments and fits
    read the same rows, which are written once, so that no pass joins them again."""
    rows = written(feature_rows(spark, sf_dir), "eligible")
    vocabulary = X.fit_vocabulary(rows, REFERENCE, LEAST).collect()
    moments = rows.agg(*[f(c).alias(f"{k}_{c}") for c in ("distance", "angle") for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scaled = rows.withColumns({f"z_{c}": (F.col(c) - moments[f"m_{c}"]) / moments[f"s_{c}"] for c in ("distance", "angle")}).withColumns({c: F.coalesce(c, F.lit(False)).cast("int") for c in ("under_pressure", "first_time")})
    encoded = X.encode(scaled, vocabulary, list(REFERENCE))
    levels = [c for c in encoded.columns if "=" in c]
    safe = {c: c.replace(" ", "_").replace("=", "__").replace(".", "_") for c in levels}
    return encoded.withColumnsRenamed(safe), ["z_distance", "z_angle", "under_pressure", "first_time", *safe.values()]


@query(sql_over("shots", body=FEATURES + ", m AS (SELECT avg(distance) AS d, stddev_pop(distance) AS ds, avg(angle) AS a, stddev_pop(angle) AS \"as\" FROM f) SELECT row_id, y, round((distance - d) / ds, 6) AS z_distance, round((angle - a) / \"as\", 6) AS z_angle, CASE WHEN under_pressure THEN 1 ELSE 0 END AS under_pressure, CASE WHEN first_time THEN 1 ELSE 0 END AS first_time FROM f, m"))
def encode_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = encoded_rows(spark, sf_dir)
    return rows.select("row_id", "y", F.round("z_distance", 6).alias("z_distance"), F.round("z_angle", 6).alias("z_angle"), "under_pressure", "first_time")


@query(sql_over("shots", body=FEATURES + " SELECT NULL::INT AS fold, count(*) FILTER (WHERE under_pressure) AS n, round(avg(CASE WHEN under_pressure THEN 1.0 ELSE 0.0 END), 9) AS rate FROM f UNION ALL SELECT fold, count(*) FILTER (WHERE under_pressure), round(avg(CASE WHEN under_pressure THEN 1.0 ELSE 0.0 END), 9) FROM f GROUP BY 1"))
def presence_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.coalesce("under_pressure", F.lit(False))
    rolled = feature_rows(spark, sf_dir).rollup("fold").agg(F.count_if(flag).alias("n"), F.round(F.avg(flag.cast("double")), 9).alias("rate"))
    return rolled.select("fold", "n", "rate")


@query(sql_over("shots", body=FEATURES + ", k AS (SELECT fold, sum(y) AS s, count(*) AS n FROM f GROUP BY 1), t AS (SELECT sum(s) AS s, sum(n) AS n FROM k) SELECT row_id, f.fold, round((t.s - k.s)::DOUBLE / (t.n - k.n), 9) AS p FROM f JOIN k USING (fold), t"))
def constant_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.constant_out_of_fold(feature_rows(spark, sf_dir)).select("row_id", "fold", F.round("p", 9).alias("p"))


def _training(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    rows, columns = encoded_rows(spark, sf_dir)
    return written(M.assembled(rows.select("row_id", "fold", "y", *columns), columns).select("row_id", "fold", "y", "features"), "training"), columns


@query()
def logistic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of one penalised fit with odds ratios: also the final refit."""
    rows, columns = _training(spark, sf_dir)
    model = M.logistic(0.1, rows.count()).fit(rows)
    return M.coefficient_table(spark, model, columns).select("name", F.round("coefficient", 6).alias("coefficient"), F.round("odds_ratio", 6).alias("odds_ratio"))


@query()
def final_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen model fitted on all development rows, without the presence columns."""
    rows, columns = encoded_rows(spark, sf_dir)
    plain = [c for c in columns if c not in ("under_pressure", "first_time")]
    train = M.assembled(rows.select("row_id", "fold", "y", *plain), plain)
    return M.coefficient_table(spark, M.logistic(0.1, train.count()).fit(train), plain).select("name", F.round("coefficient", 6).alias("coefficient"), F.round("odds_ratio", 6).alias("odds_ratio"))


def _scaled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Rows with their feature columns, held, since each Newton step reads them."""
    rows, columns = encoded_rows(spark, sf_dir)
    return written(rows.select("row_id", "fold", "y", *columns), "features"), columns


@query()
def oof_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row scored by the fit that left its fold out; all five fits take their steps in one job."""
    rows, columns = _scaled(spark, sf_dir)
    return M.out_of_fold_scores(rows, columns, M.fold_fits(rows, columns, [0.1])).select("row_id", "y", "fold", F.round("p", 6).alias("p"))


CS = [0.01, 0.1, 1.0, 10.0]


@query()
def grid_select_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The C of least mean fold log loss (then Brier, then C) over all five folds: twenty fits, one job a step."""
    rows, columns = _scaled(spark, sf_dir)
    return M.grid_best(M.out_of_fold_scores(rows, columns, M.fold_fits(rows, columns, CS)), ["c"])


@query(sql_over("scored", body=f"""
, g AS (SELECT fold, y, c, power(p, c) AS p FROM scored, (VALUES {", ".join(f"({c}::DOUBLE)" for c in CS)}) AS v(c)),
f AS (SELECT c, fold, avg(-ln(greatest(least(CASE WHEN y = 1 THEN p ELSE 1.0::DOUBLE - p END, 1.0::DOUBLE), 1e-15))) AS ll, avg((y - p) * (y - p)) AS b FROM g GROUP BY 1, 2), m AS (SELECT c, avg(ll) AS log_loss, avg(b) AS brier FROM f GROUP BY 1)
SELECT round(log_loss, 9) AS log_loss, round(brier, 9) AS brier, c FROM m ORDER BY m.log_loss, m.brier, c LIMIT 1"""))
def grid_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The choice of grid_select_c over a given table of scores: powers of the events' probabilities."""
    points = F.explode(F.array(*map(F.lit, CS))).alias("c")
    scores = view(spark, sf_dir, "scored").select("fold", "y", "p", points).withColumn("p", F.pow("p", "c"))
    return M.grid_best(scores, ["c"]).select(F.round("log_loss", 9).alias("log_loss"), F.round("brier", 9).alias("brier"), "c")


@query(sql_over("scored", body="""
, g AS (SELECT fold, y, step, leaves, least, least(greatest(p * (1 + step) - leaves / 300.0::DOUBLE, 0), 1) AS p FROM scored, (VALUES (0.03::DOUBLE), (0.06), (0.1)) AS s(step), (VALUES (7), (15)) AS d(leaves), (VALUES (20), (60)) AS l(least)),
f AS (SELECT step, leaves, least, fold, avg(-ln(greatest(least(CASE WHEN y = 1 THEN p ELSE 1.0::DOUBLE - p END, 1.0::DOUBLE), 1e-15))) AS ll, avg((y - p) * (y - p)) AS b FROM g GROUP BY 1, 2, 3, 4), m AS (SELECT step, leaves, least, avg(ll) AS log_loss, avg(b) AS brier FROM f GROUP BY 1, 2, 3)
SELECT round(log_loss, 9) AS log_loss, round(brier, 9) AS brier, step, leaves, least FROM m ORDER BY round(m.log_loss, 12), round(m.brier, 12), step, leaves, least LIMIT 1"""))
def boosting_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The choice of gbt_fit over a given table of scores. Points that differ in their least leaf alone tie, and the
    smaller one is taken."""
    points = F.explode(F.array(*[F.struct(F.lit(g.step).alias("step"), F.lit(g.leaves).alias("leaves"), F.lit(g.least).alias("least")) for g in B.GRID])).alias("at")
    p = F.least(F.greatest(F.col("p") * (1 + F.col("step")) - F.col("leaves") / F.lit(300.0), F.lit(0.0)), F.lit(1.0))
    scores = view(spark, sf_dir, "scored").select("fold", "y", "p", points).select("fold", "y", "p", "at.*").withColumn("p", p)
    return M.grid_best(scores, ["step", "leaves", "least"], places=12).select(F.round("log_loss", 9).alias("log_loss"), F.round("brier", 9).alias("brier"), "step", "leaves", "least")


@query()
def gbt_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees for all twelve points of the grid over all five folds, grown together: the point of least mean fold
    log loss (then Brier, then the parameters in order)."""
    rows, columns = _scaled(spark, sf_dir)
    return M.grid_best(B.boosted_scores(rows, columns), ["step", "leaves", "least"], 12, F.col("weight"))


@query()
def mlp_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores of the small network; all five fits take their steps in one job."""
    rows, columns = _scaled(spark, sf_dir)
    return N.network_scores(rows, columns, ["z_distance", "z_angle"]).select("row_id", "y", "fold", F.round("p", 6).alias("p"))


WEIGHTS, INTERCEPT, SLOPE, SHIFT = {"distance": -0.12, "angle": 1.4, "pressed": -0.25}, -0.8, 1.2, 0.1
SCORES = f"{INTERCEPT}::DOUBLE + distance * {WEIGHTS['distance']}::DOUBLE + angle * {WEIGHTS['angle']}::DOUBLE + (CASE WHEN under_pressure THEN 1 ELSE 0 END) * {WEIGHTS['pressed']}::DOUBLE"


@query(sql_over("shots", body=FEATURES + f" SELECT row_id, round({SCORES}, 8) AS z FROM f"))
def predict_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feature_rows(spark, sf_dir).withColumn("pressed", F.coalesce("under_pressure", F.lit(False)).cast("int"))
    return rows.select("row_id", F.round(M.linear_score(WEIGHTS, INTERCEPT), 8).alias("z"))


@query()
def fit_platt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope and intercept for logits of the frozen score on the calibration folds."""
    rows = feature_rows(spark, sf_dir).withColumn("pressed", F.coalesce("under_pressure", F.lit(False)).cast("int")).filter("fold = 3").select("y", M.linear_score(WEIGHTS, INTERCEPT).alias("z"))
    slope, intercept = M.fit_platt(rows)
    n = rows.agg(F.count("*").alias("n"))
    return n.select("n", F.round(F.lit(slope), 6).alias("slope"), F.round(F.lit(intercept), 6).alias("intercept"))


VALID = "x BETWEEN 0 AND 120 AND y BETWEEN 0 AND 80 AND shot_type_name <> 'Penalty'"


@query(sql_over("shots", body=f"""
, s AS (SELECT *, sqrt((120 - x) * (120 - x) + (y - 40) * (y - 40)) AS distance, atan2((120 - x) * 8, (120 - x) * (120 - x) + (36 - y) * (44 - y)) AS angle FROM shots)
SELECT event_id, CASE WHEN {VALID} THEN 'scored' ELSE 'rejected' END AS status, CASE WHEN {VALID} THEN round(1 / (1 + exp(-({SLOPE}::DOUBLE * ({SCORES}) + {SHIFT}::DOUBLE))), 8) END AS probability FROM s"""))
def batch_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = view(spark, sf_dir, "shots")
    rows = shots.withColumns({"distance": G.distance_to_goal(F.col("x"), F.col("y")), "angle": G.visible_goal_angle(F.col("x"), F.col("y")), "pressed": F.coalesce("under_pressure", F.lit(False)).cast("int")})
    good, bad = M.batch_score(rows, WEIGHTS, INTERCEPT, SLOPE, SHIFT, F.expr(VALID))
    scored = good.select("event_id", F.lit("scored").alias("status"), F.round("probability", 8).alias("probability"))
    return scored.unionByName(bad.select("event_id", F.lit("rejected").alias("status"), F.lit(None).cast("double").alias("probability")))
