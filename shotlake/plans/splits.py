"""Splits of matches by tournament, folds of development matches, and their checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import splits as P
from ..registry import query
from ..sources.documents import shared_folder
from ..sources.tables import sql_over, view
from .analysis import ELIGIBLE, SEASON
from .cohort import eligible_shots

SPLITS = {(c, s): "development" if c < 3 else "calibration" if c == 3 else "holdout" for c in range(5) for s in range(1993, 1998)}
SPLIT = "CASE WHEN season_id BETWEEN 1993 AND 1997 THEN CASE WHEN competition_id < 3 THEN 'development' WHEN competition_id = 3 THEN 'calibration' ELSE 'holdout' END END"
GROUPS = f", a AS (SELECT match_id, competition_id, season_id, match_date, {SPLIT} AS split FROM matches), d AS (SELECT match_id, ((row_number() OVER (ORDER BY match_date, match_id) - 1) % 5)::INT AS fold FROM a WHERE split = 'development'), g AS (SELECT a.*, fold FROM a LEFT JOIN d USING (match_id) WHERE split IS NOT NULL)"


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = P.assign_split(view(spark, sf_dir, "matches").select("match_id", *SEASON, "match_date"), SPLITS)
    return P.assign_folds(good).select("match_id", *SEASON, "match_date", "split", "fold")


@query(sql_over("matches", body=GROUPS + " SELECT coalesce(split, 'rejected: out of scope') AS split, count(*) AS n FROM a GROUP BY 1"))
def assign_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = P.assign_split(view(spark, sf_dir, "matches"), SPLITS)
    return good.select("split").unionByName(bad.select(F.concat(F.lit("rejected: "), "reason").alias("split"))).groupBy("split").agg(F.count("*").alias("n"))


@query(sql_over("matches", body=GROUPS + " SELECT match_id, split, fold FROM g"))
def assign_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(spark, sf_dir).select("match_id", "split", "fold")


@query(sql_over("matches", "shots", body=GROUPS + f" SELECT event_id, fold FROM shots JOIN g USING (match_id) WHERE split = 'development' AND {ELIGIBLE}"))
def fold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = assigned(spark, sf_dir).filter("split = 'development'").select("match_id", "fold")
    return eligible_shots(view(spark, sf_dir, "shots")).join(groups, "match_id").select("event_id", "fold")


@query(sql_over("matches", "shots", body=GROUPS + f""", n AS (SELECT match_id, count(*) AS k FROM shots WHERE {ELIGIBLE} GROUP BY 1), h AS (SELECT g.*, coalesce(k, 0) AS k FROM g LEFT JOIN n USING (match_id))
SELECT split, NULL::INT AS fold, count(*) AS matches, sum(k)::BIGINT AS shots, min(match_date)::VARCHAR AS first_date, max(match_date)::VARCHAR AS last_date FROM h GROUP BY 1
UNION ALL SELECT split, fold, count(*), sum(k)::BIGINT, min(match_date)::VARCHAR, max(match_date)::VARCHAR FROM h WHERE fold IS NOT NULL GROUP BY 1, 2"""))
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = eligible_shots(view(spark, sf_dir, "shots")).groupBy("match_id").agg(F.count("*").alias("eligible_shots"))
    groups = assigned(spark, sf_dir).join(counts, "match_id", "left").withColumn("eligible_shots", F.coalesce("eligible_shots", F.lit(0)))
    return P.split_summary(groups).select("split", "fold", "matches", "shots", "first_date", "last_date")


@query(sql_over("matches", body=GROUPS + " SELECT match_id, competition_id, season_id, match_date::VARCHAR AS match_date, split, fold FROM g"))
def write_read_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """write_assignments, then read_assignments of what it wrote."""
    path = f"{shared_folder(spark)}/assignments-{uuid.uuid4().hex}"
    P.write_assignments(assigned(spark, sf_dir), path)
    good, _ = P.read_assignments(spark, path)
    return good.withColumn("match_date", F.col("match_date").cast("string"))


@query(sql_over("matches", "shots", body=GROUPS + f" SELECT count(*) FILTER (WHERE split = 'calibration') AS kept, count(*) FILTER (WHERE split IS NULL) AS leaked FROM shots LEFT JOIN g USING (match_id) WHERE {ELIGIBLE}"))
def restrict_to_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, leaked = P.restrict_to_split(eligible_shots(view(spark, sf_dir, "shots")), assigned(spark, sf_dir), "calibration")
    both = kept.select(F.lit(1).alias("k")).unionByName(leaked.select(F.lit(0).alias("k")))
    return both.agg(F.count_if(F.col("k") == 1).alias("kept"), F.count_if(F.col("k") == 0).alias("leaked"))


@query(sql_over("matches", "shots", body=GROUPS + f", r AS (SELECT match_id, fold FROM shots JOIN g USING (match_id) WHERE split = 'development' AND {ELIGIBLE}) SELECT 'rows' AS name, count(*) AS found FROM r UNION ALL SELECT 'groups', count(DISTINCT match_id) FROM r" + "".join(f" UNION ALL SELECT 'fold_{k}', count(*) FILTER (WHERE fold = {k}) FROM r" for k in range(5))))
def cohort_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = eligible_shots(view(spark, sf_dir, "shots")).join(assigned(spark, sf_dir).filter("split = 'development'").select("match_id", "fold"), "match_id")
    return P.violations(rows, {"rows": F.count("*"), "groups": F.countDistinct("match_id"), **{f"fold_{k}": F.count_if(F.col("fold") == k) for k in range(5)}})


@query(sql_over("matches", "shots", body=GROUPS + f", r AS (SELECT event_id, split FROM shots LEFT JOIN g USING (match_id) WHERE {ELIGIBLE}) SELECT count(*) AS rows, count(*) FILTER (WHERE split IS NULL) AS unassigned, 0::BIGINT AS in_repeated_groups, count(*) FILTER (WHERE split = 'development') AS development, count(*) FILTER (WHERE split = 'calibration') AS calibration, count(*) FILTER (WHERE split = 'holdout') AS holdout, (SELECT count(*) FROM (SELECT event_id FROM r GROUP BY 1 HAVING count(*) > 1)) AS repeated_rows FROM r"))
def partition_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.partition_proof(eligible_shots(view(spark, sf_dir, "shots")), assigned(spark, sf_dir))


@query(sql_over("shots", body="SELECT count(*) AS n, sum(('0x' || substr(h, 1, 10))::BIGINT)::VARCHAR AS low, sum(('0x' || substr(h, 11, 10))::BIGINT)::VARCHAR AS high FROM (SELECT sha256(event_id || ':' || match_id) AS h FROM shots)"))
def membership_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.membership_digest(view(spark, sf_dir, "shots"))
