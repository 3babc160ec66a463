"""Pages and facets of shots. Limits here are the pages themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..registry import query
from ..sources.tables import sql_over, view
from .analysis import ELIGIBLE
from .cohort import eligible_shots
from .modelling import batch_score as score_shots

FILTERS = ("match_id", "team_id", "player_id", "body_part_name", "technique_name", "play_pattern_name", "shot_type_name")


@query(sql_over("shots", "matches", body="SELECT event_id, match_id, player_id, outcome_name, x, y, (SELECT count(*) FROM shots JOIN matches USING (match_id) WHERE competition_id = 2) AS total FROM shots JOIN matches USING (match_id) WHERE competition_id = 2 ORDER BY match_id, event_index, event_id LIMIT 1000 OFFSET 100"))
def shots_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "shots").join(view(spark, sf_dir, "matches").filter("competition_id = 2").select("match_id"), "match_id")
    total = rows.agg(F.count("*").alias("total"))
    return R.page(rows, ["match_id", "event_index", "event_id"], 5000, 100).select("event_id", "match_id", "player_id", "outcome_name", "x", "y").withColumn("k", F.lit(1)).join(total.withColumn("k", F.lit(1)), "k").drop("k")


@query(sql_over("shots", body="""
, n AS (SELECT event_id, minute, player_id, row_number() OVER (ORDER BY minute, player_id DESC NULLS LAST, event_id) AS place FROM (SELECT DISTINCT event_id, minute, player_id FROM shots)) SELECT * FROM n WHERE place > 1400 AND place <= 2100"""))
def shots_by_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of 700, by the tokens of those before it."""
    rows, token, found = view(spark, sf_dir, "shots").select("event_id", "minute", "player_id").distinct(), R.START, None
    for _ in range(3):
        found, token = R.page_from(rows, {"minute": False, "player_id": True, "event_id": False}, 700, token)
    return found


@query(sql_over("shots", body=f"SELECT event_id, match_id, coalesce(play_pattern_name, 'None') AS play_pattern_name, body_part_name FROM shots WHERE {ELIGIBLE} AND coalesce(play_pattern_name, 'None') = 'None' AND body_part_name = 'Head' ORDER BY minute DESC NULLS LAST, event_id LIMIT 500"))
def scored_shots_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.filter_equal(eligible_shots(view(spark, sf_dir, "shots")), FILTERS, play_pattern_name="None", body_part_name="Head")
    return R.page(rows, [F.desc_nulls_last("minute"), "event_id"], 500).select("event_id", "match_id", F.coalesce("play_pattern_name", F.lit("None")).alias("play_pattern_name"), "body_part_name")


@query(sql_over("shots", body="""
, p AS (SELECT event_id, match_id, outcome_name, x, y, under_pressure, shot_type_name FROM shots ORDER BY match_id, event_index, event_id LIMIT 1000), s AS (SELECT *, sqrt((120 - x) * (120 - x) + (y - 40) * (y - 40)) AS distance, atan2((120 - x) * 8, (120 - x) * (120 - x) + (36 - y) * (44 - y)) AS angle FROM p)
SELECT event_id, match_id, outcome_name, CASE WHEN x BETWEEN 0 AND 120 AND y BETWEEN 0 AND 80 AND shot_type_name <> 'Penalty' THEN round(1 / (1 + exp(-(1.2::DOUBLE * (-0.8::DOUBLE + distance * -0.12::DOUBLE + angle * 1.4::DOUBLE + (CASE WHEN under_pressure THEN 1 ELSE 0 END) * -0.25::DOUBLE) + 0.1::DOUBLE))), 8) END AS probability FROM s"""))
def score_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.page(view(spark, sf_dir, "shots"), ["match_id", "event_index", "event_id"], 1000).select("event_id", "match_id", "outcome_name")
    return score_shots(spark, sf_dir).join(F.broadcast(rows), "event_id").select("event_id", "match_id", "outcome_name", "probability")  # a page has 1000 rows at most


@query(sql_over("shots", body=" UNION ALL ".join(f"SELECT DISTINCT '{c}' AS field, coalesce({c}::VARCHAR, 'None') AS value FROM shots" for c in FILTERS[1:])))
def filter_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.facets(view(spark, sf_dir, "shots"), list(FILTERS[1:]))


@query(sql_over("shots", body="SELECT event_id FROM shots WHERE technique_name = 'Volley' AND shot_type_name = 'Open Play' AND play_pattern_name IS NULL"))
def filter_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.filter_equal(view(spark, sf_dir, "shots"), FILTERS, technique_name="Volley", shot_type_name="Open Play", play_pattern_name="None").select("event_id")


@query(sql_over("shots", body="SELECT event_id, x, y, coalesce(outcome_name = 'Goal', false) AS is_goal FROM shots WHERE x IS NOT NULL AND y IS NOT NULL"))
def plottable_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.plottable(view(spark, sf_dir, "shots")).select("event_id", "x", "y", "is_goal")
