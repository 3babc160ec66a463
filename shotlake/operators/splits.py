"""Splits by group, folds, and the proofs that nothing leaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def assign_split(groups: DataFrame, scopes: dict[tuple[int, int], str], keys: tuple[str, str] = ("competition_id", "season_id"), group: str = "match_id", date: str = "match_date") -> tuple[DataFrame, DataFrame]:
    """(groups with split, violations). A group breaks the rules if it is out of scope, undated or listed twice."""
    spark = groups.sparkSession
    table = F.broadcast(spark.createDataFrame([(*k, v) for k, v in scopes.items()], f"{keys[0]} long, {keys[1]} long, split string"))
    joined = groups.join(table, list(keys), "left").withColumn("__n", F.count("*").over(Window.partitionBy(group)))
    reason = F.when(F.col("split").isNull(), "out of scope").when(F.col(date).isNull(), "no date").when(F.col("__n") > 1, "listed twice")
    marked = joined.withColumn("reason", reason).drop("__n")
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL").select(group, "reason")


def assign_folds(groups: DataFrame, n: int = 5, split: str = "split", development: str = "development", order: tuple[str, ...] = ("match_date", "match_id")) -> DataFrame:
    """Development groups in order get folds 0..n-1 in turn, others null.

    Ranks come in two levels, so no window holds all groups: months are numbered by running counts of their few
    rows, groups within a month by a window.
    """
    month = F.date_trunc("month", F.col(order[0]))
    dev = groups.filter(F.col(split) == development).withColumn("__month", month)
    totals = dev.groupBy("__month").agg(F.count("*").alias("__k"))
    before = totals.select("__month", (F.sum("__k").over(Window.orderBy("__month")) - F.col("__k")).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__month").orderBy(*order)) - 1 + F.col("__before")
    folded = dev.join(F.broadcast(before), "__month").withColumn("fold", F.pmod(rank, F.lit(n)).cast("int")).drop("__month", "__before")
    return folded.unionByName(groups.filter(F.col(split) != development).withColumn("fold", F.lit(None).cast("int")))


def split_summary(groups: DataFrame, rows: str = "eligible_shots", date: str = "match_date") -> DataFrame:
    """Groups, rows and dates of each split, then of each fold."""
    stats = [F.count("*").alias("matches"), F.sum(rows).alias("shots"), F.min(date).cast("string").alias("first_date"), F.max(date).cast("string").alias("last_date")]
    parts = groups.groupBy("split").agg(*stats).withColumn("fold", F.lit(None).cast("int"))
    return parts.unionByName(groups.filter("fold IS NOT NULL").groupBy("split", "fold").agg(*stats))


def restrict_to_split(rows: DataFrame, groups: DataFrame, split: str, group: str = "match_id") -> tuple[DataFrame, DataFrame]:
    """(rows of the split, rows whose group has no assignment at all: a leak)."""
    return rows.join(groups.filter(F.col("split") == split).select(group), group, "left_semi"), rows.join(groups.select(group), group, "left_anti")


def partition_proof(rows: DataFrame, groups: DataFrame, group: str = "match_id", row: str = "event_id") -> DataFrame:
    """One row of counts: rows, rows of no group, rows met more than once, groups assigned twice, rows by split."""
    twice = groups.groupBy(group).agg(F.count("*").alias("k"), F.first("split").alias("split"))
    joined = rows.join(twice, group, "left")
    doubled = rows.groupBy(row).agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1).alias("repeated_rows")).withColumn("__k", F.lit(1))
    out = joined.agg(F.count("*").alias("rows"), F.count_if(F.col("split").isNull()).alias("unassigned"), F.count_if(F.col("k") > 1).alias("in_repeated_groups"), *[F.count_if(F.col("split") == s).alias(s) for s in ("development", "calibration", "holdout")])
    return out.withColumn("__k", F.lit(1)).join(doubled, "__k").drop("__k")


def write_assignments(groups: DataFrame, path: str, order: str = "match_id") -> None:
    """CSV in order of the groups' ids; folds are empty off development."""
    groups.orderBy(order).write.option("header", True).option("emptyValue", "").csv(path)


ASSIGNMENT_SCHEMA = "match_id long, competition_id long, season_id long, match_date date, split string, fold int"


def read_assignments(spark: SparkSession, path: str, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """(assignments, rejected rows with a reason)."""
    read = spark.read.schema(ASSIGNMENT_SCHEMA).option("header", True).csv(path)
    reason = (
        F.when(F.col("match_id").isNull(), "no match")
        .when(~F.coalesce(F.col("split").isin("development", "calibration", "holdout"), F.lit(False)), "unknown split")
        .when((F.col("split") == "development") & ~F.coalesce(F.col("fold").between(0, n - 1), F.lit(False)), "bad fold")
        .when((F.col("split") != "development") & F.col("fold").isNotNull(), "fold off development")
    )
    marked = read.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def membership_digest(rows: DataFrame, columns: tuple[str, ...] = ("event_id", "match_id")) -> DataFrame:
    """An order-free digest: count, and sums of two 40-bit slices of each row's SHA-256, as decimals that hold the sums
    of 10^26 rows."""
    digest = F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in columns]), 256)
    part = lambda k: F.sum(F.conv(F.substring(digest, k, 10), 16, 10).cast("decimal(28,0)")).cast("string")
    return rows.agg(F.count("*").alias("n"), part(1).alias("low"), part(11).alias("high"))


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Anchors: rows (name, expected, found, passed) from (expected, found) pairs of aggregates, in one scan."""
    one = df.agg(*[c.cast("long").alias(k) for k, c in checks.items()])
    return one.unpivot([], list(checks), "name", "found")
