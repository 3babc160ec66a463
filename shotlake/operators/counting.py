"""Counting operators that the analysis, cohort and quality queries share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(part: Column, whole: Column, places: int = 2) -> Column:
    """100 * part / whole, null for an empty whole."""
    return F.round(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), places)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def named_counts(df: DataFrame, tests: dict[str, Column], name: str = "name", value: str = "n") -> DataFrame:
    """One scan for any number of conditional counts, as rows (name, n)."""
    one = df.agg(*[F.count_if(F.coalesce(t, F.lit(False))).alias(k) for k, t in tests.items()])
    return one.unpivot([], list(tests), name, value)


def level_counts(df: DataFrame, columns: dict[str, Column], **counts: Column) -> DataFrame:
    """Rows (field, level, n, ...): counts for each level of each column, nulls a level of their own, in one scan.

    Rows are grouped by all columns together first, and only these groups are taken apart by field."""
    levels = {f"__c{i}": c.cast("string") for i, c in enumerate(columns.values())}
    flags = {f"__f{i}": F.coalesce(c, F.lit(False)) for i, c in enumerate(counts.values())}
    wide = df.select(*[c.alias(k) for k, c in (levels | flags).items()]).groupBy(*levels).agg(F.count("*").alias("__n"), *[F.count_if(k).alias(k) for k in flags])
    listed = F.array(*[F.struct(F.lit(f).alias("field"), F.col(k).alias("level")) for f, k in zip(columns, levels)])
    flat = wide.select(F.explode(listed).alias("at"), "__n", *flags)
    return flat.groupBy("at.field", "at.level").agg(F.sum("__n").alias("n"), *[F.sum(k).alias(name) for k, name in zip(flags, counts)])


def counts_by(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Children added up to their parent's grain, to be joined without fan-out."""
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def share_of_total(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts for each key with their percentage of all rows; the window spans the counts only."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", percent(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(1)))))


def previous_in_group(df: DataFrame, group: list[str], order: str, value: str, target: Column, first: str) -> DataFrame:
    """Which value comes before each target row within its group: rows (previous, n). The filter follows the window."""
    before = F.lag(value).over(Window.partitionBy(*group).orderBy(order))
    return df.withColumn("__before", before).filter(target).groupBy(F.coalesce("__before", F.lit(first)).alias("previous")).agg(F.count("*").alias("n"))
