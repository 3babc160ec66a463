"""Exact running sums and quantiles over any number of rows, without a window or a task that holds them all.

Rows are dealt into ranges of their order by Spark's range partitioning, whose bounds come from a sample of the rows
themselves: ranges are even however the values lie, and no value needs a type that can be divided. Sums of the ranges
(a row each) are added up first, and windows then run within a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def in_ranges(df: DataFrame, order: list[Column], ranges: int | None = None) -> DataFrame:
    """df with __range, ascending in the order; written, so that a row's range is settled. There are as many ranges as
    shuffle partitions, so that they are as large as any task's share."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), "ranges")


def running_sums(df: DataFrame, keys: list[str], order: list[tuple[str, bool]], sums: list[str], ranges: int | None = None) -> DataFrame:
    """df with, for each summed column c of each key's rows: __to_c, the sum up to and with the row, and __all_c.

    order lists columns and whether they fall; it must tell a key's rows apart, and keys must not be null."""
    by = [F.col(c).desc() if falls else F.col(c).asc() for c, falls in order]
    ranged = in_ranges(df, [F.col(k).asc() for k in keys] + by, ranges)
    per = ranged.groupBy(*keys, "__range").agg(*[F.sum(c).alias(f"__in_{c}") for c in sums])  # ranges and keys, no more
    earlier, every = Window.partitionBy(*keys).orderBy("__range"), Window.partitionBy(*keys)
    offsets = per.select(*keys, "__range", *[(F.sum(f"__in_{c}").over(earlier) - F.col(f"__in_{c}")).alias(f"__before_{c}") for c in sums], *[F.sum(f"__in_{c}").over(every).alias(f"__all_{c}") for c in sums])
    inside = Window.partitionBy(*keys, "__range").orderBy(*by)
    found = ranged.join(offsets, [*keys, "__range"]).withColumns({f"__to_{c}": F.sum(c).over(inside) + F.col(f"__before_{c}") for c in sums})
    return found.drop("__range", *[f"__before_{c}" for c in sums])


def numbered(df: DataFrame, key: str, name: str = "place", ranges: int | None = None) -> DataFrame:
    """df with the rank from 0 of each row by a key that doesn't repeat and isn't null, of any type that has an order."""
    one = df.withColumn("__one", F.lit(1).cast("long"))
    return running_sums(one, [], [(key, False)], ["__one"], ranges).withColumn(name, F.col("__to___one") - 1).drop("__one", "__to___one", "__all___one")


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float], ranges: int | None = None) -> DataFrame:
    """(name, share, value): quantiles of columns by linear interpolation, as percentile() gives them; nulls don't count,
    and a column without values has none. Distinct values are counted first, and all columns share the two passes."""
    counts = df.unpivot([], [F.col(c).cast("double").alias(c) for c in columns], "name", "value").filter("value is not null").groupBy("name", "value").agg(F.count("*").alias("n"))
    ran = running_sums(counts, ["name"], [("value", False)], ["n"], ranges)
    # each value answers for the ranks from its first to its last copy
    at = ran.withColumn("share", F.explode(F.array(*[F.lit(float(q)) for q in shares]))).withColumn("rank", F.col("share") * (F.col("__all_n") - 1))
    first, last = F.col("__to_n") - F.col("n"), F.col("__to_n") - 1
    holds = lambda r: (r >= first) & (r <= last)
    low, high = F.floor("rank"), F.ceil("rank")
    near = at.filter(holds(low) | holds(high)).groupBy("name", "share").agg(F.max(F.when(holds(low), F.col("value"))).alias("a"), F.max(F.when(holds(high), F.col("value"))).alias("b"), F.first("rank").alias("rank"))
    part = F.col("rank") - F.floor("rank")
    return near.select("name", "share", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - part) * F.col("a") + part * F.col("b")).alias("value"))
