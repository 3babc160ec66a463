"""Expectations and reconciliation: each check is counts in tidy rows (name, n)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .counting import named_counts, union_all


def expect_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations of each row rule in one scan. As with a CHECK constraint, a rule that is null does not fail."""
    return named_counts(df, {k: ~F.coalesce(r, F.lit(True)) for k, r in rules.items()}, value="violations")


def expect_unique(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1).alias("violations")).select(F.lit(name).alias("name"), "violations")


def expect_foreign_key(child: DataFrame, keys: list[str], parent: DataFrame, parent_keys: list[str], name: str) -> DataFrame:
    """Children whose key is whole and meets no parent; a key with a null passes."""
    orphans = child.dropna(subset=keys).join(parent.select(*[F.col(p).alias(k) for k, p in zip(keys, parent_keys)]), keys, "left_anti")
    return orphans.agg(F.count("*").alias("violations")).select(F.lit(name).alias("name"), "violations")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return union_all([t.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, t in tables.items()])


def out_of_bounds(df: DataFrame, ranges: dict[str, tuple[tuple[str, float, float], ...]]) -> DataFrame:
    """Rows outside any of a check's (column, low, high) ranges. Nulls pass, but a pair that is half null does not."""
    tests = {}
    for name, cols in ranges.items():
        outside = [~F.coalesce(F.col(c).between(lo, hi), F.lit(True)) for c, lo, hi in cols]
        halves = [F.col(cols[0][0]).isNull() != F.col(c).isNull() for c, _, _ in cols[1:]]
        test = outside[0]
        for t in outside[1:] + halves:
            test = test | t
        tests[name] = test
    return named_counts(df, tests)


def orphan_edges(edges: DataFrame, nodes: DataFrame, node: str, source: str, target: str) -> DataFrame:
    """Edges with no such source or target node, one scan of the edges for both ends."""
    ids = nodes.select(F.col(node).alias("__node")).distinct().withColumn("__there", F.lit(True))
    joined = edges.join(ids.toDF(source, "__s"), source, "left").join(ids.toDF(target, "__t"), target, "left")
    return joined.agg(F.count_if(F.col("__s").isNull()).alias("no_source"), F.count_if(F.col("__t").isNull()).alias("no_target"), F.count_if(F.col("__s").isNull() | F.col("__t").isNull()).alias("orphans"))


def mapping_conflicts(df: DataFrame, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Ids with several names, and names with several ids, for each field; one pass over the rows."""
    listed = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), i.cast("string").alias("id"), n.cast("string").alias("name")) for k, (i, n) in pairs.items()]))
    flat = df.select(listed.alias("p")).select("p.*").dropna(subset=["id", "name"]).distinct()
    side = lambda a, b, kind: flat.groupBy("field", a).agg(F.count(b).alias("k")).filter("k > 1").select("field", F.lit(kind).alias("kind"))
    found = side("id", "name", "id with names").unionByName(side("name", "id", "name with ids"))
    return found.groupBy("field", "kind").agg(F.count("*").alias("n"))


def coverage(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """(name, n, total, bp): basis points rounded down, 0 for no rows."""
    one = df.agg(F.count("*").alias("total"), *[F.count_if(F.coalesce(t, F.lit(False))).alias(k) for k, t in measures.items()])
    flat = one.unpivot(["total"], list(measures), "name", "n")
    return flat.select("name", "n", "total", F.coalesce(F.expr("n * 10000 div nullif(total, 0)"), F.lit(0)).alias("bp"))


def gap(left: DataFrame, right: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows of left without a partner in right; nulls in left's keys are not counted."""
    return left.dropna(subset=keys).join(right.select(*keys).distinct(), keys, "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")


def reconcile(source: DataFrame, stored: DataFrame, key: str = "name", n: str = "n") -> DataFrame:
    both = source.select(key, F.col(n).alias("source")).join(stored.select(key, F.col(n).alias("stored")), key, "full_outer")
    return both.withColumn("status", F.when(F.col("source") == F.col("stored"), "OK").otherwise("MISMATCH"))


def report(errors: DataFrame, warnings: DataFrame, coverage_rows: DataFrame) -> DataFrame:
    """Tidy rows (section, name, n, total, status): errors fail if any, warnings never, coverage informs."""
    none = F.lit(None).cast("long")
    return union_all([
        errors.select(F.lit("error").alias("section"), "name", "n", none.alias("total"), F.when(F.col("n") > 0, "FAIL").otherwise("OK").alias("status")),
        warnings.select(F.lit("warning").alias("section"), "name", "n", none.alias("total"), F.when(F.col("n") > 0, "WARN").otherwise("OK").alias("status")),
        coverage_rows.select(F.lit("coverage").alias("section"), "name", "n", "total", F.lit("INFO").alias("status")),
    ])


def columns_like(spark: SparkSession, tables: dict[str, DataFrame], pattern: str) -> DataFrame:
    """Columns whose names match, from the schemas alone."""
    import re

    rows = [(t, c) for t, df in tables.items() for c in df.columns if re.search(pattern, c)]
    return spark.createDataFrame(rows, "table string, column string")


def latest_by(df: DataFrame, key: list[str], order: str) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).filter("__r = 1").drop("__r")
