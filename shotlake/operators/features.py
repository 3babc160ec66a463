"""Vocabulary, scaler and encoding. All fitted things are small tables of levels or numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .counting import level_counts

MISSING, RARE = "None", "rare"


def text_level(column: Column) -> Column:
    """A level as text; a missing one is the level None."""
    return F.coalesce(column.cast("string"), F.lit(MISSING))


def fit_vocabulary(rows: DataFrame, fields: dict[str, str], least: int = 25) -> DataFrame:
    """(field, level, n, role, position) from development rows. fields maps a field to its reference level.

    Levels of at least `least` rows are kept, others merged into one rare column at the end; the reference is always
    kept and has no column. Positions count from 1 in level order; a field without rare levels has no rare column.
    """
    counts = level_counts(rows, {f: text_level(F.col(f)) for f in fields})
    reference = F.element_at(F.create_map(*[F.lit(x) for kv in fields.items() for x in kv]), F.col("field"))
    role = F.when(F.col("level") == reference, "reference").when(F.col("n") >= least, "kept").otherwise(RARE)
    marked = counts.withColumn("role", role)
    kept = F.count_if(F.col("role") == "kept").over(Window.partitionBy("field"))
    order = F.row_number().over(Window.partitionBy("field", "role").orderBy("level"))  # windows over levels, not rows
    return marked.select("field", "level", "n", "role", F.when(F.col("role") == "kept", order).when(F.col("role") == RARE, kept + 1).alias("position"))


def encode(rows: DataFrame, vocabulary: list, fields: list[str]) -> DataFrame:
    """One 0/1 column a kept level, and one for a field's rare levels. vocabulary: the collected table, which is
    bounded by the levels. A level that development rows never had is all zeros, as is the reference."""
    columns = []
    for f in fields:
        known = [r for r in vocabulary if r.field == f]
        rare = [r.level for r in known if r.role == RARE]
        columns += [(text_level(F.col(f)) == r.level).cast("int").alias(f"{f}={r.level}") for r in sorted((r for r in known if r.role == "kept"), key=lambda r: r.level)]
        if rare:
            columns.append(text_level(F.col(f)).isin(rare).cast("int").alias(f"{f}={RARE}"))
    return rows.select("*", *columns)


def fold_scalers(rows: DataFrame, columns: list[str], fold: str = "fold") -> DataFrame:
    """(fold, column, mean, sd): of the rows of all other folds, from one pass of sums for each fold.

    Sums are taken about an overall mean, so that large offsets cancel early; a zero deviation is null.
    """
    centre = rows.agg(*[F.avg(c).alias(c) for c in columns]).first().asDict()
    parts = rows.groupBy(fold).agg(F.count("*").cast("double").alias("n"), *[f for c in columns for f in (F.sum(F.col(c) - F.lit(centre[c] or 0.0)).alias(f"s_{c}"), F.sum((F.col(c) - F.lit(centre[c] or 0.0)) ** 2).alias(f"q_{c}"))])
    every = Window.partitionBy(F.lit(1))  # a row a fold
    out = None
    for c in columns:
        n, s, q = (F.sum(k).over(every) - F.col(k) for k in ("n", f"s_{c}", f"q_{c}"))
        one = parts.select(fold, F.lit(c).alias("column"), (s / n + F.lit(centre[c] or 0.0)).alias("mean"), F.nullif(F.sqrt(F.greatest(q / n - (s / n) ** 2, F.lit(0.0))), F.lit(0.0)).alias("sd"))
        out = one if out is None else out.unionByName(one)
    return out


def scale(rows: DataFrame, scalers: list, columns: list[str], fold: int | None = None) -> DataFrame:
    known = {r.column: r for r in scalers if fold is None or r.fold == fold}
    return rows.withColumns({f"z_{c}": (F.col(c) - F.lit(known[c].mean)) / F.lit(known[c].sd) for c in columns})
