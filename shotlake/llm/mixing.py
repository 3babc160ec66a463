"""Mixing sources to target weights, in DataFrame operations only.

Words are added up per source, weights become word targets, a source's target over its size is its repetition
rate, and each document is taken floor(rate) times plus once more with the fraction as the probability. That draw
is a hash of the seed and the document's id, so reruns agree.

Edge cases: a null text has no words; a null source is a source of its own, ranked last; a null id draws like the
text "null"; rows that repeat an id share its draw; sources without words get target 0; no rows give no rows.
Columns named __mix_* are the operator's own; any others are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, hold, words


def mixing_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, max_repeats: float = 3.0) -> DataFrame:
    """Rows (source, source_size) to (source, source_size, target).

    Weights repeat over the sources in code point order, null last. Targets share `share` of all words by weight;
    one that would pass max_repeats times its source's size stops there and the excess is shared again by weight.
    With sources ordered by cap over weight, those that stop are a prefix, found by running sums in one pass.
    The windows span one row per source, never documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "rank")
    every = Window.partitionBy(F.lit(1))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    return (
        sizes.withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(listed, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("caps", F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("taken_weight", F.sum("weight").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("all_weight", F.sum("weight").over(every))
        .withColumn("before", (F.col("budget") - (F.col("caps") - F.col("cap"))) / (F.col("all_weight") - (F.col("taken_weight") - F.col("weight"))))
        .withColumn("stops", F.col("ratio") <= F.col("before"))
        .withColumn("left", F.col("budget") - F.coalesce(F.max(F.when(F.col("stops"), F.col("caps"))).over(every), F.lit(0.0)))
        .withColumn("left_weight", F.col("all_weight") - F.coalesce(F.max(F.when(F.col("stops"), F.col("taken_weight"))).over(every), F.lit(0.0)))
        .withColumn("target", F.when(F.col("stops"), F.col("cap")).otherwise(F.col("left") / F.nullif(F.col("left_weight"), F.lit(0.0)) * F.col("weight")))
        .select("source", "source_size", "target")
    )


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, max_repeats: float = 3.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with __mix_size, __mix_source_size, __mix_target and __mix_copies (how often to take the document)."""
    sized = docs.withColumn("__mix_size", F.size(words(F.col(text_col))).cast("long"))
    totals = sized.groupBy(F.col(source_col).alias("source")).agg(F.sum("__mix_size").alias("source_size"))
    targets = hold(mixing_targets(totals, weights, share, max_repeats), "targets").select(F.col("source").alias("__mix_source"), F.col("source_size").alias("__mix_source_size"), F.col("target").alias("__mix_target"))
    rate = F.least(F.lit(float(max_repeats)), F.coalesce(F.col("__mix_target") / F.nullif(F.col("__mix_source_size").cast("double"), F.lit(0.0)), F.lit(0.0)))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    return (
        sized.join(broadcast_if_small(targets), sized[source_col].eqNullSafe(F.col("__mix_source")))
        .withColumn("__mix_rate", rate)
        .withColumn("__mix_copies", (F.floor("__mix_rate") + (draw < F.col("__mix_rate") - F.floor("__mix_rate")).cast("int")).cast("int"))
        .drop("__mix_source", "__mix_rate")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each row of docs as many times as plan_mix says, with the columns of docs."""
    return plan_mix(docs, **options).withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(1), F.col("__mix_copies")))).select(*docs.columns)
