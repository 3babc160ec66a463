"""Probability metrics as aggregates over rows (y, p, ...). y is 0 or 1, p a probability."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import EQUAL_WIDTH_EDGES, edge_bin, log_loss, squared_error
from ..sources.shared import written
from .ranges import numbered, running_sums

#: Clusters of a block, and replicates of a slice of the bootstrap: fewer where clusters are so many that a slice's
#: counts would pass CELLS numbers.
BLOCK, SLICE, CELLS = 8192, 32, 1 << 24


def loss_table(df: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """n, positives, log loss and Brier score for each key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("positives"), F.avg(log_loss(F.col(y), F.col(p))).alias("log_loss"), F.avg(squared_error(F.col(y), F.col(p))).alias("brier"))


def by_score(df: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """(keys, p, positives, n): rows reduced to distinct scores. Rows without a score are left out."""
    return df.filter(F.col(p).isNotNull()).groupBy(*keys, F.col(p).alias("p")).agg(F.sum(F.col(y).cast("double")).alias("positives"), F.count("*").cast("double").alias("n"))


def rank_metrics(df: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """ROC AUC (ties count half) and average precision (step sum over tied groups) for each key; null for one class.
    Rows without a score are left out. Running sums over the scores are taken by ranges of them (see running_sums)."""
    return score_metrics(by_score(df, keys, y, p), keys).select(*keys, "roc_auc", "pr_auc")


def score_metrics(scores: DataFrame, keys: list[str]) -> DataFrame:
    """n, positives, losses and rank metrics of each key, all from one table of distinct scores (see by_score)."""
    ran = running_sums(scores, keys, [("p", True)], ["positives", "n"])
    pos, n, tp, k, p = (F.col(c) for c in ("positives", "n", "__to_positives", "__to_n", "p"))
    all_pos, neg = F.col("__all_positives"), n - pos
    both = all_pos * (F.col("__all_n") - all_pos)
    one, none = F.lit(1), F.lit(0)
    return ran.groupBy(*keys).agg(
        F.sum("n").cast("long").alias("n"), F.sum("positives").cast("long").alias("positives"),
        (F.sum(pos * log_loss(one, p) + neg * log_loss(none, p)) / F.sum("n")).alias("log_loss"), (F.sum(pos * squared_error(one, p) + neg * squared_error(none, p)) / F.sum("n")).alias("brier"),
        (F.sum(neg * (tp - pos + pos / 2)) / F.nullif(F.first(both), F.lit(0.0))).alias("roc_auc"), F.sum(F.when(both > 0, pos / all_pos * tp / k)).alias("pr_auc"),
    )


def reliability(df: DataFrame, keys: list[str], edges: tuple[float, ...] = EQUAL_WIDTH_EDGES, y: str = "y", p: str = "p", anchor: Column | None = None) -> DataFrame:
    """All bins for each key: n, positives, mean p and observed rate (null when empty). anchor is what is binned."""
    binned = df.withColumn("bin", edge_bin(F.col(p) if anchor is None else anchor, edges))
    found = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("positives"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))
    bins = F.explode(F.sequence(F.lit(0), F.lit(len(edges)))).alias("bin")
    frame = df.select(*keys).distinct().select(*keys, bins) if keys else df.sparkSession.range(1).select(bins)
    return frame.join(found, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("positives", F.lit(0)).alias("positives"), "mean_p", "rate")


def supported_deviation(table: DataFrame, keys: list[str], least: int = 100, empty: float | None = 0.0) -> DataFrame:
    """Largest |mean p - rate| over bins of at least `least` rows; `empty` (a number or null) where there are none."""
    gap = F.when(F.col("n") >= least, F.abs(F.col("mean_p") - F.col("rate")))
    return table.groupBy(*keys).agg(F.coalesce(F.max(gap), F.lit(empty).cast("double")).alias("max_deviation"), F.count(gap).alias("supported"))


def fold_summary(df: DataFrame, fold: str = "fold", keys: list[str] | None = None) -> DataFrame:
    """Unweighted mean and population deviation of fold log losses, mean fold Brier, and pooled losses."""
    keys = keys or []
    folds = loss_table(df, [*keys, fold])
    over = folds.groupBy(*keys).agg(F.avg("log_loss").alias("mean_log_loss"), F.stddev_pop("log_loss").alias("sd_log_loss"), F.avg("brier").alias("mean_brier"), F.sum("n").alias("n"))
    pooled = folds.groupBy(*keys).agg((F.sum(F.col("log_loss") * F.col("n")) / F.sum("n")).alias("pooled_log_loss"), (F.sum(F.col("brier") * F.col("n")) / F.sum("n")).alias("pooled_brier"))
    return over.join(pooled, keys) if keys else over.withColumn("__one", F.lit(1)).join(pooled.withColumn("__one", F.lit(1)), "__one").drop("__one")


def replacement_rule(metrics: DataFrame, name: str = "candidate") -> DataFrame:
    """For each ordered pair of the few candidates, whether the second may replace the first: lower mean log loss by more
    than the incumbent's deviation, and no worse Brier, bin deviation or fold deviation."""
    a, b = metrics.alias("a"), metrics.alias("b")
    tests = {"better_loss": "b.mean_log_loss < a.mean_log_loss - a.sd_log_loss", "brier_ok": "b.mean_brier <= a.mean_brier", "deviation_ok": "b.max_deviation <= a.max_deviation", "sd_ok": "b.sd_log_loss <= a.sd_log_loss"}
    pairs = a.join(b, F.expr(f"a.{name} <> b.{name}"))  # a row a candidate on either side
    out = pairs.select(F.col(f"a.{name}").alias("incumbent"), F.col(f"b.{name}").alias("candidate"), *[F.expr(t).alias(k) for k, t in tests.items()])
    return out.withColumn("replaces", F.expr(" AND ".join(tests)))


def bootstrap_draw(replicate: Column, k: Column, n: Column) -> Column:
    """Which of n clusters is the k-th draw of a replicate: a hash, so any engine draws alike."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", replicate.cast("string"), k.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % n


def cluster_bootstrap(df: DataFrame, cluster: str, replicates: int = 2000, y: str = "y", ps: tuple[str, ...] = ("p",)) -> DataFrame:
    """2.5 % and 97.5 % quantiles of log loss and Brier over resampled clusters, and of the difference of the first two
    probabilities' log losses.

    Rows are reduced to sums for each cluster, and these to blocks of BLOCK clusters. Draws are counted where they are
    made: a task keeps, for some replicates, how often each cluster of a block was drawn, so that what is shuffled is
    one row a block of clusters and a slice of replicates, and multiplies these arrays with the block's sums."""
    names = [f"{m}_{p}" for p in ps for m in ("ll", "se")]
    sums = [f(F.col(y), F.col(p)) for p in ps for f in (log_loss, squared_error)]
    one = df.groupBy(cluster).agg(F.count("*").cast("double").alias("n"), *[F.sum(x).alias(name) for x, name in zip(sums, names)])
    placed = written(numbered(one.filter(F.col(cluster).isNotNull()), cluster), "clusters")
    spark = df.sparkSession
    n = max(1, placed.count())
    together, width = max(1, min(SLICE, CELLS // n)), min(BLOCK, n)
    blocks = placed.groupBy(F.expr(f"place div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(F.struct((F.col("place") % BLOCK).alias("place"), F.array("n", *names).alias("sums")))).alias("rows"))
    blocks = blocks.select("block", F.flatten(F.col("rows.sums")).alias("sums"))
    numbers = spark.range(0, replicates * n, 1, max(1, min(-(-replicates // together), 4 * spark.sparkContext.defaultParallelism)))
    draws = numbers.select(F.expr(f"id div {n}").alias("replicate"), bootstrap_draw(F.expr(f"id div {n}"), F.col("id") % n, F.lit(n)).alias("place"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Draws come in the order of replicates; those of a slice are added up until the next begins."""
        at, held = None, {}
        for batch in batches:
            replicate, place = (c.to_numpy() for c in batch.columns)
            for part in np.unique(replicate // together):
                mine = replicate // together == part
                if part != at:
                    yield from sent(at, held)
                    at, held = part, {}
                for block in np.unique(place[mine] // BLOCK):
                    here = mine & (place // BLOCK == block)
                    spot = (replicate[here] - part * together) * width + place[here] % BLOCK
                    held.setdefault(int(block), np.zeros(together * width, np.int32))[:] += np.bincount(spot, minlength=together * width).astype(np.int32)
        yield from sent(at, held)

    def sent(part: int | None, held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for block, times in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([int(part)], pa.int64()), pa.array([block], pa.int64()), pa.array([times])], ["slice", "block", "times"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, times, sums in zip(*(batch.column(k) for k in range(3))):
                sums = sums.values.to_numpy().reshape(-1, 1 + len(names))
                found = times.values.to_numpy().reshape(together, width)[:, : len(sums)] @ sums
                live = np.flatnonzero(found[:, 0] > 0)
                yield pa.RecordBatch.from_arrays([pa.array(part.as_py() * together + live), *(pa.array(found[live, c]) for c in range(found.shape[1]))], ["replicate", "n", *names])

    counted = draws.mapInArrow(count, "slice long, block long, times array<int>")
    made = counted.join(blocks, "block").select("slice", "times", "sums").mapInArrow(multiply, ", ".join(["replicate long", "n double", *(f"`{c}` double" for c in names)]))
    per = made.groupBy("replicate").agg(*[(F.sum(c) / F.sum("n")).alias(c) for c in names])
    if len(ps) > 1:
        per = per.withColumn("ll_difference", F.col(f"ll_{ps[1]}") - F.col(f"ll_{ps[0]}"))
    flat = per.unpivot(["replicate"], [c for c in per.columns if c != "replicate"], "metric", "value")
    return flat.groupBy("metric").agg(F.expr("percentile(value, 0.025)").alias("low"), F.expr("percentile(value, 0.975)").alias("high"))  # a row a replicate


def slices(df: DataFrame, families: dict[str, Column], cluster: str, least: tuple[int, int, int, int] = (50, 5, 5, 10), y: str = "y", p: str = "p") -> DataFrame:
    """Metrics for each level of each family. A level is supported with at least (rows, ones, zeros, clusters);
    others show their counts alone. Counts, losses and ranks come from one table of distinct scores; rows without a
    score are left out."""
    names = {k: f"__f{i}" for i, k in enumerate(families)}
    levels = [F.coalesce(c.cast("string"), F.lit("[missing]")).alias(names[k]) for k, c in families.items()]
    rows = written(df.filter(F.col(p).isNotNull()).select(F.col(y).alias("y"), F.col(p).alias("p"), F.col(cluster).alias("cluster"), *levels), "slices")
    listed = F.explode(F.array(*[F.struct(F.lit(k).alias("family"), F.col(n).alias("level")) for k, n in names.items()])).alias("at")
    keys = ["family", "level"]
    scores = by_score(rows.select("y", "p", listed).select("y", "p", "at.*"), keys)
    # few sets of levels a cluster, so these are told apart before they are listed by family
    met = rows.select("cluster", *names.values()).distinct().select("cluster", listed).select("cluster", "at.*").distinct()
    clusters = met.groupBy(*keys).agg(F.count("cluster").alias("clusters"))
    table = score_metrics(scores, keys).join(clusters, keys)
    ok = (F.col("n") >= least[0]) & (F.col("positives") >= least[1]) & (F.col("n") - F.col("positives") >= least[2]) & (F.col("clusters") >= least[3])
    return table.select(*keys, "n", "positives", "clusters", ok.alias("supported"), *[F.when(ok, F.col(c)).alias(c) for c in ("log_loss", "brier", "roc_auc", "pr_auc")])


def compare_runs(a: DataFrame, b: DataFrame, key: str = "metric", value: str = "value", tolerance: float = 1e-9) -> DataFrame:
    """Rows of either table: both values, their difference, and whether it is within the tolerance; a missing key fails."""
    joined = a.select(key, F.col(value).alias("left")).join(b.select(key, F.col(value).alias("right")), key, "full_outer")
    delta = F.col("right") - F.col("left")
    same = F.col("left").isNull() & F.col("right").isNull()
    return joined.select(key, "left", "right", delta.alias("delta"), F.coalesce(F.abs(delta) <= tolerance, same & F.lit(False)).alias("passed"))
