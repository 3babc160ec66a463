"""Metrics of scored events: purchases against a score from their value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import evaluation as E
from ..operators.models import linear_score
from ..registry import query
from ..sources.tables import sql_over, view
from .modelling import FEATURES, INTERCEPT, REFERENCE, SCORES, WEIGHTS, feature_rows

LL = "-ln(greatest(least(CASE WHEN y = 1 THEN {p} ELSE 1.0::DOUBLE - {p} END, 1.0::DOUBLE), 1e-15))"
RANKS = """, g AS (SELECT {keys} p, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM {source} GROUP BY ALL),
r AS (SELECT *, sum(pos) OVER (PARTITION BY {part} ORDER BY p DESC) AS tp, sum(n) OVER (PARTITION BY {part} ORDER BY p DESC) AS k, sum(pos) OVER (PARTITION BY {part}) AS ap, sum(n) OVER (PARTITION BY {part}) AS an FROM g)"""
AUCS = "round(sum((n - pos) * (tp - pos + pos / 2)) / nullif(first(ap * (an - ap)), 0), 9) AS roc_auc, round(sum(CASE WHEN ap * (an - ap) > 0 THEN pos / ap * tp / k END), 9) AS pr_auc"
BIN = "CASE WHEN {p} >= 0.8 THEN 4 WHEN {p} >= {third}::DOUBLE THEN 3 WHEN {p} >= 0.4 THEN 2 WHEN {p} >= 0.2 THEN 1 ELSE 0 END"
EQUAL = BIN.format(p="p", third="0.6000000000000001")
ANCHOR = BIN.format(p="p", third="0.6")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "scored")


def rounded(df: DataFrame, *names: str, places: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


@query(sql_over("scored", body=f"SELECT round(avg({LL.format(p='p')}), 9) AS log_loss FROM scored"))
def log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).agg(F.round(F.avg(S.log_loss(F.col("y"), F.col("p"))), 9).alias("log_loss"))


@query(sql_over("scored", body="SELECT round(avg((y - p) * (y - p)), 9) AS brier FROM scored"))
def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).agg(F.round(F.avg(S.squared_error(F.col("y"), F.col("p"))), 9).alias("brier"))


@query(sql_over("scored", body=RANKS.format(keys="fold,", source="scored", part="fold") + f"SELECT fold, {AUCS.split(', round(sum(CASE')[0]} FROM r GROUP BY fold"))
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.rank_metrics(scored(spark, sf_dir), ["fold"]).select("fold", "roc_auc"), "roc_auc")


@query(sql_over("scored", body=RANKS.format(keys="fold,", source="scored", part="fold") + "SELECT fold, round(sum(CASE WHEN ap * (an - ap) > 0 THEN pos / ap * tp / k END), 9) AS pr_auc FROM r GROUP BY fold"))
def pr_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.rank_metrics(scored(spark, sf_dir), ["fold"]).select("fold", "pr_auc"), "pr_auc")


RELIABILITY = "SELECT bin, coalesce(n, 0) AS n, coalesce(positives, 0)::BIGINT AS positives, mean_p, rate FROM (SELECT unnest([0, 1, 2, 3, 4]) AS bin) LEFT JOIN b USING (bin)"


@query(sql_over("scored", body=f", b AS (SELECT {EQUAL} AS bin, count(*) AS n, sum(y) AS positives, round(avg(p), 9) AS mean_p, round(avg(y), 9) AS rate FROM scored GROUP BY 1) {RELIABILITY}"))
def reliability_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.reliability(scored(spark, sf_dir), []), "mean_p", "rate")


@query(sql_over("scored", body=f"SELECT {ANCHOR} AS bin, count(*) AS n, round(avg(p), 9) AS mean_raw, round(avg(p_other), 9) AS mean_other, round(avg(y), 9) AS rate FROM scored GROUP BY 1"))
def raw_anchor_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir)
    raw = E.reliability(df, [], S.RAW_ANCHOR_EDGES).select("bin", "n", F.col("mean_p").alias("mean_raw"), "rate")
    other = E.reliability(df, [], S.RAW_ANCHOR_EDGES, p="p_other", anchor=F.col("p")).select("bin", F.col("mean_p").alias("mean_other"))
    return rounded(raw.join(other, "bin").filter("n > 0").select("bin", "n", "mean_raw", "mean_other", "rate"), "mean_raw", "mean_other", "rate")


@query(sql_over("scored", body=f"""
, b AS (SELECT fold, {EQUAL} AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM scored GROUP BY 1, 2)
SELECT fold, round(coalesce(max(CASE WHEN n >= 100 THEN gap END), 0), 9) AS max_deviation, count(CASE WHEN n >= 100 THEN gap END) AS supported FROM b GROUP BY 1"""))
def supported_max_dev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.supported_deviation(E.reliability(scored(spark, sf_dir), ["fold"]), ["fold"]), "max_deviation")


@query(sql_over("scored", body=f"""
, f AS (SELECT fold, count(*) AS n, avg({LL.format(p='p')}) AS ll, avg((y - p) * (y - p)) AS b FROM scored GROUP BY 1)
SELECT round(avg(ll), 9) AS mean_log_loss, round(stddev_pop(ll), 9) AS sd_log_loss, round(avg(b), 9) AS mean_brier, sum(n)::BIGINT AS n, round(sum(ll * n) / sum(n), 9) AS pooled_log_loss, round(sum(b * n) / sum(n), 9) AS pooled_brier FROM f"""))
def evaluate_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.fold_summary(scored(spark, sf_dir)), "mean_log_loss", "sd_log_loss", "mean_brier", "pooled_log_loss", "pooled_brier")


def _candidates(df: DataFrame) -> DataFrame:
    return df.select("fold", "cluster_id", "y", F.explode(F.array(F.struct(F.lit("raw").alias("candidate"), "p"), F.struct(F.lit("other").alias("candidate"), F.col("p_other").alias("p")))).alias("c")).select("fold", "cluster_id", "y", "c.*")


CANDIDATES = ", c AS (SELECT fold, cluster_id, 'raw' AS candidate, y, p FROM scored UNION ALL SELECT fold, cluster_id, 'other', y, p_other FROM scored)"


@query(sql_over("scored", body=f"""{CANDIDATES},
f AS (SELECT candidate, fold, avg({LL.format(p='p')}) AS ll, avg((y - p) * (y - p)) AS b FROM c GROUP BY 1, 2), m AS (SELECT candidate, avg(ll) AS mll, stddev_pop(ll) AS sd, avg(b) AS mb FROM f GROUP BY 1),
bins AS (SELECT candidate, {EQUAL} AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM c GROUP BY 1, 2), d AS (SELECT candidate, coalesce(max(CASE WHEN n >= 100 THEN gap END), 0) AS dev FROM bins GROUP BY 1), t AS (SELECT * FROM m JOIN d USING (candidate))
SELECT a.candidate AS incumbent, b.candidate AS candidate, b.mll < a.mll - a.sd AS better_loss, b.mb <= a.mb AS brier_ok, b.dev <= a.dev AS deviation_ok, b.sd <= a.sd AS sd_ok,
 b.mll < a.mll - a.sd AND b.mb <= a.mb AND b.dev <= a.dev AND b.sd <= a.sd AS replaces FROM t a JOIN t b ON a.candidate <> b.candidate"""))
def replacement_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(scored(spark, sf_dir))
    metrics = E.fold_summary(c, keys=["candidate"]).join(E.supported_deviation(E.reliability(c, ["candidate"]), ["candidate"]), "candidate")
    return E.replacement_rule(metrics)


@query(sql_over("scored", body=f"""
, f AS (SELECT fold, avg({LL.format(p='p')}) - avg({LL.format(p='p_other')}) AS dll, avg((y - p) * (y - p)) - avg((y - p_other) * (y - p_other)) AS db FROM scored GROUP BY 1)
SELECT count(*) FILTER (WHERE dll < 0) AS better_folds, round(avg(dll), 9) AS mean_loss_delta, round(avg(db), 9) AS mean_brier_delta, count(*) FILTER (WHERE dll < 0) >= 4 AND avg(dll) < 0 AND avg(db) < 0 AS included FROM f"""))
def presence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir)
    a, b = E.loss_table(df, ["fold"]), E.loss_table(df, ["fold"], p="p_other").select("fold", F.col("log_loss").alias("ll0"), F.col("brier").alias("b0"))
    d = a.join(b, "fold").select((F.col("log_loss") - F.col("ll0")).alias("dll"), (F.col("brier") - F.col("b0")).alias("db"))
    better = F.count_if(F.col("dll") < 0)
    return d.agg(better.alias("better_folds"), F.round(F.avg("dll"), 9).alias("mean_loss_delta"), F.round(F.avg("db"), 9).alias("mean_brier_delta"), ((better >= 4) & (F.avg("dll") < 0) & (F.avg("db") < 0)).alias("included"))


OTHER = BIN.format(p="p_other", third="0.6000000000000001")


@query(sql_over("scored", body=f"""
, a AS (SELECT {EQUAL} AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM scored GROUP BY 1), b AS (SELECT {OTHER} AS bin, count(*) AS n, abs(avg(p_other) - avg(y)) AS gap FROM scored GROUP BY 1)
SELECT count(*) AS shared_bins, round(max(a.gap), 9) AS deviation, round(max(b.gap), 9) AS other_deviation FROM a JOIN b USING (bin) WHERE a.n >= 100 AND b.n >= 100"""))
def paired_bin_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir)
    gap = F.abs(F.col("mean_p") - F.col("rate"))
    a = E.reliability(df, []).filter("n >= 100").select("bin", gap.alias("gap"))
    b = E.reliability(df, [], p="p_other").filter("n >= 100").select("bin", gap.alias("other"))
    return a.join(b, "bin").agg(F.count("*").alias("shared_bins"), F.round(F.max("gap"), 9).alias("deviation"), F.round(F.max("other"), 9).alias("other_deviation"))


ADOPT = f"""
, a AS (SELECT {ANCHOR} AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap, abs(avg(p_other) - avg(y)) AS other FROM scored GROUP BY 1),
m AS (SELECT avg({LL.format(p='p')}) AS ll, avg({LL.format(p='p_other')}) AS ll2, avg((y - p) * (y - p)) AS b, avg((y - p_other) * (y - p_other)) AS b2 FROM scored),
s AS (SELECT count(*) AS bins, max(gap) AS gap, max(other) AS other FROM a WHERE n >= 100)
SELECT concat_ws(',', CASE WHEN bins = 0 THEN 'no supported bin' END, CASE WHEN coalesce(gap - other, 0) < 1e-12 THEN 'deviation' END, CASE WHEN ll2 - ll > 1e-12 THEN 'log loss' END, CASE WHEN b2 - b > 1e-12 THEN 'brier' END) AS reasons,
 bins > 0 AND coalesce(gap - other, 0) >= 1e-12 AND ll2 - ll <= 1e-12 AND b2 - b <= 1e-12 AS adopted FROM m, s"""


@query(sql_over("scored", body=ADOPT))
def calibration_adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir)
    raw = E.reliability(df, [], S.RAW_ANCHOR_EDGES)
    other = E.reliability(df, [], S.RAW_ANCHOR_EDGES, p="p_other", anchor=F.col("p"))
    dev = E.supported_deviation(raw, [], empty=None).select(F.lit(1).alias("k"), F.col("max_deviation").alias("gap"), F.col("supported").alias("bins"))
    dev2 = E.supported_deviation(other, [], empty=None).select(F.lit(1).alias("k"), F.col("max_deviation").alias("other"))
    y, p, q = F.col("y"), F.col("p"), F.col("p_other")
    losses = df.agg((F.avg(S.log_loss(y, q)) - F.avg(S.log_loss(y, p))).alias("dll"), (F.avg(S.squared_error(y, q)) - F.avg(S.squared_error(y, p))).alias("db")).withColumn("k", F.lit(1))
    tests = {"no supported bin": F.col("bins") == 0, "deviation": F.coalesce(F.col("gap") - F.col("other"), F.lit(0.0)) < 1e-12, "log loss": F.col("dll") > 1e-12, "brier": F.col("db") > 1e-12}
    reasons = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))
    return losses.join(dev, "k").join(dev2, "k").select(F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("adopted"))


@query(sql_over("scored", body=f"{CANDIDATES}" + RANKS.format(keys="candidate,", source="c", part="candidate") + f""",
a AS (SELECT candidate, {AUCS} FROM r GROUP BY 1) SELECT candidate, count(*) AS n, sum(y)::BIGINT AS positives, round(avg(y), 9) AS prevalence, round(avg({LL.format(p='p')}), 9) AS log_loss, round(avg((y - p) * (y - p)), 9) AS brier, first(roc_auc) AS roc_auc, first(pr_auc) AS pr_auc FROM c JOIN a USING (candidate) GROUP BY 1"""))
def score_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(scored(spark, sf_dir))
    out = E.loss_table(c, ["candidate"]).withColumn("prevalence", F.col("positives") / F.col("n")).join(E.rank_metrics(c, ["candidate"]), "candidate")
    return rounded(out, "prevalence", "log_loss", "brier", "roc_auc", "pr_auc")


@query(sql_over("scored", body=f"""
, s AS (SELECT cluster_id, count(*)::DOUBLE AS n, sum({LL.format(p='p')}) AS a, sum((y - p) * (y - p)) AS b, sum({LL.format(p='p_other')}) AS c, sum((y - p_other) * (y - p_other)) AS d, row_number() OVER (ORDER BY cluster_id) - 1 AS place FROM scored GROUP BY 1),
w AS (SELECT r.range AS replicate, ('0x' || substr(md5(r.range || ':' || k.range), 1, 8))::BIGINT % (SELECT count(*) FROM s) AS place FROM range(2000) r, range((SELECT count(*) FROM s)) k),
e AS (SELECT replicate, sum(a) / sum(n) AS ll_p, sum(b) / sum(n) AS se_p, sum(c) / sum(n) AS ll_p_other, sum(d) / sum(n) AS se_p_other FROM w JOIN s USING (place) GROUP BY 1),
u AS (SELECT 'll_p' AS metric, ll_p AS v FROM e UNION ALL SELECT 'se_p', se_p FROM e UNION ALL SELECT 'll_p_other', ll_p_other FROM e UNION ALL SELECT 'se_p_other', se_p_other FROM e UNION ALL SELECT 'll_difference', ll_p_other - ll_p FROM e)
SELECT metric, round(quantile_cont(v, 0.025), 9) AS low, round(quantile_cont(v, 0.975), 9) AS high FROM u GROUP BY 1"""))
def paired_cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.cluster_bootstrap(scored(spark, sf_dir), "cluster_id", ps=("p", "p_other")), "low", "high")


BANDS = {"distance": (S.DISTANCE_EDGES, "distance"), "angle": (S.ANGLE_EDGES, "angle")}


def band_sql(column: str, edges: tuple[float, ...]) -> str:
    """The labels of functions.scores.band_label."""
    inner = "".join(f" WHEN {column} < {b:g}::DOUBLE THEN '[{a:g},{b:g})'" for a, b in zip(edges, edges[1:]))
    return f"CASE WHEN {column} < {edges[0]:g}::DOUBLE THEN '<{edges[0]:g}'{inner} ELSE '>={edges[-1]:g}' END"


@query(sql_over("shots", body=FEATURES + f", s AS (SELECT *, 1 / (1 + exp(-round({SCORES}, 6))) AS p FROM f), f2 AS ("
    + " UNION ALL ".join([*(f"SELECT '{k}' AS family, coalesce({k}, '[missing]') AS level, y, p, match_id AS cluster_id FROM s" for k in REFERENCE), *(f"SELECT '{k}', {band_sql(c, edges)}, y, p, match_id FROM s" for k, (edges, c) in BANDS.items())]) + ")"
    + RANKS.format(keys="family, level,", source="f2", part="family, level") + f""",
a AS (SELECT family, level, {AUCS} FROM r GROUP BY 1, 2), t AS (SELECT family, level, count(*) AS n, sum(y)::BIGINT AS positives, count(DISTINCT cluster_id) AS clusters, round(avg({LL.format(p='p')}), 9) AS log_loss, round(avg((y - p) * (y - p)), 9) AS brier FROM f2 GROUP BY 1, 2),
o AS (SELECT *, n >= 50 AND positives >= 5 AND n - positives >= 5 AND clusters >= 10 AS supported FROM t JOIN a USING (family, level))
SELECT family, level, n, positives, clusters, supported, CASE WHEN supported THEN log_loss END AS log_loss, CASE WHEN supported THEN brier END AS brier, CASE WHEN supported THEN roc_auc END AS roc_auc, CASE WHEN supported THEN pr_auc END AS pr_auc FROM o"""))
def slice_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six families of slices of the shots that the frozen model scores."""
    rows = feature_rows(spark, sf_dir).withColumn("pressed", F.coalesce("under_pressure", F.lit(False)).cast("int"))
    shots = rows.withColumn("p", S.sigmoid(F.round(linear_score(WEIGHTS, INTERCEPT), 6)))
    families = {k: F.col(k) for k in REFERENCE} | {k: S.band_label(F.col(c), edges) for k, (edges, c) in BANDS.items()}
    return rounded(E.slices(shots, families, "match_id"), "log_loss", "brier", "roc_auc", "pr_auc")


@query(sql_over("scored", body=f"SELECT round(avg({LL.format(p='p_other')}) - avg({LL.format(p='p')}), 9) AS log_loss, round(avg((y - p_other) * (y - p_other)) - avg((y - p) * (y - p)), 9) AS brier FROM scored"))
def calibrated_minus_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, p, q = F.col("y"), F.col("p"), F.col("p_other")
    return rounded(scored(spark, sf_dir).agg((F.avg(S.log_loss(y, q)) - F.avg(S.log_loss(y, p))).alias("log_loss"), (F.avg(S.squared_error(y, q)) - F.avg(S.squared_error(y, p))).alias("brier")), "log_loss", "brier")


@query(sql_over("scored", body="""
, a AS (SELECT cluster_id AS metric, round(avg(p), 9) AS v FROM scored WHERE cluster_id % 7 <> 0 GROUP BY 1), b AS (SELECT cluster_id AS metric, round(avg(p_other), 9) AS v FROM scored WHERE cluster_id % 5 <> 0 GROUP BY 1)
SELECT metric, a.v AS "left", b.v AS "right", round(b.v - a.v, 8) AS delta, coalesce(abs(b.v - a.v) <= 0.05, false) AS passed FROM a FULL OUTER JOIN b USING (metric)"""))
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir)
    side = lambda c, m: df.filter(F.col("cluster_id") % m != 0).groupBy(F.col("cluster_id").alias("metric")).agg(F.round(F.avg(c), 9).alias("value"))
    return rounded(E.compare_runs(side("p", 7), side("p_other", 5), tolerance=0.05), "delta", places=8)
