"""Model fits by MLlib and by Newton steps for many fits at once, out-of-fold scores, and frozen scoring as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import log_loss, sigmoid, squared_error


def assembled(rows: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(rows)


def logistic(c: float | None, n: int, label: str = "y") -> LogisticRegression:
    """L2 logistic regression; C is the inverse penalty of the summed loss, None for no penalty."""
    return LogisticRegression(featuresCol="features", labelCol=label, regParam=0.0 if c is None else 1.0 / (c * max(1, n)), elasticNetParam=0.0, standardization=False, tol=1e-10, maxIter=200)


def perceptron(width: int, hidden: int = 8, rounds: int = 200, label: str = "y") -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(featuresCol="features", labelCol=label, layers=[width, hidden, 2], blockSize=128, seed=0, maxIter=rounds)


def out_of_fold(rows: DataFrame, estimator_for, fold: str = "fold", folds: int = 5, keep: tuple[str, ...] = ("row_id", "y")) -> DataFrame:
    """Each row scored by a model that was fitted on the other folds: `folds` distributed fits."""
    out = None
    for k in range(folds):
        train, test = rows.filter(F.col(fold) != k), rows.filter(F.col(fold) == k)
        model = estimator_for(train).fit(train)
        part = model.transform(test).select(*keep, fold, vector_to_array("probability")[1].alias("p"))
        out = part if out is None else out.unionByName(part)
    return out


#: A fit by Newton's method: the fold that it leaves out (None: none) and C (None: no penalty).
Fit = tuple[int | None, float | None]


def newton_fits(rows: DataFrame, columns: list[str], fits: list[Fit], fold: str | None = "fold", label: str = "y", tolerance: float = 1e-9, most: int = 60) -> dict[Fit, np.ndarray]:
    """Weights (those of the columns, then the intercept, which is never penalised) of every logistic fit, by Newton's
    method with one job a step for all of them.

    Each task adds up loss, gradient and second derivatives of all fits over its rows; Spark sums these by (fit, cell),
    and the driver solves one small system a fit. A step that makes a fit's loss larger is halved. Raises ValueError
    for a null or infinite value, and for a fit that hasn't converged (as where classes are separable and nothing is
    penalised)."""
    d = len(columns) + 1
    read = rows.select((F.lit(-1) if fold is None else F.coalesce(F.col(fold).cast("int"), F.lit(-1))).alias("fold"), F.col(label).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    at = np.triu_indices(d)

    def sums(weights: np.ndarray, folds: list[int | None]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(folds), 1 + d + len(at[0])))
            for batch in batches:
                held, y, *x = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                x = np.column_stack([*x, np.ones(len(y))])
                for k, (w, left_out) in enumerate(zip(weights, folds)):
                    mine, own = (x, y) if left_out is None else (x[held != left_out], y[held != left_out])
                    z = mine @ w
                    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                    total[k] += np.concatenate(([(np.logaddexp(0, z) - own * z).sum()], mine.T @ (p - own), (mine.T @ (mine * (p * (1 - p))[:, None]))[at]))
            n = total.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(folds)), n).astype(np.int32)), pa.array(np.tile(np.arange(n), len(folds)).astype(np.int32)), pa.array(total.ravel())], ["fit", "cell", "value"])

        out = np.zeros((len(folds), 1 + d + len(at[0])))
        for r in read.mapInArrow(run, "fit int, cell int, value double").groupBy("fit", "cell").agg(F.sum("value").alias("value")).collect():  # fits times about d * d / 2
            out[r.fit, r.cell] = r.value
        return out

    w = np.zeros((len(fits), d))
    ridge = np.array([[0.0 if c is None else 1.0 / c] * (d - 1) + [0.0] for _, c in fits])
    going, before, last = np.ones(len(fits), bool), np.full(len(fits), np.inf), w.copy()
    for _ in range(most):
        live = np.flatnonzero(going)
        found = sums(w[live], [fits[k][0] for k in live])
        if not np.isfinite(found).all():
            raise ValueError("a feature or label is null or not finite")
        for k, row in zip(live, found):
            loss = row[0] + (ridge[k] * w[k] ** 2).sum() / 2
            if loss > before[k] + 1e-9 * abs(before[k]):
                w[k] = (w[k] + last[k]) / 2
                continue
            half = np.zeros((d, d))
            half[at] = row[1 + d :]
            curve = half + np.triu(half, 1).T + np.diag(ridge[k])
            step = np.linalg.lstsq(curve, row[1 : 1 + d] + ridge[k] * w[k], rcond=None)[0]
            last[k], before[k] = w[k].copy(), loss
            w[k] = w[k] - step
            going[k] = np.abs(step).max() > tolerance * max(1.0, np.abs(w[k]).max())
        if not going.any():
            return {f: w[k] for k, f in enumerate(fits)}
    raise ValueError("not converged: " + ", ".join(str(fits[k]) for k in np.flatnonzero(going)))


def fold_fits(rows: DataFrame, columns: list[str], cs: list[float], folds: int = 5, **options) -> DataFrame:
    """(c, fold, weights): every fold left out for every C, fitted together."""
    fits = newton_fits(rows, columns, [(k, c) for c in cs for k in range(folds)], **options)
    return rows.sparkSession.createDataFrame([(c, k, [float(x) for x in w]) for (k, c), w in fits.items()], "c double, fold int, weights array<double>")


def out_of_fold_scores(rows: DataFrame, columns: list[str], fits: DataFrame, keep: tuple[str, ...] = ("row_id", "y")) -> DataFrame:
    """(*keep, fold, c, p): each row scored by the fits that left its fold out; fits has a row for each, so is broadcast."""
    x = F.array(*[F.col(c).cast("double") for c in columns], F.lit(1.0))
    joined = rows.select(*keep, "fold", x.alias("__x")).join(F.broadcast(fits), "fold")
    score = F.aggregate(F.zip_with("__x", "weights", lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
    return joined.select(*keep, "fold", "c", sigmoid(score).alias("p"))


def constant_out_of_fold(rows: DataFrame, fold: str = "fold", y: str = "y") -> DataFrame:
    """Each row's prediction is the rate of the other folds: totals minus the fold's own."""
    per = rows.groupBy(fold).agg(F.sum(F.col(y).cast("double")).alias("__y"), F.count("*").cast("double").alias("__n"))
    total = per.agg(F.sum("__y").alias("__ay"), F.sum("__n").alias("__an")).withColumn("__k", F.lit(1))
    rates = per.withColumn("__k", F.lit(1)).join(total, "__k").select(fold, ((F.col("__ay") - F.col("__y")) / F.nullif(F.col("__an") - F.col("__n"), F.lit(0.0))).alias("p"))
    return rows.join(F.broadcast(rates), fold)


def grid_best(scores: DataFrame, parameters: list[str], places: int | None = None, weight: Column | None = None) -> DataFrame:
    """The grid point of least (mean fold log loss, mean fold Brier, parameters in order); scores: (parameters, fold, y, p),
    and how many rows each stands for. places rounds the means, so that the order in which tasks add up can't decide a
    tie."""
    w = F.lit(1.0) if weight is None else weight
    mean_of = lambda c: F.sum(w * c) / F.sum(w)
    folds = scores.groupBy(*parameters, "fold").agg(mean_of(log_loss(F.col("y"), F.col("p"))).alias("ll"), mean_of(squared_error(F.col("y"), F.col("p"))).alias("b"))
    mean = lambda c: F.avg(c) if places is None else F.round(F.avg(c), places)
    means = folds.groupBy(*parameters).agg(mean("ll").alias("log_loss"), mean("b").alias("brier"))
    return means.agg(F.min(F.struct("log_loss", "brier", *parameters)).alias("best")).select("best.*")


def coefficient_table(spark: SparkSession, model, columns: list[str]) -> DataFrame:
    rows = [("intercept", float(model.intercept)), *zip(columns, map(float, model.coefficients))]
    return spark.createDataFrame(rows, "name string, coefficient double").withColumn("odds_ratio", F.exp("coefficient"))


def linear_score(weights: dict[str, float], intercept: float) -> Column:
    """A frozen model's linear score as one expression; nothing is fitted again."""
    out = F.lit(float(intercept))
    for name, w in weights.items():
        out = out + F.col(name) * F.lit(float(w))
    return out


def fit_platt(rows: DataFrame, z: str = "z", y: str = "y") -> tuple[float, float]:
    """(slope, intercept) of an unpenalised one-dimensional logistic fit."""
    slope, intercept = newton_fits(rows, [z], [(None, None)], None, y)[None, None]
    return float(slope), float(intercept)


def batch_score(rows: DataFrame, weights: dict[str, float], intercept: float, slope: float, shift: float, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with linear score and calibrated probability, rows that may not be scored)."""
    good = rows.filter(F.coalesce(valid, F.lit(False))).withColumn("z", linear_score(weights, intercept))
    return good.withColumn("probability", sigmoid(F.lit(slope) * F.col("z") + F.lit(shift))), rows.filter(~F.coalesce(valid, F.lit(False)))
