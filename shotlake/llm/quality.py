"""Quality classifier: document statistics, random Fourier features, ridge regression, isotonic calibration.

Statistics of each whole text are taken in one Arrow pass and held. Random Fourier features approximate a Gaussian
kernel over the standardised statistics; each task adds up its part of the normal equations and Spark sums the
parts by matrix row. Isotonic regression turns raw scores of labelled rows that the ridge did not see into
probabilities. Fitting takes about MAX_FIT labelled ids at most, chosen by a hash before any statistics are taken; all
rows are scored.

Edge cases: null and empty texts have all statistics at zero and are scored like any other; a null id is never
labelled; labels that disagree about an id are averaged; without labelled rows every score is 0.5 and keep_good
keeps all; no rows give no rows. Ids, languages, sources and labels are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, hold

N_FEATURES, GAMMA, RIDGE, SEED = 256, 0.08, 1e-3, 7
MAX_FIT, FIT_TASKS, SCORE_BINS = 200_000, 16, 4096
THRESHOLD = 0.7
STATS = ("log_words", "word_length", "symbols", "marks", "upper", "digits", "blanks", "other_bytes", "distinct_words", "top_word", "repeated_pairs", "distinct_lines", "words_a_line", "short_words", "stops", "bars")
_CLASSES = {
    "symbols": b"#$%&*<>@\\^_`{}~+=/", "marks": b"!?", "upper": bytes(range(65, 91)), "digits": b"0123456789", "blanks": b" \t\n\r\x0b\x0c", "other_bytes": bytes(range(128, 256)), "stops": b".,;:", "bars": b"|",
}
_TABLE = np.zeros((256, len(_CLASSES)))
for _k, _set in enumerate(_CLASSES.values()):
    _TABLE[list(_set), _k] = 1.0


def statistics(text: bytes | None) -> list[float]:
    """The STATS of one text."""
    text = text or b""
    words = text.split()
    n, size = len(words), max(1, len(text))
    share = dict(zip(_CLASSES, np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _TABLE / size))
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, n)
    got = {
        "log_words": np.log1p(n), "word_length": min(lengths.mean(), 50.0) if n else 0.0, "distinct_words": len(counts) / n ** 0.85 if n else 0.0, "top_word": max(counts.values(), default=0) / max(1, n),
        "repeated_pairs": sum(a == b for a, b in zip(words, words[1:])) / max(1, n - 1), "distinct_lines": len(set(lines)) / max(1, len(lines)), "words_a_line": np.log1p(n / max(1, len(lines))), "short_words": float((lengths <= 3).mean()) if n else 0.0,
    }
    return [float(got[s] if s in got else share[s]) for s in STATS]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, *keep, stats array<double>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [statistics(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(got, pa.list_(pa.float64()))], [id_col, *keep, "stats"])

    kinds = dict(docs.dtypes)
    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("__text"), *keep).mapInArrow(run, ", ".join([f"`{k}` {kinds[k]}" for k in (id_col, *keep)] + ["stats array<double>"]))


class Model:
    """Everything that scoring needs: some hundred kilobytes at most."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, seed: int = SEED, n: int = N_FEATURES, gamma: float = GAMMA):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.weights, self.phase = rng.normal(0, np.sqrt(2 * gamma), (len(mean), n)), rng.uniform(0, 2 * np.pi, n)
        self.ridge, self.steps = np.zeros(n + 1), (np.array([0.0]), np.array([0.5]))

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.deviation, -6, 6)
        return np.concatenate([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.weights + self.phase), np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.ridge

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), *self.steps), 0.0, 1.0)


def _matrix(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_list()) if len(series) else np.zeros((0, len(STATS)))


def fit(labelled: DataFrame) -> Model | None:
    """labelled: rows (stats, y, calibrate). Rows with calibrate set fit the isotonic steps, others the ridge."""
    used = hold(labelled.select("stats", "y", "calibrate").repartition(FIT_TASKS), "fit")
    if used.isEmpty():
        return None
    moments = used.select(*[F.col("stats")[i].alias(f"s{i}") for i in range(len(STATS))]).agg(*[f(f"s{i}") for i in range(len(STATS)) for f in (F.avg, F.stddev_pop)]).first()
    model = Model(np.array(moments[0::2], float), np.array(moments[1::2], float))

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((N_FEATURES + 1, N_FEATURES + 2))
        for pdf in frames:
            z = model.features(_matrix(pdf.stats))
            total += z.T @ np.column_stack([z, pdf.y.to_numpy(float)])
        yield pd.DataFrame({"i": range(len(total)), "v": list(total)})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf.i[:1], "v": [np.sum(pdf.v.to_list(), axis=0)]})

    def ridge_from(rows: DataFrame) -> np.ndarray:
        sums = np.array([r.v for r in sorted(rows.mapInPandas(part, "i int, v array<double>").groupBy("i").applyInPandas(add, "i int, v array<double>").collect())])
        a, b = sums[:, :-1], sums[:, -1]
        return np.linalg.solve(a + RIDGE * max(1.0, a[-1, -1]) * np.diag([1.0] * N_FEATURES + [1e-9]), b)

    model.ridge = ridge_from(used.filter("not calibrate"))

    def binned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"bin": np.clip((model.raw(_matrix(pdf.stats)) + 1) / 3 * SCORE_BINS, 0, SCORE_BINS - 1).astype(np.int64), "y": pdf.y.to_numpy(float)})

    bins = used.filter("calibrate").mapInPandas(binned, "bin long, y double").groupBy("bin").agg(F.avg("y").alias("label"), F.count("*").cast("double").alias("weight"))
    points = bins.select(((F.col("bin") + 0.5) / SCORE_BINS * 3 - 1).alias("feature"), "label", "weight")
    if not points.isEmpty():
        from pyspark.ml.regression import IsotonicRegression

        steps = IsotonicRegression(featuresCol="feature", labelCol="label", weightCol="weight").fit(points)
        model.steps = (steps.boundaries.toArray(), steps.predictions.toArray())
    else:
        model.steps = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return model


def remainder(id_col: Column) -> Column:
    """crc32 of the id as text, mod 4; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4


def training_labels(labels: DataFrame, id_col: str, label_col: str, held_out: int, max_fit: int = MAX_FIT) -> DataFrame:
    """Held rows (__id, y, calibrate) of labelled ids, those of the held-out remainder left aside; about max_fit at most."""
    usable = labels.filter(F.col(label_col).isNotNull() & (remainder(F.col(id_col)) != held_out))
    share = min(1.0, max_fit / max(1, usable.count()))
    chosen = usable.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(share * (1 << 30)))
    calibrate = remainder(F.col("__id")) == (held_out + 1) % 4
    return hold(chosen.groupBy(F.col(id_col).alias("__id")).agg(F.avg(F.col(label_col).cast("double")).alias("y")).withColumn("calibrate", calibrate), "labels")


def with_labels(rows: DataFrame, chosen: DataFrame, id_col: str) -> DataFrame:
    """rows of the chosen ids, which are few enough to be broadcast, with y and calibrate."""
    return rows.join(broadcast_if_small(chosen, 2 * MAX_FIT), rows[id_col] == chosen["__id"])


def _scores(model: Model | None, stats: np.ndarray) -> np.ndarray:
    return model.score(stats) if model is not None and len(stats) else np.full(len(stats), 0.5)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep: tuple[str, ...] = (), held_out: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (id, *keep, held_out, score, predicted) for every row of docs."""
    stats = hold(document_statistics(docs, id_col, text_col, keep), "statistics")
    chosen = training_labels(labels, id_col, label_col, held_out)
    shared = docs.sparkSession.sparkContext.broadcast(fit(with_labels(stats, chosen, id_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(_scores(shared.value, flat), pa.float64())], [*names, "score"])

    names = [id_col, *keep]
    kinds = dict(docs.dtypes)
    scored = stats.mapInArrow(run, ", ".join([f"`{k}` {kinds[k]}" for k in names] + ["score double"]))
    return scored.select(*names, F.coalesce(remainder(F.col(id_col)) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that the classifier rejects.

    Texts are not shuffled: statistics of the labelled rows alone are taken for the fit, then those of all rows while
    they stream by.
    """
    chosen = training_labels(labels, id_col, label_col, held_out)
    labelled = with_labels(docs.select(id_col, text_col), chosen, id_col)
    model = fit(document_statistics(labelled, id_col, text_col, ("y", "calibrate")))
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            stats = np.array([statistics(x) for x in texts], float).reshape(-1, len(STATS))
            yield batch.filter(pa.array(_scores(shared.value, stats) >= threshold))

    return docs.mapInArrow(run, docs.schema)
