import zlib

import numpy as np

from shotlake.llm import quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(rows[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in rows)
    assert sum(rows[k].predicted == truth[k] for k in held) / len(held) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows.values())


def test_held_out_labels_are_not_used(spark, docs):
    from pyspark.sql import functions as F

    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.remainder(F.col("doc_id")) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: round(r.score, 9) for r in quality.quality_scores(docs, x).collect()} for x in (labels, turned))
    assert a == b


def pooled(values, weights):
    """Isotonic regression by pooling adjacent violators."""
    blocks = []
    for v, w in zip(values, weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v1, w1, n1 = blocks.pop()
            v0, w0, n0 = blocks.pop()
            blocks.append([(v0 * w0 + v1 * w1) / (w0 + w1), w0 + w1, n0 + n1])
    return np.concatenate([[v] * n for v, _, n in blocks])


def test_fit_like_a_direct_solution(spark):
    """The summed normal equations against one matrix, the steps against pooled violators."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    chosen = quality.training_labels(labels, "doc_id", "quality", 2)
    rows = quality.document_statistics(quality.with_labels(docs.select("doc_id", "text"), chosen, "doc_id"), keep=("y", "calibrate"))
    model = quality.fit(rows)
    got = rows.collect()
    stats, y, cal = (np.array([r[k] for r in got]) for k in ("stats", "y", "calibrate"))
    z, t = model.features(stats[~cal]), y[~cal]
    ridge = np.linalg.solve(z.T @ z + quality.RIDGE * len(z) * np.diag([1.0] * quality.N_FEATURES + [1e-9]), z.T @ t)
    assert np.allclose(model.mean, stats.mean(axis=0)) and np.allclose(z @ model.ridge, z @ ridge, atol=1e-6)
    bins = np.clip((model.raw(stats[cal]) + 1) / 3 * quality.SCORE_BINS, 0, quality.SCORE_BINS - 1).astype(int)
    at = np.unique(bins)
    want = pooled([y[cal][bins == b].mean() for b in at], [(bins == b).sum() for b in at])
    assert np.allclose(np.interp((at + 0.5) / quality.SCORE_BINS * 3 - 1, *model.steps), want, atol=1e-9)


def test_labels_are_bounded(spark):
    labels = spark.range(50_000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    n = quality.training_labels(labels, "doc_id", "quality", 2, max_fit=1000).count()
    assert 800 < n < 1200


def test_odd_rows(spark, odd, none, odd_rows):
    labels = spark.createDataFrame([(100 + i, i % 2, 0) for i in range(20)] + [(100, 0, 1), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.quality_scores(odd, labels).count() == len(odd_rows)
    assert quality.keep_good(odd, labels).columns == odd.columns
    assert {r.score for r in quality.quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(none, labels).count() == 0
