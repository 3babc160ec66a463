import math
import random
from fractions import Fraction

import numpy as np
import pytest

from shotlake.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component int, n long, whitened string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, "x") for i, v in rows], SCHEMA)


def brute(vectors, k=32):
    """(deviations, eigenvalues, trace, integers) by fractions and numpy on exactly centred integers."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    y = [[n * r[j] - s[j] for j in range(d)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(d)] for i in range(d)])
    return [sum(c * c for c in r) for r in y], np.linalg.eigvalsh(v)[::-1][:k], float(Fraction(sum(c * c for r in y for c in r), n**3)), x


def check(rows, vectors, ids, k=32, graded=False):
    deviations, e, trace, _ = brute(vectors, k)
    assert len(rows) == len(ids) * min(k, len(vectors[0]))
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, {})[r.component] = r
    w = np.array([[by[i][c + 1].whitened for c in range(len(e))] for i in ids])
    assert np.abs(np.cov(w.T, bias=True) - np.eye(len(e))).max() < 1e-6
    assert all(r.identity_error < 1e-6 and r.n == len(ids) for r in rows)
    assert [by[i][1].deviation for i in ids] == [x if x < 1 << 63 else None for x in deviations]
    assert graded or np.allclose([by[ids[0]][c + 1].explained for c in range(len(e))], e / trace, rtol=1e-9)


def test_against_fractions(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(150, 40)) @ rng.normal(size=(40, 40)) / 20).astype(np.float32).tolist()
    for parts in (1, 5):
        check(whitening.whiten(frame(spark, enumerate(vectors)).repartition(parts)).collect(), vectors, list(range(150)))


def test_far_from_zero_and_one_wide_entry(spark):
    rng = np.random.default_rng(6)
    vectors = (rng.normal(size=(60, 3)) / 8 + 70_000).astype(np.float32).tolist()
    vectors[7][1] = -3e6
    check(whitening.whiten(frame(spark, enumerate(vectors))).collect(), vectors, list(range(60)), graded=True)  # plain eigenvalues are imprecise here


def test_jacobi_on_graded_matrices():
    scale = 10.0 ** np.arange(0, -12, -1)
    t = np.eye(12) * scale**2 + 1e-3 * np.outer(scale, scale)
    e, q = whitening.jacobi(t)
    assert np.allclose(q.T @ q, np.eye(12), atol=1e-14) and np.allclose((q / np.sqrt(e)).T @ t @ (q / np.sqrt(e)), np.eye(12), atol=1e-9)
    assert np.prod(e) == pytest.approx(np.prod(scale**2) * (1 + 12e-3), rel=1e-9)  # the determinant


def test_given_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = table.collect()
    check(whitening.whiten(table).collect(), [list(r.embedding) for r in rows], [r.vec_id for r in rows])


@pytest.mark.parametrize("wide", [3, 40, 70, 2**40])
def test_bit_slices_are_exact(wide):
    rng = random.Random(wide)
    x = np.array([[rng.randint(-wide, wide) for _ in range(5)] for _ in range(131)], np.int64)
    sums, products = whitening.scatter(x)
    exact = x.astype(object)
    assert list(sums) == list(exact.sum(axis=0))
    assert (np.triu(products) == np.triu(exact.T @ exact)).all()


def test_limbs_hold_large_and_negative_sums():
    for v in (0, 1, -1, 2**125, -(2**125), 12345678901234567890):
        assert sum(x << (whitening.LIMB_BITS * k) for k, x in enumerate(whitening._limbs(v))) == v


def test_odd_rows(spark):
    good = [[0.1 * i, 0.3 * (i % 3), -0.2 * i * i] for i in range(8)]
    bad = [(100, None), (101, [0.1, None, 0.2]), (102, [float("nan"), 0.0, 0.0]), (103, [0.0, float("inf"), 0.0]), (104, [1.0, 2.0]), (105, []), (106, [-float("inf")] * 3)]
    rows = whitening.whiten(frame(spark, [*enumerate(good), *bad])).collect()
    check(rows, good, list(range(8)))
    repeated = whitening.whiten(frame(spark, [(None, v) for v in good] + [(1, v) for v in good])).collect()
    assert len(repeated) == 16 * 3 and sum(r.vec_id is None for r in repeated) == 24 and {r.n for r in repeated} == {16}


def test_no_variance_and_no_rows(spark):
    for rows in ([(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])]):
        found = whitening.whiten(frame(spark, rows)).collect()
        assert len(found) == 2 * len(rows) and {(r.deviation, r.whitened, r.explained, r.identity_error) for r in found} == {(0, None, None, 0.0)}
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None), (2, [float("nan")])])).collect() == []
    flat = whitening.whiten(frame(spark, enumerate([[1.0, 5.0], [2.0, 5.0], [4.0, 5.0]]))).collect()
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True)} and all(r.identity_error < 1e-9 for r in flat)


def test_entries_beyond_a_long(spark):
    found = whitening.whiten(frame(spark, enumerate([[3e38, 1.0], [-3e38, 2.0], [0.0, 4.0]]))).collect()
    assert len(found) == 6 and all(r.deviation is None for r in found if r.vec_id < 2)
