"""Embedding whitening from an exact, bit-sliced scatter matrix.

An entry c becomes the integer x = floor(64 c) + 1000000. Each task takes its vectors in blocks, shifts every dimension
by its least value in the block, and packs the bit planes of what is left across rows into words: bit r of word w of
plane p of dimension j is bit p of row 64 w + r. The sum of products of two dimensions is then the sum over pairs of
their planes of 2^(p + q) times the number of bits set in both, so it is exact. The shift is put back exactly, and
blocks of any width add up as Python integers; a wide entry costs planes in its own block alone. Spark adds the tasks'
sums as limbs of 30 bits (one row a pair of dimensions), and the driver, which holds d * d numbers for vectors of d
dimensions whatever their count, centres them as integers (n * sum(x y) - sum(x) * sum(y)) before the only rounding, to
doubles for eigh.

Components are numbered from 1 by falling eigenvalue; their sign makes the largest entry positive. A component whose
eigenvalue is within rounding of zero (1e-22 of the largest) has no scale to be divided by, so its whitened is null.

Edge cases: rows whose vector is null, or holds a null, NaN or infinite entry, are dropped, empty vectors too; so are,
since no covariance spans vectors of several lengths, rows of another length than most (of equally frequent lengths
the longest). Entries that a long can't hold are set to +-2^61. Repeated rows and ids, and null ids, count and are
returned as they are. One vector, or equal ones, have no variance: whitened and explained are null, identity_error is
0. No rows give no rows. deviation is null where a long can't hold it. Columns other than the two are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
#: Rows of a block of bit planes, vectors of a batch that are projected at once, and limbs of a sum.
BLOCK, SLICE, LIMBS, LIMB_BITS = 8192, 4096, 6, 30
#: Shares of the largest eigenvalue: below the first, components are refined, below the second they are nothing.
GRADED, NOTHING = 1e-6, 1e-22
_FAR = 1 << 61


def dimensions(vectors: DataFrame, vector_col: str = "embedding") -> int:
    """The length of most of the vectors that are whole; 0 if there are none."""
    whole = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    lengths = vectors.select(F.col(vector_col).cast("array<double>").alias(vector_col)).filter((F.size(vector_col) > 0) & whole).groupBy(F.size(vector_col).alias("d")).count()
    most = lengths.agg(F.max(F.struct("count", "d")).alias("m")).first().m
    return most.d if most else 0


def integers(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the rows that are kept, their entries as x - SHIFT) of a batch (id, vector of doubles)."""
    column = batch.column(1)
    at = np.flatnonzero(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == d)
    flat = column.take(pa.array(at)).flatten()
    c = flat.to_numpy(zero_copy_only=False).reshape(-1, d)  # null entries are NaN here
    whole = np.isfinite(c).all(axis=1)
    return at[whole], np.clip(np.floor(c[whole] * SCALE), -_FAR, _FAR).astype(np.int64)


def bit_planes(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, owner, power) of non-negative columns: a row of words for each bit plane, of which column, of which bit."""
    n, d = u.shape
    bits = np.array([max(1, int(x).bit_length()) for x in u.max(axis=0)])
    owner = np.repeat(np.arange(d), bits)
    power = np.concatenate([np.arange(b) for b in bits])
    words = np.zeros((len(owner), -(-n // 64)), "<u8")
    for j, at in enumerate(np.cumsum(bits) - bits):  # by dimension, so that memory is bounded by the words
        planes = np.zeros((bits[j], words.shape[1] * 64), np.uint8)
        planes[:, :n] = (u[:, j] >> np.arange(bits[j], dtype=np.uint64)[:, None]) & np.uint64(1)
        words[at : at + bits[j]] = np.packbits(planes, axis=1, bitorder="little").view("<u8")
    return words, owner, power


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of columns, upper triangle of the sums of products of columns) of integers, as exact Python integers."""
    n, d = x.shape
    least = x.min(axis=0)
    words, owner, power = bit_planes((x.astype(np.uint64) - least.astype(np.uint64)))
    starts = np.searchsorted(owner, np.arange(d))
    wide = 2 * int(power.max()) + n.bit_length() + d.bit_length() + 2 > 62
    weight = np.array([1 << int(p) for p in power], object if wide else np.int64)
    u_sums = np.add.reduceat(np.bitwise_count(words).sum(axis=1, dtype=np.int64) * weight, starts)
    products = np.zeros((d, d), object)
    for i in range(d):
        from_i = starts[i]
        row = np.zeros(len(owner) - from_i, weight.dtype)
        for a in range(from_i, starts[i + 1] if i + 1 < d else len(owner)):
            row = row + np.bitwise_count(words[a] & words[from_i:]).sum(axis=1, dtype=np.int64) * weight[from_i:] * weight[a]
        products[i, i:] = np.add.reduceat(row, starts[i:] - from_i).astype(object)
    low, sums = least.astype(object), u_sums.astype(object)
    shifted = products + np.triu(np.multiply.outer(low, sums) + np.multiply.outer(sums, low) + n * np.multiply.outer(low, low))
    return sums + n * low, shifted


def _limbs(value: int) -> list[int]:
    mask = (1 << LIMB_BITS) - 1
    return [(value >> (LIMB_BITS * k)) & mask for k in range(LIMBS - 1)] + [value >> (LIMB_BITS * (LIMBS - 1))]


def exact_sums(vectors: DataFrame, d: int, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[int, list[int], np.ndarray]:
    """(n, sums, products), exact, of x - SHIFT over all vectors that are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            x = integers(batch, d)[1]
            for at in range(0, len(x), BLOCK):
                s, p = scatter(x[at : at + BLOCK])
                n, sums, products = n + len(x[at : at + BLOCK]), sums + s, products + p
        if n:
            cells = [(-1, -1, n), *((-1, j, int(sums[j])) for j in range(d)), *((i, j, int(products[i, j])) for i in range(d) for j in range(i, d))]
            columns = zip(*((i, j, *_limbs(v)) for i, j, v in cells))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 2 + [pa.int64()] * LIMBS)], ["i", "j", *(f"l{k}" for k in range(LIMBS))])

    limbs = [f"l{k}" for k in range(LIMBS)]
    made = _read(vectors, id_col, vector_col).mapInArrow(run, "i int, j int, " + ", ".join(f"{c} long" for c in limbs))
    n, sums, products = 0, [0] * d, np.zeros((d, d), object)
    for row in made.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in limbs]).collect():  # (d + 1) (d + 2) / 2 rows at most
        value = sum(row[c] << (LIMB_BITS * k) for k, c in enumerate(limbs))
        if row.i >= 0:
            products[row.i, row.j] = products[row.j, row.i] = value
        elif row.j >= 0:
            sums[row.j] = value
        else:
            n = value
    return n, sums, products


def _read(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return vectors.filter(F.col(vector_col).isNotNull()).select(id_col, F.col(vector_col).cast("array<double>").alias("__vector"))


def centred(n: int, sums: list[int], products: np.ndarray) -> np.ndarray:
    """n * n times the covariance, exact."""
    s = np.array(sums, object)
    return n * products - np.multiply.outer(s, s)


def components(m: np.ndarray, over: int, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the k largest of the covariance m / over, each entry of which is
    one rounding of an exact fraction; eigenvalues within rounding of zero are 0.

    Rounding inside eigh is some 1e-16 of the largest eigenvalue, too much for components that are far smaller. Where
    one of those asked for is below GRADED of the largest, m is brought to the found basis exactly (its vectors as
    integers), which leaves a matrix that is nearly diagonal at every scale, and Jacobi rotations, which are precise
    for such, finish it."""
    v = np.array([[x / over for x in row] for row in m], float)
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    least = e[min(k, len(e)) - 1]
    if e[0] > 0 and least < GRADED * e[0]:
        whole = np.array([[int(x) for x in row] for row in np.rint(q * 2.0**52)], object)
        turned = (whole.T.dot(m)).dot(whole)
        e, turn = jacobi(np.array([[x / (over << 104) for x in row] for row in turned], float))
        q = q @ turn
        q /= np.linalg.norm(q, axis=0)
    e, q = e[:k].copy(), q[:, :k]
    e[e <= NOTHING * max(e[0], 0.0)] = 0.0
    return e, q * np.where(np.take_along_axis(q, np.abs(q).argmax(axis=0)[None, :], 0) < 0, -1.0, 1.0)


def jacobi(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; eigenvectors as columns) of a positive matrix by cyclic rotations, until every entry off
    the diagonal is within rounding of the geometric mean of its diagonal ones."""
    t, d = t.copy(), len(t)
    q = np.eye(d)
    for _ in range(30):
        still = True
        for i in range(d - 1):
            for j in range(i + 1, d):
                if abs(t[i, j]) <= 1e-17 * np.sqrt(abs(t[i, i]) * abs(t[j, j])) or t[i, j] == 0.0:
                    continue
                still = False
                ratio = (t[j, j] - t[i, i]) / (2 * t[i, j])
                tan = (1.0 if ratio >= 0 else -1.0) / (abs(ratio) + np.hypot(1.0, ratio))
                cos = 1 / np.hypot(1.0, tan)
                sin = tan * cos
                at_i, at_j, both = t[i, i] - tan * t[i, j], t[j, j] + tan * t[i, j], [i, j]
                turn = np.array([[cos, sin], [-sin, cos]])
                t[:, both] = t[:, both] @ turn
                t[both] = t[:, both].T
                t[i, i], t[j, j], t[i, j], t[j, i] = at_i, at_j, 0.0, 0.0
                q[:, both] = q[:, both] @ turn
        if still:
            break
    order = np.argsort(-np.diag(t), kind="stable")
    return np.diag(t)[order], q[:, order]


class _Projection:
    """What a task needs to whiten vectors: numbers that grow with the dimensions alone."""

    def __init__(self, n: int, sums: list[int], e: np.ndarray, q: np.ndarray):
        self.n, self.live = n, e > 0
        # x - S/n in two exact steps: an integer near the mean, then the rest of the mean, a fraction below 1
        self.whole = np.array([s // n for s in sums], object)
        self.rest = np.array([(s % n) / n for s in sums])
        self.sums = np.array(sums, object)
        self.q = np.where(self.live, q / np.sqrt(np.where(self.live, e, 1.0)), 0.0)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.whole.astype(np.int64)).astype(float) - self.rest) @ self.q

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n x - S)^2; in longs where no step can overflow, else in Python integers."""
        low, high = x.min(axis=0).astype(object), x.max(axis=0).astype(object)
        most = max(int(max(abs(self.n * a - s), abs(self.n * b - s))) for a, b, s in zip(low, high, self.sums))
        if most * most * x.shape[1] < 1 << 62 and self.n * int(max(np.abs(low).max(), np.abs(high).max())) < 1 << 62:
            y = x * self.n - self.sums.astype(np.int64)
            return (y * y).sum(axis=1).tolist()
        y = x.astype(object) * self.n - self.sums
        return [int(v) if v < 1 << 63 else None for v in (y * y).sum(axis=1)]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """Rows (id, component int, n long, deviation long, whitened double, explained double, identity_error double) for
    each vector that is kept and each of the first k components (fewer if it has fewer dimensions)."""
    spark = vectors.sparkSession
    kinds = dict(vectors.dtypes)
    schema = f"`{id_col}` {kinds[id_col]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    d = dimensions(vectors, vector_col)
    if not d:
        return spark.createDataFrame([], schema)
    n, sums, products = exact_sums(vectors, d, id_col, vector_col)
    m = centred(n, sums, products)
    trace = int(np.trace(m)) / (n * n)
    e, q = components(m, n * n, k)
    shared = spark.sparkContext.broadcast(_Projection(n, sums, e, q))
    error = _identity_error(vectors, d, shared, len(e), id_col, vector_col)
    explained = pa.array((e / trace).tolist() if trace > 0 else [None] * len(e), pa.float64())
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: _Projection = shared.value
        m = len(p.live)
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                at, x = integers(batch, d)
                if not len(at):
                    continue
                each, turn = np.repeat(np.arange(len(at)), m), np.tile(np.arange(m), len(at))
                whitened = pa.array(p.whiten(x).ravel(), mask=~p.live[turn])
                constant = [pa.array(np.full(len(each), n), pa.int64()), pa.array(p.deviation(x), pa.int64()).take(pa.array(each))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[each])), pa.array((turn + 1).astype(np.int32)), *constant, whitened, explained.take(pa.array(turn)), pa.array(np.full(len(each), error))], names)

    return _read(vectors, id_col, vector_col).mapInArrow(run, schema)


def _identity_error(vectors: DataFrame, d: int, shared, m: int, id_col: str, vector_col: str) -> float:
    """The largest absolute entry of the covariance of the whitened vectors, over the whole list, minus the identity.

    Tasks send their own count, mean and centred scatter (m + m * m numbers); these are joined by the rule for parts
    of a sample, two by two in Spark and then on the driver, so nothing is multiplied before it is centred."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: _Projection = shared.value
        state = None
        for batch in batches:
            x = integers(batch, d)[1]
            if len(x):
                w = p.whiten(x)
                mean = w.mean(axis=0)
                state = _joined(state, (len(w), mean, (w - mean).T @ (w - mean)))
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([state[0]], pa.int64()), pa.array([state[1].tolist()]), pa.array([state[2].ravel().tolist()])], ["n", "mean", "scatter"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for row in batch.to_pylist():
                state = _joined(state, (row["n"], np.array(row["mean"]), np.array(row["scatter"]).reshape(m, m)))
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([state[0]], pa.int64()), pa.array([state[1].tolist()]), pa.array([state[2].ravel().tolist()])], ["n", "mean", "scatter"])

    schema = "n long, mean array<double>, scatter array<double>"
    parts = _read(vectors, id_col, vector_col).mapInArrow(run, schema)
    state = None
    for row in parts.repartition(8).mapInArrow(join, schema).collect():  # 8 rows at most
        state = _joined(state, (row.n, np.array(row["mean"]), np.array(row["scatter"]).reshape(m, m)))
    live = shared.value.live
    return float(np.abs((state[2] / state[0] - np.eye(m))[np.ix_(live, live)]).max(initial=0.0))


def _joined(a: tuple | None, b: tuple) -> tuple:
    """Count, mean and centred scatter of two parts together."""
    if a is None:
        return b
    n, step = a[0] + b[0], b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)
