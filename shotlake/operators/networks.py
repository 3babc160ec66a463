"""The small network of all folds fitted together: sigmoid hidden units and two outputs, as MLlib's perceptron.

MLlib fits one fold after another and computes each row's whole hidden layer for it in every step. Here all fits take their steps
together, one job a step, with MLlib's loss, start and descent (L-BFGS with a strong Wolfe search). Rows that agree
in all columns become one cell with its rows and ones for each fit, and cells are written once, dealt out by place (the
`places` columns, which take many values) and packed into blocks as bytes. A hidden unit's exponential is a product of the
place's and the level's, so that it is computed for the places and levels of a block instead of for its cells.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import delete, written
from .models import assembled, perceptron

#: Cells of a block, rows that make a file of blocks, bytes of a file's row groups, blocks that go to Python at once (so that it
#: need not wait for a whole file), and the largest exponent of which products are taken.
BLOCK, SHARE, GROUP, AT_ONCE, LARGE = 8192, 250_000, 16 << 20, 16, 300.0

Point = tuple[float, np.ndarray]


class SearchFailed(Exception):
    """No step along a direction was good enough."""


def _between(a: tuple, b: tuple) -> float:
    """The least of the cubic through two points (step, slope, value), kept off both ends."""
    a, b = (b, a) if a[0] > b[0] else (a, b)
    with np.errstate(all="ignore"):
        d1 = a[1] + b[1] - 3 * (a[2] - b[2]) / (a[0] - b[0])
        d2 = np.sqrt(d1 * d1 - a[1] * b[1])
        t = b[0] - (b[0] - a[0]) * (b[1] + d2 - d1) / (b[1] - a[1] + 2 * d2)
    low, high = a[0] + 0.1 * (b[0] - a[0]), a[0] + 0.9 * (b[0] - a[0])
    return float(low if t < low else high if t > high else t)


def wolfe(x: np.ndarray, at: Point, way: np.ndarray, t: float, most: int = 10) -> Generator[np.ndarray, Point, tuple[float, np.ndarray, Point]]:
    """(step, point, its value and gradient) that meets the strong Wolfe conditions along a way, tried from step t on: yields points to evaluate."""
    slope, value = float(at[1] @ way), at[0]
    if slope > 0:
        raise SearchFailed
    low = (0.0, slope, value)

    def good(c: tuple) -> bool:
        return abs(c[1]) <= 0.9 * abs(slope)

    for i in range(most):
        found = yield x + t * way
        c = (t, float(found[1] @ way), found[0])
        if not np.isfinite(c[2]):
            t /= 2
            continue
        if c[2] > value + 1e-4 * t * slope or (c[2] >= low[2] and i > 0):
            high = c
        elif good(c):
            return t, x + t * way, found
        elif c[1] >= 0:
            low, high = c, low
        else:
            low, t = c, t * 1.5
            continue
        for _ in range(most):
            t = _between(low, high)
            found = yield x + t * way
            c = (t, float(found[1] @ way), found[0])
            if c[2] > value + 1e-4 * t * slope or c[2] >= low[2]:
                high = c
                continue
            if good(c):
                return t, x + t * way, found
            if c[1] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        raise SearchFailed
    raise SearchFailed


def descent(x: np.ndarray, rounds: int, tolerance: float = 1e-6, memory: int = 10, window: int = 20) -> Generator[np.ndarray, Point, np.ndarray]:
    """L-BFGS from x: yields points to evaluate, is sent (value, gradient), and returns the last point. It ends after so many
    rounds, once the value has not changed against the largest of the last ones, or when the gradient is small."""
    at = yield x
    first, values = at[0], [np.inf]
    history: list[tuple[np.ndarray, np.ndarray]] = []
    failed = False
    for k in range(rounds):
        if abs(at[0] - max(values)) <= tolerance * first or np.linalg.norm(at[1]) <= max(tolerance * at[0], 1e-8):
            break
        while True:
            try:
                way, shares = at[1].copy(), []
                for s, g in history:  # the newest first
                    shares.append(float(s @ way) / float(s @ g))
                    way -= shares[-1] * g
                if history:
                    way *= float(history[0][0] @ history[0][1]) / float(history[0][1] @ history[0][1])
                for (s, g), share in zip(history[::-1], shares[::-1]):
                    way += (share - float(g @ way) / float(s @ g)) * s
                step, to, found = yield from wolfe(x, at, -way, 1.0 if k else 1.0 / float(np.linalg.norm(way)))
                if step * np.linalg.norm(at[1]) < 1e-10:
                    raise SearchFailed
                break
            except SearchFailed:
                if failed:
                    return x
                failed, history = True, []
        failed = False
        history = [(to - x, found[1] - at[1]), *history][:memory]
        x, at = to, found
        values = [*values, at[0]][-window:]
    return x


def _layers(w: np.ndarray, width: int, hidden: int) -> tuple[np.ndarray, ...]:
    """(hidden weights by unit and column, their intercepts, weights of the second output less the first, intercept) of weights as MLlib lays them out."""
    k = width * hidden
    out = w[k + hidden : k + 3 * hidden].reshape(hidden, 2)
    return w[:k].reshape(width, hidden).T, w[k : k + hidden], out[:, 1] - out[:, 0], float(w[-1] - w[-2])


def start_weights(rows: DataFrame, width: int, hidden: int) -> np.ndarray:
    """The weights that MLlib's perceptron starts from: they depend on its seed and the layers alone."""
    names = [f"x{i}" for i in range(width)]
    two = rows.sparkSession.createDataFrame([(k, *[float(k)] * width) for k in (0, 1)], "y int, " + ", ".join(f"{c} double" for c in names))
    return perceptron(width, hidden, 0).fit(assembled(two, names)).weights.toArray()


def cell_blocks(rows: DataFrame, places: list[str], levels: list[str], folds: int = 5, fold: str = "fold", label: str = "y") -> DataFrame:
    """Rows that agree in all columns as one cell with its rows and ones outside each fold, packed: a row a block, with its places,
    its levels and how many cells each has (cells lie by level), each cell's place, and the weights by fit. Raises ValueError for a
    value that is null or not finite and for labels other than 0 and 1; rows without a fold are left out."""
    names = [f"x{i}" for i in range(len(places) + len(levels))]
    weights = [f"{k}{f}" for k in ("n", "o") for f in range(folds)]
    read = rows.filter(F.col(fold).isNotNull()).select(F.col(fold).cast("int").alias("fold"), F.col(label).cast("double").alias("y"), *[F.col(c).cast("double").alias(x) for c, x in zip(places + levels, names)])
    d, cores = len(places), rows.sparkSession.sparkContext.defaultParallelism
    files = cores * -(-max(1, read.count()) // (SHARE * cores))  # a multiple of the cores, so that tasks are alike

    bad = F.count_if(~F.coalesce(F.col("y").isin(0.0, 1.0), F.lit(False)))
    outside = [F.count_if(F.col("fold") != k).alias(f"n{k}") for k in range(folds)] + [F.count_if((F.col("fold") != k) & (F.col("y") == 1)).alias(f"o{k}") for k in range(folds)]
    dealt = read.repartition(files, *names[:d]).groupBy(*names).agg(*outside, bad.alias("bad")).sortWithinPartitions(*names[:d])

    def packed(table: np.ndarray) -> pa.RecordBatch:
        x, w = table[: len(names)], table[len(names) :]
        levels_of, level = np.unique(x[d:], axis=1, return_inverse=True)
        order = np.argsort(level.ravel(), kind="stable")
        places_of, place = np.unique(x[:d], axis=1, return_inverse=True)
        w = w[:, order].astype(np.min_scalar_type(int(w.max())))
        parts = (places_of, levels_of, np.bincount(level.ravel(), minlength=levels_of.shape[1]).astype(np.int32), place.ravel()[order].astype(np.int32), w)
        return pa.RecordBatch.from_arrays([*(pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts), pa.array([w.dtype.str])], ["places", "levels", "cells", "place", "weights", "kind"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((len(names) + len(weights), 0))
        for batch in batches:
            table = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) if batch.num_rows else np.empty((len(names) + len(weights) + 1, 0))
            if not np.isfinite(table).all() or table[-1].any():
                raise ValueError("a column is null or not finite, or a label is neither 0 nor 1")
            held = np.concatenate((held, table[:-1]), axis=1)
            while held.shape[1] >= BLOCK:
                yield packed(held[:, :BLOCK])
                held = held[:, BLOCK:]
        if held.shape[1]:
            yield packed(held)

    blocks = dealt.select(*names, *weights, "bad").mapInArrow(pack, "places binary, levels binary, cells binary, place binary, weights binary, kind string")
    return written(blocks, "blocks", **{"parquet.block.size": GROUP})


def _block_sums(block: tuple, nets: list[tuple[int, np.ndarray]], d: int, width: int, hidden: int, folds: int) -> np.ndarray:
    """By net of (fit, weights): rows, loss and gradient (as the weights lie) over a block."""
    places, levels, cells, place, weights, kind = block
    places, levels = np.frombuffer(places).reshape(d, -1), np.frombuffer(levels).reshape(width - d, -1)
    cells, place = np.frombuffer(cells, np.int32), np.frombuffer(place, np.int32)
    weights = np.frombuffer(weights, np.dtype(kind)).reshape(2 * folds, -1)
    place = place.astype(np.intp)
    at = np.concatenate((places[:, place], np.repeat(levels, cells, axis=1), np.ones((1, len(place))))).T.copy()
    out = np.zeros((len(nets), 2 + hidden * (width + 1) + 2 * hidden + 2))
    a, b = np.empty((2, hidden, len(place)))  # room for all nets: what is made anew each time takes longer than the sums
    for row, (fit, w) in zip(out, nets):
        first, shift, second, last = _layers(w, width, hidden)
        by_place, by_level = first[:, :d] @ places, first[:, d:] @ levels + shift[:, None]
        if max(np.abs(by_place).max(), np.abs(by_level).max()) < LARGE:
            np.take(np.exp(-by_place), place, axis=1, out=a, mode="clip")
            a *= np.repeat(np.exp(-by_level), cells, axis=1)
        else:
            np.take(by_place, place, axis=1, out=a, mode="clip")
            a += np.repeat(by_level, cells, axis=1)
            with np.errstate(over="ignore"):
                np.exp(np.negative(a, out=a), out=a)
        a += 1
        np.reciprocal(a, out=a)
        u = second @ a + last
        n, ones = weights[fit].astype(float), weights[folds + fit].astype(float)
        if np.abs(u).max() < LARGE:
            t = np.exp(-u)
            t += 1
            left = n / t
            left -= ones
            loss = n @ np.log(t, out=t) + (n - ones) @ u
        else:
            t = np.exp(-np.abs(u))
            left = n * np.where(u >= 0, 1.0, t) / (1 + t) - ones
            loss = n @ (np.maximum(u, 0) + np.log(1 + t)) - ones @ u
        end = a @ left
        a -= np.multiply(a, a, out=b)
        a *= left
        inner = (a @ at).T * second
        row[:2] = n.sum(), loss
        row[2:] = np.concatenate((inner.ravel(), np.stack((-end, end), axis=1).ravel(), [-left.sum(), left.sum()]))
    return out


def network_fits(rows: DataFrame, columns: list[str], places: list[str], hidden: int = 8, rounds: int = 200, folds: int = 5, fold: str = "fold", label: str = "y") -> list[np.ndarray]:
    """Weights (as MLlib lays them out) of the fit that leaves each fold out. places: those of the columns that take many
    values. The driver holds the weights alone; each task sends it one row of sums. ValueError for a fit without rows."""
    d, width, levels = len(places), len(columns), [c for c in columns if c not in places]
    order = np.array([columns.index(c) for c in places + levels])

    def moved(w: np.ndarray, to: np.ndarray) -> np.ndarray:
        return np.concatenate((w[: width * hidden].reshape(width, hidden)[to].ravel(), w[width * hidden :]))

    start = moved(start_weights(rows, width, hidden), order)
    blocks = cell_blocks(rows, places, levels, folds, fold, label)

    def sums(nets: list[tuple[int, np.ndarray]]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(nets), len(start) + 2))
            for batch in batches:
                for i in range(batch.num_rows):
                    total += _block_sums(tuple(c[i].as_py() if c.type == pa.string() else c[i].as_buffer() for c in batch.columns), nets, d, width, hidden, folds)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        return sum(np.frombuffer(r.sums) for r in blocks.mapInArrow(run, "sums binary").collect()).reshape(len(nets), -1)  # a row a task

    fits = [descent(start, rounds) for _ in range(folds)]
    asked = {k: next(f) for k, f in enumerate(fits)}
    done: dict[int, np.ndarray] = {}
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark = rows.sparkSession
    before = spark.conf.get(setting)
    spark.conf.set(setting, AT_ONCE)
    try:
        while asked:
            found = sums(list(asked.items()))
            if not found[:, 0].all():
                raise ValueError("there are no rows outside a fold")
            for k, row in zip(list(asked), found):
                try:
                    asked[k] = fits[k].send((row[1] / row[0], row[2:] / row[0]))
                except StopIteration as end:
                    done[k] = end.value
                    del asked[k]
    finally:
        spark.conf.set(setting, before)
        delete(blocks)
    return [moved(done[k], np.argsort(order)) for k in range(folds)]


def network_scores(rows: DataFrame, columns: list[str], places: list[str], hidden: int = 8, rounds: int = 200, folds: int = 5, fold: str = "fold", keep: tuple[str, ...] = ("row_id", "y")) -> DataFrame:
    """(*keep, fold, p): each row scored by the network that was fitted without its fold. places: those of the columns that take
    many values."""
    nets = [_layers(w, len(columns), hidden) for w in network_fits(rows, columns, places, hidden, rounds, folds, fold)]
    held = rows.filter(F.col(fold).between(0, folds - 1)).select(*keep, fold)
    read = rows.filter(F.col(fold).between(0, folds - 1)).select(*keep, fold, *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(columns)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = len(keep) + 1
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[kept:]]) if batch.num_rows else np.empty((len(columns), 0))
            mine, p = batch.column(kept - 1).to_numpy(), np.empty(batch.num_rows)
            with np.errstate(over="ignore"):
                for k, (first, shift, second, last) in enumerate(nets):
                    at = mine == k
                    p[at] = 1 / (1 + np.exp(-(second @ (1 / (1 + np.exp(-(first @ x[:, at] + shift[:, None])))) + last)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(p)], [*keep, fold, "p"])

    return read.mapInArrow(score, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema) + ", p double")
