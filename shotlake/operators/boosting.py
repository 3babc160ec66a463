"""Histogram boosting of many fits at once: gradient boosted trees for a binary label, grown leaf by leaf.

Columns are binned once, and rows that agree in all bins become one cell with its count and its ones by fold, so that
work follows the cells, which bins bound, not the rows. The fits are dealt into groups; a group is one barrier stage,
whose tasks hold a share of the cells each, with the scores of the group's fits, and take all rounds together: they add
up gradients, second derivatives and counts of the leaves asked for by bin, give these sums to each other,
and all choose the same splits from them. So no round is a job of its own, nothing of a cell leaves its
task before the end, and each fit goes on as soon as its own leaves are known. Groups run side by side where there
are cores. The driver sees neither cells nor sums.

Trees grow best first: the leaf of largest gain is split next, until a tree has its leaves. As a leaf's best split does
not depend on other leaves, sums are taken for the leaves below several splits at once that may still be made. Of two
leaves below a split only the smaller one's cells are read, the other's sums are what remains of those above. Columns of
few bins are added up by the patterns that they make together.

A leaf's value is -step * G / (H + PENALTY); a split must gain more than nothing, leave at least `least` rows and a second
derivative of LEAST_CURVE on both sides; equal gains go to the smaller column, then bin, then the older leaf.
"""

from __future__ import annotations

import base64
import os
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import delete, delete_folder, local_folder, shared_folder, written

BINS, PENALTY, LEAST_CURVE = 255, 1.0, 1e-3
#: Bins of a narrow column at most (two bits' worth: a flag has three, the last one empty), and narrow columns of a pattern.
NARROW, PATTERN = 4, 16
#: Cells of a task (more if there aren't as many cores), and rows of a batch of scores.
SHARE, BATCH = 400_000, 1 << 16


@dataclass(frozen=True)
class Point:
    """A point of the grid: step size, leaves of a tree, and least rows of a leaf."""

    step: float
    leaves: int
    least: int


GRID = [Point(step, leaves, least) for step in (0.03, 0.06, 0.1) for leaves in (7, 15) for least in (20, 60)]


@dataclass
class Node:
    """A leaf or an inner node: sums over its rows, its best split once known, and its children once asked for."""

    sums: tuple[float, float, float]
    split: tuple | None = None  # (gain, column, bin, left sums)
    known: bool = False
    children: tuple[int, int] | None = None


@dataclass
class Tree:
    nodes: list[Node] = field(default_factory=list)

    def grow(self, point: Point) -> tuple[list[int], list[int]]:
        """(leaves of the tree as far as it is known, nodes whose best split must be found before it can go on): the
        tree is done when nothing is asked for."""
        leaves, left = [0], point.leaves - 1
        while left:
            able = sorted((k for k in leaves if self._splits(k, point)), key=lambda k: (-self.nodes[k].split[0] if self.nodes[k].known else -np.inf, k))
            if not able:
                return leaves, []
            unknown = [k for k in able if not self.nodes[k].known]
            best = able[0]
            if unknown or self.nodes[best].children is None:
                # what may still be split: ask for the leaves below, and for those that are not known themselves
                asked = list(unknown)
                for k in [k for k in able if self.nodes[k].known][: (left + 1) // 2]:
                    asked += [c for c in self._children(k) if not self.nodes[c].known and self._splits(c, point)]
                if asked:
                    return leaves, asked
            leaves.remove(best)
            leaves += self._children(best)
            left -= 1
        return leaves, []

    def _splits(self, k: int, point: Point) -> bool:
        """Whether a node can be split, as far as is known."""
        node = self.nodes[k]
        return node.split is not None if node.known else node.sums[2] >= 2 * point.least and node.sums[1] >= 2 * LEAST_CURVE

    def _children(self, k: int) -> tuple[int, int]:
        node = self.nodes[k]
        if node.children is None:
            left = node.split[3]
            node.children = (len(self.nodes), len(self.nodes) + 1)
            self.nodes += [Node(left), Node(tuple(a - b for a, b in zip(node.sums, left)))]
        return node.children


def bin_edges(rows: DataFrame, columns: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Of each column, ascending values: a value's bin is the number of edges below it. They are quantiles of the column
    (approximate, of 1 in 10,000), so common values have bins of their own."""
    shares = [float(k) / bins for k in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(f"e{i}") for i, c in enumerate(columns)]).first()
    return [np.unique(np.array(e or [], float)) for e in found]


def cells(rows: DataFrame, columns: list[str], edges: list[np.ndarray], fold: str = "fold", label: str = "y") -> DataFrame:
    """(fold, b0, b1, ..., n, ones): rows that agree in fold and all bins. A null value is in the first bin; rows without a
    fold or label are left out."""
    names = [f"b{i}" for i in range(len(columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.searchsorted(e, np.nan_to_num(batch.column(2 + i).to_numpy(zero_copy_only=False), nan=-np.inf), side="left").astype(np.int32) for i, e in enumerate(edges)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, made)], ["fold", "y", *names])

    read = rows.filter(F.col(fold).isNotNull() & F.col(label).isNotNull()).select(F.col(fold).cast("int").alias("fold"), F.col(label).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    binned = read.mapInArrow(run, "fold int, y double, " + ", ".join(f"{b} int" for b in names))
    return binned.groupBy("fold", *names).agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("ones"))


class _Cells:
    """A task's share of the cells: wide columns' bins, patterns of the narrow ones, counts and ones by fold."""

    def __init__(self, batches: Iterator[pa.RecordBatch], sizes: list[int], folds: int):
        held = [b for b in batches if b.num_rows]
        column = lambda i, kind: np.concatenate([b.column(i).to_numpy() for b in held]).astype(kind) if held else np.zeros(0, kind)
        self.sizes, self.starts = sizes, np.cumsum([0, *sizes])
        self.bins = [column(j, np.uint8 if s <= 256 else np.int32) for j, s in enumerate(sizes)]
        self.keys = {j: self.bins[j].astype(np.int64) for j, s in enumerate(sizes) if s > NARROW}  # as bincount reads them
        self.n, self.ones = ([column(len(sizes) + kind * (folds + 1) + k, float) for k in range(folds + 1)] for kind in (0, 1))  # last: of all folds
        few = [j for j, s in enumerate(sizes) if s <= NARROW]
        self.patterns = []
        for start in range(0, len(few), PATTERN):
            these = few[start : start + PATTERN]
            found, code = np.unique(sum(self.bins[j].astype(np.int64) << 2 * i for i, j in enumerate(these)), return_inverse=True)
            of = np.concatenate([(found[:, None] >> 2 * i & 3) == np.arange(sizes[j]) for i, j in enumerate(these)], axis=1)
            self.patterns.append((np.concatenate([np.arange(self.starts[j], self.starts[j + 1]) for j in these]), code, of.astype(float)))

    def sums(self, mine: np.ndarray | slice, kinds: list[np.ndarray]) -> np.ndarray:
        """Sums by kind and bin of all columns over some of the cells."""
        out = np.zeros((len(kinds), self.starts[-1]))
        kinds = [kind[mine] for kind in kinds]
        for j, keys in self.keys.items():
            key = keys[mine]
            for s, kind in enumerate(kinds):
                out[s, self.starts[j] : self.starts[j + 1]] = np.bincount(key, kind, self.sizes[j])
        for spots, code, of in self.patterns:
            key = code[mine]
            for s, kind in enumerate(kinds):
                out[s, spots] = np.bincount(key, kind, len(of)) @ of
        return out


class _Fit:
    """A fit as a task grows it: scores of the task's cells, the tree of this round, which of the cells its nodes hold, and
    the nodes' sums over all tasks."""

    def __init__(self, cells: _Cells, point: Point, fold: int, base: float, rounds: int):
        self.cells, self.point, self.fold, self.left = cells, point, fold, rounds
        self.n, self.ones = cells.n[-1] - cells.n[fold], cells.ones[-1] - cells.ones[fold]
        self.scores = np.full(len(self.n), base)
        self.counts: np.ndarray | None = None  # of all rows by bin, as in every round
        self._begin()

    def _begin(self) -> None:
        p = 1 / (1 + np.exp(-self.scores))
        self.kinds = [self.n * p - self.ones, self.n * p * (1 - p), self.n]
        self.tree = Tree([Node((0.0, np.inf, np.inf))])
        self.held: dict[int, np.ndarray | slice] = {0: slice(None)}
        self.parent: dict[int, int] = {}
        self.totals: dict[int, np.ndarray] = {}

    def ask(self) -> list[int]:
        """Nodes whose sums the fit needs next, the smaller one of each pair, rounds that are done being finished first."""
        while self.left:
            leaves, asked = self.tree.grow(self.point)
            for k, node in enumerate(self.tree.nodes):
                for child in node.children or ():
                    self.parent[child] = k
            if asked:
                pairs = sorted({self.parent.get(k, -1) for k in asked})
                return [0 if k < 0 else min(self.tree.nodes[k].children, key=lambda c: (self.tree.nodes[c].sums[2], c)) for k in pairs]
            for k in leaves:
                node = self.tree.nodes[k]
                self._add(k, -self.point.step * node.sums[0] / (node.sums[1] + PENALTY))
            self.left -= 1
            self._begin()
        return []

    def _of(self, k: int) -> np.ndarray | slice:
        """The cells of a node that is not divided yet."""
        if k not in self.held:
            above = self.parent[k]
            _, column, at, _ = self.tree.nodes[above].split
            mine, (low, high) = self._of(above), self.tree.nodes[above].children
            goes = self.cells.bins[column][mine] <= at
            self.held[low], self.held[high] = (np.flatnonzero(goes), np.flatnonzero(~goes)) if isinstance(mine, slice) else (mine.compress(goes), mine.compress(~goes))
            del self.held[above]
        return self.held[k]

    def _add(self, k: int, value: float) -> None:
        children = self.tree.nodes[k].children
        if children and k not in self.held and self.parent.get(k, -1) not in self.held:  # divided for a split that was not made
            for c in children:
                self._add(c, value)
        else:
            self.scores[self._of(k)] += value

    def sums(self, k: int) -> np.ndarray:
        """A node's sums over the task's cells."""
        mine = self._of(k)
        if k:
            return self.cells.sums(mine, self.kinds)
        if self.counts is None:
            self.counts = self.cells.sums(mine, self.kinds[2:])
        return np.concatenate((self.cells.sums(mine, self.kinds[:2]), self.counts))

    def tell(self, k: int, found: np.ndarray) -> None:
        """A node's sums over all tasks, and with them its pair's."""
        nodes, sizes = self.tree.nodes, self.cells.sizes
        if k == 0:
            nodes[0].sums = tuple(float(v) for v in found[:, : sizes[0]].sum(axis=1))
            both = [(0, found)]
        else:
            low, high = nodes[self.parent[k]].children
            both = [(k, found), (high if k == low else low, self.totals.pop(self.parent[k]) - found)]
        for c, sums in both:
            node = nodes[c]
            able = k == 0 or node.sums[2] >= 2 * self.point.least and node.sums[1] >= 2 * LEAST_CURVE
            node.known, node.split = True, best_split(sums, sizes, self.point.least) if able else None
            if node.split is not None:
                self.totals[c] = sums


class _Exchange:
    """Sums over all tasks of a barrier stage, added up in the same order by each. Where the shared folder is a path of the
    executors' own file system each task leaves its sums there, in a file that appears whole and goes once all have read
    it; elsewhere they go through allGather, which takes about a second each time as Spark looks for answers once a second."""

    def __init__(self, folder: str | None):
        self.folder, self.turn, self.task = folder, 0, BarrierTaskContext.get()
        self.attempts = self.task.allGather(str(self.task.taskAttemptId()))  # another try of the stage has other ones

    def _name(self, turn: int, rank: int) -> str:
        return f"{self.folder}/{self.attempts[rank]}-{turn}"

    def __call__(self, sums: np.ndarray) -> np.ndarray:
        if self.folder is None:
            told = [base64.b64decode(t) for t in self.task.allGather(base64.b64encode(sums.tobytes()).decode())]
        else:
            mine = self._name(self.turn, self.task.partitionId())
            with open(mine + ".part", "wb") as f:
                f.write(sums.tobytes())
            os.rename(mine + ".part", mine)
            told = [self._read(self._name(self.turn, rank)) for rank in range(len(self.attempts))]
            if self.turn:  # who left sums for this turn has read those before
                os.remove(self._name(self.turn - 1, self.task.partitionId()))
            self.turn += 1
        return np.sum([np.frombuffer(t) for t in told], axis=0).reshape(sums.shape)

    @staticmethod
    def _read(name: str) -> bytes:
        while True:  # Spark ends the other tasks of the stage if one fails
            try:
                with open(name, "rb") as f:
                    return f.read()
            except FileNotFoundError:
                time.sleep(0.001)


@cache
def _layout(sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(where each column's bins begin, column of each bin)."""
    return np.cumsum([0, *sizes]), np.repeat(np.arange(len(sizes)), sizes)


def best_split(sums: np.ndarray, sizes: list[int], least: int) -> tuple | None:
    """(gain, column, bin, left sums) of the best split of a leaf with these sums by bin, or None."""
    starts, column = _layout(tuple(sizes))
    g, h, n = sums[:, : sizes[0]].sum(axis=1)
    left = np.cumsum(sums, axis=1)
    before = np.concatenate((np.zeros((3, 1)), left[:, starts[1:-1] - 1]), axis=1)
    left = left - before[:, column]
    gl, hl, nl = left
    gain = gl**2 / (hl + PENALTY) + (g - gl) ** 2 / (np.maximum(h - hl, 0.0) + PENALTY) - g**2 / (h + PENALTY)
    able = (nl >= least - 0.5) & (n - nl >= least - 0.5) & (hl >= LEAST_CURVE) & (h - hl >= LEAST_CURVE)
    able[starts[1:] - 1] = False  # a split needs a bin on its right
    if not able.any() or (most := gain[able].max()) <= 1e-9:
        return None
    # tasks' sums differ in their last digits, which must not decide between equal gains
    k = int(np.flatnonzero(able & (gain >= most * (1 - 1e-9)))[0])
    return float(gain[k]), int(column[k]), int(k - starts[column[k]]), tuple(float(v) for v in left[:, k])


def boosted_scores(rows: DataFrame, columns: list[str], points: list[Point] | None = None, folds: int = 5, rounds: int = 200, fold: str = "fold", label: str = "y") -> DataFrame:
    """(step, leaves, least, fold, y, p, weight): each cell's score by the fits that left its fold out, a row for its ones
    and one for its zeros, weighted with their number. ValueError if a fit would have one label alone."""
    points = GRID if points is None else points
    fits = [(point, k) for point in points for k in range(folds)]
    edges = bin_edges(rows, columns)
    sizes = [len(e) + 1 for e in edges]
    spark = rows.sparkSession
    names = [f"b{i}" for i in range(len(columns))]
    of_fold = lambda c, k: F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0.0)).alias(f"{c}{k}")
    by_fold = [x for c in ("n", "ones") for x in (*[of_fold(c, k) for k in range(folds)], F.sum(c).alias(f"{c}_all"))]
    start = written(cells(rows, columns, edges, fold, label).groupBy(*names).agg(*by_fold), "cells")
    counted = [c for c in start.columns if c not in names]
    whole = start.agg(F.count("*").alias("cells"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in counted]).first()
    base = []
    for _, k in fits:
        n, ones = (whole[f"{c}_all"] - whole[f"{c}{k}"] for c in ("n", "ones"))
        if not 0 < ones < n:
            raise ValueError(f"both labels must be among the rows of other folds than {k}")
        base.append(float(np.log(ones / (n - ones))))
    cores = spark.sparkContext.defaultParallelism
    parts = next((k for k in range(max(2, -(-whole.cells // SHARE)), cores) if cores % k == 0), cores)  # so that no core is left over
    # fits of many leaves and of few are dealt out alike
    order = sorted(range(len(fits)), key=lambda f: -fits[f][0].leaves)
    groups = [order[g :: max(cores // parts, 1)] for g in range(min(max(cores // parts, 1), len(fits)))]
    path, told_at = (f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}" for kind in ("scores", "told"))
    local = local_folder(spark, told_at)

    def run(group: list[int]) -> None:
        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = _Cells(batches, sizes, folds)
            growing, over_all = [_Fit(held, *fits[f], base[f], rounds) for f in group], _Exchange(local)
            while any(asked := [fit.ask() for fit in growing]):
                # every task asks for the same nodes, as all know the same sums
                told = iter(over_all(np.stack([fit.sums(k) for fit, need in zip(growing, asked) for k in need])))
                for fit, need in zip(growing, asked):
                    for k in need:
                        fit.tell(k, next(told))
            for f, fit in zip(group, growing):
                own = np.flatnonzero(held.n[fit.fold])
                for some in np.split(own, range(BATCH, len(own), BATCH)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), f, np.int32)), *(pa.array(x[some]) for x in (held.n[fit.fold], held.ones[fit.fold], fit.scores))], ["fit", "n", "ones", "score"])

        scored = start.repartition(parts).mapInArrow(train, "fit int, n double, ones double, score double", barrier=True)
        scored.write.parquet(f"{path}/group={group[0]}")

    try:
        with ThreadPoolExecutor(len(groups)) as pool:
            list(pool.map(inheritable_thread_target(spark)(run), groups))
    finally:
        delete_folder(spark, told_at)
    delete(start)

    scored = spark.read.schema("fit int, n double, ones double, score double").parquet(path)
    which = F.array(*[F.struct(F.lit(p.step).alias("step"), F.lit(p.leaves).alias("leaves"), F.lit(p.least).alias("least"), F.lit(k).alias("fold")) for p, k in fits])
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("score")))
    sides = F.explode(F.array(F.struct(F.lit(1).alias("y"), F.col("ones").alias("weight")), F.struct(F.lit(0).alias("y"), (F.col("n") - F.col("ones")).alias("weight")))).alias("side")
    return scored.select(F.element_at(which, F.col("fit") + 1).alias("at"), p.alias("p"), sides).select("at.*", "side.y", "p", "side.weight").filter("weight > 0")
