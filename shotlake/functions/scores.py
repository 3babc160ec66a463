"""Column functions on labels, flags and probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-15
# Left-closed bands, and the two sets of bin edges, which differ at 0.6.
DISTANCE_EDGES, ANGLE_EDGES = (10.0, 20.0, 30.0), (0.2, 0.4, 0.6)
EQUAL_WIDTH_EDGES, RAW_ANCHOR_EDGES = (0.2, 0.4, 0.6000000000000001, 0.8), (0.2, 0.4, 0.6, 0.8)


def presence(flag: Column) -> Column:
    """1 for true, 0 for false or null."""
    return F.coalesce(flag, F.lit(False)).cast("int")


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def logit(p: Column, eps: float = 1e-12) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(q / (F.lit(1.0) - q))


def platt(z: Column, slope: float, intercept: float) -> Column:
    return sigmoid(F.lit(slope) * z + F.lit(intercept))


def edge_bin(value: Column, edges: tuple[float, ...]) -> Column:
    """How many edges lie at or below a value: left-closed bins, null for null."""
    out = F.when(value.isNull(), F.lit(None).cast("int"))
    for k, e in reversed(list(enumerate(edges, 1))):
        out = out.when(value >= e, F.lit(k))
    return out.otherwise(F.lit(0))


def band_label(value: Column, edges: tuple[float, ...]) -> Column:
    names = [f"<{edges[0]:g}", *(f"[{a:g},{b:g})" for a, b in zip(edges, edges[1:])), f">={edges[-1]:g}"]
    return F.element_at(F.array(*map(F.lit, names)), edge_bin(value, edges) + 1)


def log_loss(y: Column, p: Column) -> Column:
    """Of one row: minus the log of the probability given to what happened."""
    happened = F.when(y == 1, p).otherwise(F.lit(1.0) - p)
    return -F.ln(F.greatest(F.least(happened, F.lit(1.0)), F.lit(EPS)))


def squared_error(y: Column, p: Column) -> Column:
    return (y - p) * (y - p)
