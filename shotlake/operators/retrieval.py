"""Pages, filters and facets of shot rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

MOST = 1000


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """One page in a stable order. The limit is brought into 1..MOST; a negative offset is an error."""
    if offset < 0:
        raise ValueError("offset must not be negative")
    return rows.orderBy(*order).offset(offset).limit(max(1, min(MOST, limit)))


#: Where a page begins: how many rows are before it, and the order's values of the last of these (None: the first page).
Token = tuple[int, tuple | None]
START: Token = (0, None)


def page_from(rows: DataFrame, order: dict[str, bool], limit: int, token: Token = START) -> tuple[DataFrame, Token | None]:
    """(page, token of the next one, or None after the last). order maps columns to whether they fall, nulls last; it
    must tell rows apart. place numbers the page's rows within all of them, from 1.

    A page is found by its token's values, not by counting off the rows before it, so the hundredth costs what the first
    does: the filter on the first column reaches the scan, and no more than limit rows are ever ordered."""
    seen, last = token
    if last is not None:
        rows = rows.filter(_after(list(order.items()), last))
    by = [F.col(c).desc_nulls_last() if falls else F.col(c).asc_nulls_last() for c, falls in order.items()]
    size = max(1, min(MOST, limit))
    held = rows.orderBy(*by).limit(size)
    found = held.collect()  # a page: MOST rows at most
    page = rows.sparkSession.createDataFrame([(*r, seen + k) for k, r in enumerate(found, 1)], StructType([*rows.schema.fields, StructField("place", LongType())])) if found else held.withColumn("place", F.lit(0).cast("long"))
    return page, (seen + len(found), tuple(found[-1][c] for c in order)) if len(found) == size else None


def _after(order: list[tuple[str, bool]], last: tuple) -> Column:
    """Whether a row comes after the values, column by column."""
    (name, falls), value, c = order[0], last[0], F.col(order[0][0])
    past = F.lit(False) if value is None else (c < value if falls else c > value) | c.isNull()
    same = c.isNull() if value is None else c == F.lit(value)
    if len(order) == 1:
        return F.coalesce(past, F.lit(False))
    found = F.coalesce(past, F.lit(False)) | (F.coalesce(same, F.lit(False)) & _after(order[1:], last[1:]))
    # told apart for the scan, which takes no alternatives over several columns
    return found if value is None or falls else found & ((c >= value) | c.isNull())


def filter_equal(rows: DataFrame, allowed: tuple[str, ...], missing: str = "None", **wanted) -> DataFrame:
    """Exact matches on any of the allowed columns; a null in the data matches the text `missing`."""
    for name, value in wanted.items():
        if name not in allowed or (isinstance(value, str) and not value.strip()):
            raise ValueError(f"{name}={value!r} is no filter")
        if value is not None:
            rows = rows.filter(F.coalesce(F.col(name).cast("string"), F.lit(missing)) == str(value))
    return rows


def facets(rows: DataFrame, columns: list[str], missing: str = "None") -> DataFrame:
    """(field, value): the distinct values of each column."""
    listed = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias("value")) for c in columns]))
    return rows.select(listed.alias("f")).select("f.*").distinct()


def plottable(rows: DataFrame) -> DataFrame:
    return rows.filter("x IS NOT NULL AND y IS NOT NULL").withColumn("is_goal", F.coalesce(F.col("outcome_name") == "Goal", F.lit(False)))
