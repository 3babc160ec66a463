"""Tables that keep batches: parts in folders, and a manifest whose newest row of a succeeded run names what counts.

A batch merges as in operators.merge: staged rows whose key is new are added, equal ones stay, a changed row, a repeated
key or a stored row of the scope that the batch lacks refuses the whole batch. New rows of all its tables go to folders
that nothing names yet; one manifest row, written last, is the commit point. A batch that fails leaves the version
before it as it was, and one that is merged again adds nothing. Folders that no row names can be removed at any time.

Parts are bucketed and sorted by their table's key, all into as many buckets, so that checks and merges join stored
rows without shuffling them: only a staged batch is dealt out, once. One writer at a time is assumed; a second one that
began from the same version is refused at its commit, as the place of its manifest row is taken.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .counting import union_all
from .merge import changed_rows, current_runs, duplicate_keys, fingerprint

MANIFEST = "seq long, run_id string, status string, started_at timestamp, finished_at timestamp, error string, buckets int, tables array<struct<name: string, keys: array<string>, parts: array<string>, source: long, inserted: long, unchanged: long, final: long>>"


class Refused(ValueError):
    """A batch that may not be merged."""


@dataclass(frozen=True)
class Batch:
    """Staged rows of a table: its key, the columns that may not change, and optionally a test of which stored rows (a
    DataFrame to those in the batch's scope) must be among the staged ones."""

    rows: DataFrame
    keys: tuple[str, ...]
    compare: tuple[str, ...] = ()
    scope: Callable[[DataFrame], DataFrame] | None = None


def bucketed(df: DataFrame, keys: list[str], buckets: int, path: str) -> DataFrame:
    """df written to a folder in buckets of its keys, and read from there with them: joins and groups by the same keys
    need no shuffle."""
    df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(_name(path))
    return df.sparkSession.table(_name(path))


def _name(path: str) -> str:
    return "part_" + hashlib.sha256(path.encode()).hexdigest()[:32]


def open_bucketed(spark: SparkSession, path: str, keys: list[str], buckets: int) -> DataFrame:
    """A part as its buckets; a session that did not write it learns of it first."""
    if not spark.catalog.tableExists(_name(path)):
        columns = ", ".join(f"`{c}` {t}" for c, t in spark.read.parquet(path).dtypes)
        by = ", ".join(f"`{k}`" for k in keys)
        spark.sql(f"CREATE TABLE {_name(path)} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(_name(path))


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, folder: str, buckets: int | None = None) -> Store:
        """An empty store; a folder that holds one already is an error."""
        store = cls(spark, folder)
        store._append("created", "succeeded", 0, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), [])
        return store

    def manifest(self) -> DataFrame:
        """All rows, in the order of seq: a run has one for each of its states."""
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest/row=*")

    def runs(self) -> DataFrame:
        return current_runs(self.manifest())

    def _last(self):
        """(the number of the newest row, the newest row of a succeeded run): a few values."""
        row = self.manifest().agg(F.max("seq").alias("seq"), F.max_by(F.struct("seq", "buckets", "tables"), F.when(F.col("status") == "succeeded", F.col("seq"))).alias("version")).first()
        return row.seq, row.version

    def _append(self, run: str, status: str, seq: int, buckets: int, tables: list, error: str | None = None) -> None:
        now = F.current_timestamp()
        row = self.spark.createDataFrame([(seq, run, status, None, None, error, buckets, tables)], MANIFEST)
        row = row.withColumns({"started_at": now, "finished_at": F.when(F.col("status") != "running", now)})
        row.coalesce(1).write.mode("errorifexists").parquet(f"{self.folder}/manifest/row={seq:09d}")

    def names(self) -> list[str]:
        return sorted(t.name for t in self._last()[1].tables)

    def parts(self, name: str) -> list[DataFrame]:
        """The bucketed parts of a table's committed version."""
        version = self._last()[1]
        return [open_bucketed(self.spark, p, list(t.keys), version.buckets) for t in version.tables if t.name == name for p in t.parts]

    def read(self, name: str) -> DataFrame:
        """A table as of the last batch that succeeded."""
        return union_all(self.parts(name))

    def merge(self, batches: dict[str, Batch], run: str | None = None) -> DataFrame:
        """Merge a batch of all its tables or none: rows (name, source, inserted, unchanged, final). Raises Refused, or
        what else failed, after noting the run as failed."""
        run = run or uuid.uuid4().hex
        seq, version = self._last()
        for left in self.runs().filter("status = 'running'").collect():  # by a writer that is gone: one at most
            seq += 1
            self._append(left.run_id, "interrupted", seq, version.buckets, [])
        self._append(run, "running", seq + 1, version.buckets, [])
        known = {t.name: t for t in version.tables}
        try:
            merged = {name: self._merge_one(name, b, known.get(name), version.buckets) for name, b in batches.items()}
            self._append(run, "succeeded", seq + 2, version.buckets, [*merged.values(), *(tuple(t) for n, t in known.items() if n not in merged)])
        except Exception as failed:
            self._append(run, "failed", seq + 2, version.buckets, [], f"{type(failed).__name__}: {str(failed)[:500]}")
            raise
        counts = [(t[0], t[3], t[4], t[5], t[6]) for t in merged.values()]
        return self.spark.createDataFrame(counts, "name string, source long, inserted long, unchanged long, final long")

    def _merge_one(self, name: str, batch: Batch, stored, buckets: int) -> tuple:
        keys = list(batch.keys)
        if stored is not None and list(stored.keys) != keys:
            raise Refused(f"{name}: its key is {list(stored.keys)}")
        place = f"{self.folder}/data/{name}"
        staged = bucketed(batch.rows, keys, buckets, f"{place}/staged-{uuid.uuid4().hex}")
        if not staged.filter(" or ".join(f"`{k}` is null" for k in keys)).isEmpty():
            raise Refused(f"{name}: a key is null")
        if not duplicate_keys(staged, keys).isEmpty():
            raise Refused(f"{name}: a key is repeated")
        parts = [open_bucketed(self.spark, p, keys, buckets) for p in stored.parts] if stored else []
        new = staged
        for part in parts:
            changed = changed_rows(staged, part, keys, list(batch.compare)).select(fingerprint(staged.columns).alias("f")).first() if batch.compare else None
            if changed:
                raise Refused(f"{name}: a stored row changed, {changed.f}")
            extra = batch.scope(part).join(staged, keys, "left_anti").select(fingerprint(part.columns).alias("f")).first() if batch.scope else None
            if extra:
                raise Refused(f"{name}: a stored row of the scope is missing, {extra.f}")
            new = new.join(part, keys, "left_anti")
        source, before = staged.count(), sum(p.count() for p in parts)
        path = f"{place}/part-{uuid.uuid4().hex}"
        inserted = bucketed(new, keys, buckets, path).count()
        held = inserted + sum(staged.join(p, keys, "left_semi").count() for p in parts)
        if held != source:
            raise Refused(f"{name}: {source} rows staged, {held} found")
        return (name, keys, [*(stored.parts if stored else []), *([path] if inserted else [])], source, inserted, source - inserted, before + inserted)
