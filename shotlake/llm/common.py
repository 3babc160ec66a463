"""Pieces that several training-data operators share: the shared folder, held tables, words, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import delete, shared_folder

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def hold(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and return it as read from there: its lineage is cut, lost executors cost nothing.

    All of an application's tables are in one folder, to be removed once its results are written.
    """
    path = f"{shared_folder(df.sparkSession)}/{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*held: DataFrame) -> None:
    """Delete held tables, and let Spark clean up shuffles that nothing refers to any more: a long job would otherwise
    keep all of its steps on disk."""
    delete(*held)
    if held:
        held[0].sparkSession._jvm.System.gc()


def broadcast_if_small(held: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """Broadcast a held table only if its counted rows are few; else leave the join to Spark."""
    return F.broadcast(held) if held.limit(max_rows + 1).count() <= max_rows else held


def words(text: Column) -> Column:
    """All words of a text; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


#: Rows of a batch that goes to Python at once; with texts, Spark's own 10,000 take some hundred MB of an executor.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Have the session send Python no more rows at once than BATCH_ROWS: the setting is read when a job is planned."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(setting))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(setting, BATCH_ROWS)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Links, both ways, of which a task of components() takes its share.
LINKS = 100_000


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b) of longs: rows (node, label), label the least node reachable.

    Alternates large-star and small-star steps until nothing changes; each step moves neighbours to a node's least
    neighbour with one grouped minimum and one join, so no node's neighbours ever meet in one task. Minima are held, a
    row a node: few are broadcast, many meet the links in a join that Spark can split at a hub. Nodes without edges
    are not returned. Every round is written to the shared folder, and its tables are deleted once the next one is there;
    rounds of few links take few tasks and leave few files, whatever the session's number of partitions.
    """
    cores = edges.sparkSession.sparkContext.defaultParallelism

    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())

    now = hold(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = digest(now)
    while mark[0]:
        parts = max(cores, -(-2 * mark[0] // LINKS))
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = hold(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")).coalesce(parts), "least")
        large = both.filter("b > a").join(broadcast_if_small(least), F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # every edge of large points from a larger node to a smaller one
        low = hold(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n").coalesce(parts), "lowest")
        moved = large.join(broadcast_if_small(low), F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = moved.filter("a != b").unionByName(low.select(F.col("n").alias("a"), F.col("m").alias("b")))
        last, now, before = now, hold(small.distinct().coalesce(parts), "links"), mark
        mark = digest(now)
        delete(last, least, low)
        if mark == before:
            break
    heads = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label").unionByName(heads)
