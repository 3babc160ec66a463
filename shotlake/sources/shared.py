"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, plain local mode alone makes one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return _local[0]


#: Bytes of compressed tables that one task's share of a shuffle comes from.
SHARE = 4 << 20
_shares: dict[tuple[str, ...], int] = {}


def shares(spark: SparkSession, *paths: str) -> int:
    """How many partitions rows of these files are dealt into, so that a task's share stays as it is when files grow; at
    least the session's own number. Only the files' lengths are read, once an application."""
    at = (spark.sparkContext.applicationId, *paths)
    if at not in _shares:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
        _shares[at] = (files.agg(F.sum("length")).first()[0] or 0) // SHARE
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), _shares[at])


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df as written to the shared folder (with a writer's options) and read from there: for frames that several jobs read."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(*held: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    for table in held:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            delete_folder(table.sparkSession, folder)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def local_folder(spark: SparkSession, folder: str) -> str | None:
    """A folder, made, as tasks' own code can open it; None if it isn't a path of the machines' own file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = files.makeQualified(path).toUri()
    if uri.getScheme() != "file":
        return None
    files.mkdirs(path)
    return uri.getPath()
