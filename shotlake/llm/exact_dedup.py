"""Exact dedup with a split for heavy hitters; DataFrame functions only.

Each row is reduced to the SHA-256 of its text without ASCII white space, its length, and a tag. Frequent digests
are found with a Misra-Gries summary (DataFrame.stat.freqItems, which keeps 1 / SUPPORT counters a task and misses no
digest of more than that share of the rows). The candidates' exact counts and winners come from one map-side grouping,
and candidates that turn out not to be frequent are dropped: at most 1 / SUPPORT rows are left, so they are broadcast
and every copy of a frequent text is settled where it was read. The remaining digests meet in an ordinary shuffle,
in groups of no more than SUPPORT of all rows.

Of equal texts the row with the most code points in its original text stays, then that of the smallest id (null last),
then one of the rows that agree in both. Equality is that of the digests.

Edge cases: a null text is empty, and all texts of white space alone are equal to it; ids may repeat or be null (the
row that stays is told apart by its tag, so exactly one row a group is kept); no rows give no rows. Columns other
than the id and the text are not read, except by drop_exact_duplicates, which returns all columns; names that start
with __xd_ are the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hold

#: A digest is frequent if more than this share of all rows have it.
SUPPORT = 1e-4
WHITE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), WHITE, "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, sha, rank, *keep), held: the least rank of a digest is the row that stays."""
    sha = F.sha2(normalised(F.col(text_col)).cast("binary"), 256)
    n_chars = F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long")
    rank = F.struct((-n_chars).alias("chars"), F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("tag"))
    return hold(docs.select(F.col(id_col).alias("id"), sha.alias("sha"), rank.alias("rank"), *keep), "digests")


def heavy_winners(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Rows (sha, size, best) of the digests that more than this share of rows have; 1 / support rows at most."""
    n_rows = rows.count()
    listed = rows.stat.freqItems(["sha"], support).select(F.explode("sha_freqItems").alias("sha"))
    exact = rows.join(F.broadcast(listed), "sha").groupBy("sha").agg(F.count("*").alias("size"), F.min("rank").alias("best"))
    return hold(exact.filter(F.col("size") > support * n_rows), "frequent")


def duplicates(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """rows (from digests) with size and best of their digest."""
    heavy = heavy_winners(rows, support)
    settled = rows.join(F.broadcast(heavy), "sha")
    group = Window.partitionBy("sha")
    shuffled = rows.join(F.broadcast(heavy.select("sha")), "sha", "left_anti").withColumns({"size": F.count("*").over(group), "best": F.min("rank").over(group)})
    return settled.unionByName(shuffled)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """For each row: id, keep_id (id of the row that stays), group_size, kept, text_sha256."""
    found = duplicates(digests(docs, id_col, text_col), support)
    kept = F.col("rank.tag") == F.col("best.tag")
    return found.select(F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """docs with one row of each group of equal texts. The rows are held once with a tag, and those that go are left
    out by tag, so texts are not shuffled unless very many of them go."""
    tagged = hold(docs.withColumn("__xd_tag", F.monotonically_increasing_id()), "tagged")
    found = duplicates(digests(tagged, id_col, text_col, ("__xd_tag",)), support)
    gone = hold(found.filter("rank.tag <> best.tag").select("__xd_tag"), "gone")
    return tagged.join(gone, "__xd_tag", "left_anti").select(*docs.columns)
