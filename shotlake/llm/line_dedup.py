"""Line dedup by pairwise alignment.

Each line with words starts a run: the fewest lines from there on that hold MIN_BLOCK_WORDS words (one long line, or
several short ones). A run's hash leads to the first document that holds it (least id, then least text hash). A
document is paired with the first holders of its runs, whether a run is rare or in a third of all documents: pairs
grow with the lines, not with the square of a run's documents, and each block that may be deleted holds such a run.
Pairs carry line hashes, not texts. A patience diff aligns both documents' hashes; runs of lines that follow each
other in both and hold at least MIN_BLOCK_WORDS words are deleted from the later document. Blocks that moved cross
the alignment; they are found in one more pass, which looks up each shortest run of enough words of the later document
among those of the earlier one, so that work is linear in the lines, whatever their order.

A run's first holder keeps it, so every deleted text stays in the corpus once. This departs from pairing all documents
that share rare line hashes: a run counts whether it is rare or common, and its first holder stands for all of its
holders. No block that may be deleted is lost by it, as a test against all pairs shows.

A later step may drop whole documents, and a passage that it holds first would go with it. Where groups of documents
are given of which that step keeps one, only documents that it keeps are holders, and no document loses lines to one
of its own group: a dropped copy stays whole for the step that drops it. line_dedup_before() checks afterwards that the
step still keeps every holder.

Edge cases: null and empty texts have no lines to delete and stay as they are; lines are compared without the white
space at their ends; null ids come last, beside the largest long; rows that repeat both id and text are one document and share a result;
repeats within a document stay; no rows give no rows. Columns named __ld_* are the operator's own; others are kept.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, hold, release

MIN_BLOCK_WORDS = 8
#: Levels of the patience diff. Blocks that deeper ones would align are found by their runs.
DEPTH = 32
#: Documents with deletions that are broadcast at most, with eight times as many deleted lines (some 20 MB).
MANY = 1 << 18
_LAST = (1 << 63) - 1
_EDGE = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _unique(lines: list[int], lo: int, hi: int) -> dict[int, int]:
    at: dict[int, int] = {}
    more = set()
    for i in range(lo, hi):
        if lines[i] in at:
            more.add(lines[i])
        at[lines[i]] = i
    return {h: i for h, i in at.items() if h not in more}


def _numbered(lines: list[int], lo: int, hi: int) -> dict[tuple[int, int], int]:
    seen: dict[int, int] = {}
    at: dict[tuple[int, int], int] = {}
    for i in range(lo, hi):
        seen[lines[i]] = k = seen.get(lines[i], 0) + 1
        at[lines[i], k] = i
    return at


def patience(a: list[int], b: list[int], depth: int = DEPTH) -> list[tuple[int, int]]:
    """Aligned positions of equal lines of a and b, ascending in both: anchored at lines that are unique in both
    (a longest increasing sequence of them), then the same between anchors, after equal heads and tails. Each of the
    levels is linear (but for a logarithm) in the lines; what the last one leaves stays unaligned."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b), depth)]
    while todo:
        i, m, j, n, level = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            found.append((m, n))
        if i == m or j == n or not level:
            continue
        once = _unique(b, j, n)
        pairs = sorted((x, once[h]) for h, x in _unique(a, i, m).items() if h in once)
        if not pairs:  # no line is unique in both: the k-th occurrence of a line answers its k-th in the other
            once = _numbered(b, j, n)
            pairs = sorted((x, once[h]) for h, x in _numbered(a, i, m).items() if h in once)
        tops: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for k, (_, y) in enumerate(pairs):
            p = bisect_left(tops, y)
            back.append(ends[p - 1] if p else -1)
            tops[p : p + 1], ends[p : p + 1] = [y], [k]
        chain, k = [], ends[-1] if ends else -1
        while k >= 0:
            chain.append(pairs[k])
            k = back[k]
        if not chain:
            continue
        chain.reverse()
        found += chain
        edges = [(i - 1, j - 1), *chain, (m, n)]
        todo += [(x + 1, u, y + 1, v, level - 1) for (x, y), (u, v) in pairwise(edges) if u > x + 1 and v > y + 1]
    return sorted(found)


def _shortest(sizes: list[int], least: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of the shortest run of lines with `least` words from each line with words, and to each, where there
    is one. Any run of enough words is the union of those within it."""
    for flipped in (False, True):
        given, stop, held = sizes[::-1] if flipped else sizes, 0, 0
        for start, n in enumerate(given):
            while held < least and stop < len(given):
                held += given[stop]
                stop += 1
            if held < least:
                break
            if n:
                yield (len(given) - stop, len(given) - start) if flipped else (start, stop)
            held -= n


def common_blocks(earlier: list[int], later: list[int], sizes: list[int], least: int = MIN_BLOCK_WORDS) -> list[int]:
    """Positions of later's lines in blocks of at least `least` words that are in both, in any order; sizes are later's
    words by line, and an equal line has as many."""
    gone: set[int] = set()
    block: list[tuple[int, int]] = []
    for pair in [*patience(earlier, later), None]:
        if block and (pair is None or pair[0] != block[-1][0] + 1 or pair[1] != block[-1][1] + 1):
            lines = [y for _, y in block]
            if sum(sizes[p] for p in lines) >= least:
                gone.update(lines)
            block = []
        if pair is not None:
            block.append(pair)
    # blocks that cross the alignment: a run of the earlier document ends at a line that the later one lacks
    words = dict(zip(later, sizes))
    held = {tuple(earlier[i:k]) for i, k in _shortest([words.get(h, least) for h in earlier], least)}
    for start, stop in _shortest(sizes, least):
        if tuple(later[start:stop]) in held:
            gone.update(range(start, stop))
    return sorted(gone)


def runs(hashes: list[int], sizes: list[int], least: int = MIN_BLOCK_WORDS) -> list[int]:
    """Distinct hashes of the shortest runs of lines that hold `least` words, one for each line with words that starts
    such a run; lines without words are passed over, so a run has `least` lines at most."""
    import xxhash

    inked = [(h, n) for h, n in zip(hashes, sizes) if n]
    found = set()
    for i, (h, n) in enumerate(inked):
        k = i + 1
        while n < least and k < len(inked):
            n += inked[k][1]
            k += 1
        if n >= least:
            found.add(h if k == i + 1 else xxhash.xxh64_intdigest(array("q", [x for x, _ in inked[i:k]]).tobytes()) - (1 << 63))
    return list(found)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, _EDGE, ""))
    return docs.select(F.coalesce(F.col(id_col), F.lit(_LAST)).alias("o"), F.xxhash64(text).alias("h"), plain.alias("l")).select(
        "o", "h", F.transform("l", lambda x: F.xxhash64(x)).alias("hashes"), F.transform("l", lambda x: F.when(x == "", 0).otherwise(F.size(F.split(x, r"[\x20\x09-\x0D]+")))).alias("sizes")
    )


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = MIN_BLOCK_WORDS, groups: DataFrame | None = None) -> DataFrame:
    """Rows (o, h, fo, fh, gone), held, for documents that lose lines to a holder: o and fo are their integer ids (null:
    the largest long), h and fh their texts' hashes, gone the positions from 0 of the lines to delete. groups has rows
    (o, h, group, leads), one a document: only documents that lead are holders, and nothing is deleted for a holder of
    the same group."""
    spark = docs.sparkSession

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [runs(*row, block_words) for row in zip(*(batch.column(k).to_pylist() for k in (2, 3)))]
            at = pa.array(np.repeat(np.arange(len(made)), [len(x) for x in made]))
            own = [batch.column(k).take(at) for k in (0, 1, 4, 5)]
            yield pa.RecordBatch.from_arrays([*own[:2], pa.array([x for r in made for x in r], pa.int64()), *own[2:]], ["o", "h", "run", "group", "leads"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [common_blocks(*row, block_words) for row in zip(*(batch.column(k).to_pylist() for k in (4, 5, 6)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(gone, pa.list_(pa.int32()))], ["o", "h", "fo", "fh", "gone"])

    lines = _lines(docs, id_col, text_col).dropDuplicates(["o", "h"])
    if groups is None:
        lines = lines.withColumns({"group": F.lit(None).cast("long"), "leads": F.lit(True)})
    else:
        lines = lines.join(groups.select("o", "h", "group", "leads"), ["o", "h"], "left").withColumn("leads", F.coalesce("leads", F.lit(True)))
    lines = hold(lines, "lines")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    try:  # a row holds the lines of one or two documents
        spark.conf.set(batch, 1000)
        seeds = hold(lines.select("o", "h", "hashes", "sizes", "group", "leads").mapInArrow(seed, "o long, h long, run long, group long, leads boolean"), "runs")
        # held, so that the join deals out both sides anew and Spark can split a run that very many documents hold
        holder = F.min(F.when(F.col("leads"), F.struct("o", "h", "group"))).alias("first")
        first = seeds.groupBy("run").agg(holder, F.count("*").alias("n")).filter("n > 1 and first is not null")
        first = hold(first.select("run", F.col("first.o").alias("fo"), F.col("first.h").alias("fh"), F.col("first.group").alias("fg")), "first-holders")
        pairs = hold(seeds.join(first, "run").filter("(o <> fo or h <> fh) and not (group <=> fg and group is not null)").select("o", "h", "fo", "fh").distinct(), "pairs")
        # held as well: one document may be the first holder for very many others
        heads = hold(lines.select(F.col("o").alias("fo"), F.col("h").alias("fh"), F.col("hashes").alias("earlier")).join(pairs.select("fo", "fh").distinct(), ["fo", "fh"], "left_semi"), "heads")
        both = pairs.join(heads, ["fo", "fh"]).join(lines.select("o", "h", F.col("hashes").alias("later"), "sizes"), ["o", "h"])
        found = hold(both.select("o", "h", "fo", "fh", "earlier", "later", "sizes").mapInArrow(align, "o long, h long, fo long, fh long, gone array<int>").filter(F.size("gone") > 0), "aligned")
    finally:
        spark.conf.set(batch, before)
    del both
    release(lines, seeds, first, pairs, heads)
    return found


def deletions(found: DataFrame) -> DataFrame:
    """Rows (o, h, gone): all lines that each document loses, from aligned(). It has a holder for each at most."""
    return found.groupBy("o", "h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", report: bool = False, **options) -> DataFrame:
    """docs with the deleted lines gone from the texts. report adds __ld_lines, __ld_gone (deleted positions) and __ld_x
    (the hash of the text before). Options are those of aligned()."""
    return _cut(docs, aligned(docs, id_col, text_col, **options), id_col, text_col, report)


def _cut(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, report: bool) -> DataFrame:
    gone = hold(deletions(pairs), "deletions")
    # texts are shuffled only to meet very many deletions
    few = gone.agg(F.count("*") <= MANY, F.coalesce(F.sum(F.size("gone")), F.lit(0)) <= 8 * MANY).first()
    found = (F.broadcast(gone) if all(few) else gone).select(F.col("o").alias("__ld_o"), F.col("h").alias("__ld_h"), F.col("gone").alias("__ld_gone"))
    keyed = docs.withColumn("__ld_k", F.coalesce(F.col(id_col), F.lit(_LAST))).withColumn("__ld_x", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    joined = keyed.join(found, (F.col("__ld_k") == F.col("__ld_o")) & (F.col("__ld_x") == F.col("__ld_h")), "left")
    split = F.split(F.col(text_col), "\n")
    left = F.when(F.col("__ld_gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(split, lambda x, i: ~F.array_contains(F.col("__ld_gone"), i)), "\n"))
    extra = [F.coalesce(F.size(split), F.lit(0)).alias("__ld_lines"), F.coalesce("__ld_gone", F.array().cast("array<int>")).alias("__ld_gone"), "__ld_x"] if report else []
    return joined.select(*[left.alias(c) if c == text_col else F.col(c) for c in docs.columns], *extra)


def line_dedup_before(docs: DataFrame, groups_of: Callable[[DataFrame], DataFrame], id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """line_dedup (with its report) before a step that keeps one document of each group, so that no deleted text goes
    with a dropped document. groups_of gives the step's groups as rows (o, h, group, leads) of a table of documents.

    Holders that lead their group before the deletion but would no longer after it are made holders of nothing, and the
    deletion is done again, until every holder is kept; documents without a word left are gone by then and hold nothing.
    Each round takes at least one holder; see the README for how many rounds are seen."""
    groups = hold(groups_of(docs), "groups")
    while True:
        pairs = aligned(docs, id_col, text_col, groups=groups, **options)
        done = hold(_cut(docs, pairs, id_col, text_col, True), "cut")
        left = done.filter(~emptied(text_col)).withColumns({"__ld_o": F.coalesce(F.col(id_col), F.lit(_LAST)), "__ld_now": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
        after = groups_of(left.select(*docs.columns)).filter(~F.col("leads")).select(F.col("o").alias("__ld_o"), F.col("h").alias("__ld_now"))
        follows = left.select("__ld_o", "__ld_now", "__ld_x").join(after, ["__ld_o", "__ld_now"], "left_semi").select(F.col("__ld_o").alias("fo"), F.col("__ld_x").alias("fh"))
        lost = hold(pairs.select("fo", "fh").distinct().join(follows, ["fo", "fh"], "left_semi").select(F.col("fo").alias("o"), F.col("fh").alias("h"), F.lit(True).alias("lost")), "lost-holders")
        if lost.isEmpty():
            release(pairs, groups, lost)
            return done
        given, groups = groups, hold(groups.join(lost, ["o", "h"], "left").withColumn("leads", F.col("leads") & F.col("lost").isNull()).drop("lost"), "groups")
        del left, after, follows
        release(pairs, done, given, lost)


def emptied(text_col: str = "text") -> Column:
    """Whether a document of line_dedup's report has no word left of those that it had."""
    return F.coalesce((F.size("__ld_gone") > 0) & ~F.col(text_col).rlike(WORD), F.lit(False))
