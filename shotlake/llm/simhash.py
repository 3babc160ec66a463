"""SimHash near-duplicates: fingerprints over word shingles, linked by tiled exact comparison.

Fingerprints are made in Arrow batches. Distinct fingerprints are dealt into tiles by the population counts of
their two halves; a pair of tiles is compared (numpy exclusive-or and bit counts) only if those counts differ by
no more than the radius in all, since two words cannot be nearer than their counts. A tile pair gives a spanning
forest of its links, never all pairs, and the forests meet in a connected-components job. Tiles hold a bounded
number of fingerprints, the number of tiles grows instead, so no link is lost and no task grows.

The comparison is exact, so its work grows with the square of the number of distinct fingerprints (about 1 ns a
pair); see the README for measured figures.

drop_near_texts links by similarity instead: texts whose fingerprints, 128 bits here, are near form candidate groups,
and within each group the exact Jaccard similarity of the shingle sets decides which texts are linked. Both steps give
forests; large groups are dealt into jobs of bounded size that hold every pair of the group's texts.

Edge cases: a null, empty or blank text has fingerprint 0 and is linked like any other; a text of fewer words than
a shingle is one shingle; equal texts share a fingerprint; a null id never names a component unless all its
members' ids are null; no rows give no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, components, hold, release, shuffle_partitions

SHINGLE, RADIUS, TILE = 4, 4, 16_384
#: For drop_near_texts. At a similarity of 0.8 fingerprints differ in about 0.15 of their bits: 10 of 64 and 19 of 128,
#: with deviations of 3 and 4. NEAR is the radius of the first 64 bits, NEAR_BOTH that of all 128.
NEAR_SIZE, SIMILARITY, NEAR, NEAR_BOTH = 5, 0.8, 20, 32
#: Texts and shingles of half a job.
JOB_TEXTS, JOB_SHINGLES = 1024, 1_000_000
#: Rows of three longs that are broadcast at most (some 50 MB on each executor), so that texts are not shuffled by hash.
MANY = 1 << 20
HASH_SEED = 42
_ROWS = 32


def shingle_hashes(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the word shingles of UTF-8 text, in order and with repeats."""
    import xxhash

    found = (text or b"").lower().split()  # for bytes: A-Z only, and ASCII white space
    if not found:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= size:
        return np.array([digest(joined, HASH_SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(found) - size + 1
    return np.fromiter((digest(joined[a:b], HASH_SEED) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist())), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The unsigned word whose bits are set if more than half the hashes have them; 0 for none."""
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):  # bounded memory for very long texts
        block = np.ascontiguousarray(hashes[at : at + (1 << 14)]).astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def mixed_bits(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles (the last steps of SplitMix64)."""
    x = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def simhash(text: bytes | None, size: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of UTF-8 text: a bit is set if more than half the shingles' hashes have it."""
    return majority(shingle_hashes(text, size))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, fp, *keep): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(x, size) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), *batch.columns[2:]], [id_col, "fp", *keep])

    read = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("__text"), *keep)
    kinds = dict(docs.dtypes)
    return read.mapInArrow(run, ", ".join([f"`{id_col}` {kinds[id_col]}", "fp long", *(f"`{k}` {kinds[k]}" for k in keep)]))


def _forest(a: np.ndarray, b: np.ndarray, radius: int, more: tuple[np.ndarray, np.ndarray, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a and b of links within the radius that connect all that any links between a and b connect.

    more: further words of a and of b, and the radius for both words together."""
    parent = np.arange(len(a) + len(b))
    got: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(a), _ROWS):
        near = np.bitwise_count(a[at : at + _ROWS, None] ^ b[None, :]) <= radius
        if not near.any():
            continue
        i, j = np.nonzero(near)
        i = i + at
        if more is not None:
            close = np.bitwise_count(a[i] ^ b[j]) + np.bitwise_count(more[0][i] ^ more[1][j]) <= more[2]
            i, j = i[close], j[close]
        j = j + len(a)
        while len(i):
            ri, rj = parent[i], parent[j]
            apart = ri != rj
            i, j, ri, rj = i[apart], j[apart], ri[apart], rj[apart]
            if not len(i):
                break
            high, first = np.unique(np.maximum(ri, rj), return_index=True)
            parent[high] = np.minimum(ri, rj)[first]
            got.append((i[first], j[first] - len(a)))
            while True:
                up = parent[parent]
                if np.array_equal(up, parent):
                    break
                parent = up
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in got]), np.concatenate([y for _, y in got])


def near_links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE, both_radius: int | None = None) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b): a forest for each compared pair of tiles.

    With both_radius, rows are (node, fp, more) with distinct nodes, links are of nodes, and both words together must
    be within both_radius as well."""
    spark = fps.sparkSession
    wide = max(1, radius // 4)  # counts are taken in steps of this, so that a wide radius doesn't pair very many small tiles
    held = [F.col(c) for c in (("fp",) if both_radius is None else ("fp", "node", "more"))]
    counted = fps.select(*held, (F.bit_count(F.shiftrightunsigned("fp", 32)) / wide).cast("int").alias("p"), (F.bit_count(F.col("fp").bitwiseAND(0xFFFFFFFF)) / wide).cast("int").alias("q"))
    cells = {(r.p, r.q): r.n for r in counted.groupBy("p", "q").agg(F.count("*").alias("n")).collect()}  # 33 * 33 rows at most
    if not cells:
        return spark.createDataFrame([], "a long, b long")
    chunks = {k: -(-n // tile) for k, n in cells.items()}
    table = F.broadcast(spark.createDataFrame([(*k, v) for k, v in chunks.items()], "p int, q int, chunks int"))
    tile_id = ((F.col("p") * 33 + F.col("q")).cast("long") * (1 << 40)) + F.pmod(F.xxhash64("fp" if both_radius is None else "node"), F.col("chunks"))
    tiles = hold(counted.join(table, ["p", "q"]).withColumn("tile", tile_id).groupBy("tile").agg(F.collect_list(F.struct(*held)).alias("fps")), "tiles")

    def apart(x: int, y: int) -> int:
        """The least difference of two counts."""
        return (abs(x - y) - 1) * wide + 1 if x != y else 0

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: dict[int, list[tuple[int, int]]] = {}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                cell = t >> 40
                if cell not in near:
                    p, q = divmod(cell, 33)
                    near[cell] = [(x * 33 + y, n) for (x, y), n in chunks.items() if apart(x, p) + apart(y, q) <= radius and x * 33 + y >= cell]
                others = np.concatenate([(c << 40) + np.arange(n, dtype=np.int64) for c, n in near[cell]])
                others = others[others >= t]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(others), t)), pa.array(others)], ["tile", "other"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                words = [[x.to_numpy(zero_copy_only=False) for x in batch.column(k)[row].values.flatten()] for k in (0, 1)]
                a, b = (w[0].view(np.uint64) for w in words)
                more = None if both_radius is None else (words[0][2].view(np.uint64), words[1][2].view(np.uint64), both_radius)
                i, j = _forest(a, b, radius, more)
                a, b = (w[0] if both_radius is None else w[1] for w in words)
                different = a[i] != b[j]
                yield pa.RecordBatch.from_arrays([pa.array(a[i][different]), pa.array(b[j][different])], ["a", "b"])

    work = sum(n * cells[k] for (p, q), n in cells.items() for k in cells if apart(k[0], p) + apart(k[1], q) <= radius)
    parts = max(shuffle_partitions(spark), min(100_000, work // 2_000_000_000))
    pairs = tiles.select("tile").mapInArrow(partners, "tile long, other long")
    left = pairs.join(tiles.withColumnRenamed("fps", "left"), "tile").select("other", "left").repartition(parts, "other")
    both = left.join(tiles.select(F.col("tile").alias("other"), F.col("fps").alias("right")), "other").select("left", "right")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    try:  # a row holds two tiles of up to 128 KB a word or so
        spark.conf.set(batch, 64 if both_radius is None else 16)
        found = hold(both.mapInArrow(compare, "a long, b long"), "near")
    finally:
        spark.conf.set(batch, before)
    release(tiles)
    return found


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, radius: int = RADIUS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, fp, component_id, *keep) for each row of docs; component_id is the least id reachable by links."""
    return _labelled(docs, id_col, text_col, size, radius, keep).drop("label")


def _labelled(docs: DataFrame, id_col: str, text_col: str, size: int, radius: int, keep: tuple[str, ...]) -> DataFrame:
    """near_components with label, a component's least fingerprint."""
    made = hold(fingerprints(docs, id_col, text_col, size, keep), "fingerprints")
    least = hold(made.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    labels = components(near_links(least.select("fp"), radius)).withColumnRenamed("node", "fp")
    labelled = least.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    firsts = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    named = labelled.join(firsts, "label").select("fp", "component_id", "label")
    return made.join(named, "fp")


def similar(sets: list[np.ndarray], similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Positions of links that connect all sets (sorted, distinct) whose Jaccard similarity is enough; two empty sets are equal."""
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, ids, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holders = owner[np.argsort(ids, kind="stable")]  # of each shingle in turn
    starts = np.cumsum(often) - often
    ends = np.cumsum(sizes)
    group = np.arange(len(sets))
    got: list[tuple[int, int]] = []
    for i in range(len(sets)):
        mine = ids[ends[i] - sizes[i] : ends[i]]
        each = often[mine]
        at = np.repeat(starts[mine] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        shared = np.bincount(holders[at], minlength=len(sets))
        enough = shared >= similarity * (sizes[i] + sizes - shared) - 1e-9
        for j in np.flatnonzero(enough & (group != group[i])).tolist():
            if group[j] != group[i]:
                got.append((i, j))
                group[group == group[j]] = group[i]
    x = np.array(got, np.int64).reshape(-1, 2)
    return x[:, 0], x[:, 1]


def similar_texts(docs: DataFrame, node_col: str, row_col: str, text_col: str = "text", size: int = NEAR_SIZE, similarity: float = SIMILARITY, radius: int = NEAR, both_radius: int = NEAR_BOTH, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, signatures). links: rows (node, label) for texts that have one; label is the least node reachable, and
    node_col has a text's hash. signatures, held, has each text's fingerprints (node, fp, more); those of an earlier
    call may be given as known, so that only other texts are signed. row_col, a long, tells rows of one text apart where
    it can: of equal texts the one of the least is read again, the others are not."""
    spark = docs.sparkSession

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # distinct shingles, as the similarity is one of sets: a repeated line must not outvote the others
            made = [np.unique(shingle_hashes(x, size)) for x in batch.column(1).to_pylist()]
            words = [pa.array(np.array([majority(f(x)) for x in made], np.uint64).view(np.int64)) for f in (lambda x: x, mixed_bits)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *words], ["node", "fp", "more"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.unique(shingle_hashes(x, size).view(np.int64)) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(made, pa.list_(pa.int64()))], ["node", "label", "shingles"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                nodes, sets = batch.column(0)[row].values.flatten()
                i, j = similar([sets[k].values.to_numpy(zero_copy_only=False) for k in range(len(sets))], similarity)
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(i)), nodes.take(pa.array(j))], ["a", "b"])

    texts = docs.select(F.col(node_col).alias("node"), F.coalesce(F.col(row_col), F.lit((1 << 63) - 1)).alias("row"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    # each text's first row, and how many rows agree in text and id with it
    first = hold(texts.groupBy("node", "row").agg(F.count("*").alias("n")).groupBy("node").agg(F.min(F.struct("row", "n")).alias("first")).select("node", "first.*"), "texts")
    steps = [first]
    if known is None:
        new = texts
    else:
        steps.append(hold(first.join(known, "node", "left_anti").select("node", "row"), "new-texts"))
        new = texts.join(broadcast_if_small(steps[-1], MANY), ["node", "row"])
    signed = hold(new.select("node", "text").mapInArrow(sign, "node long, fp long, more long"), "signatures")
    steps.append(signed)
    if known is not None:
        signed = signed.unionByName(known.join(first, "node", "left_semi"))
    nodes = hold(signed.dropDuplicates(["node"]), "nodes")
    steps.append(near_links(nodes, radius, both_radius=both_radius))
    near = hold(components(steps[-1]), "candidates")
    chosen = hold(near.join(first, "node"), "chosen")
    few = texts.join(broadcast_if_small(chosen, MANY), ["node", "row"]).select("node", "label", "text", "n")
    if not chosen.filter("n > 1").isEmpty():  # rows that repeat id and text, the only texts that are shuffled
        few = few.filter("n = 1").unionByName(few.filter("n > 1").dropDuplicates(["node"]))
    sets = hold(few.select("node", "label", "text").mapInArrow(cut, "node long, label long, shingles array<long>"), "shingles")
    parts = sets.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / JOB_TEXTS), F.ceil(F.sum(F.size("shingles")) / JOB_SHINGLES)).alias("parts"))
    parts = hold(parts, "parts")
    mine = sets.join(parts, "label").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    dealt = mine.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    # one part goes with each of the others; alone it is needed only if it is the only one
    jobs = dealt.filter("parts = 1 or part <> with").groupBy("label", F.least("part", "with"), F.greatest("part", "with")).agg(F.collect_list(F.struct("node", "shingles")).alias("texts"))
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    try:  # a row holds a job
        spark.conf.set(batch, 4)
        links = hold(jobs.select("texts").mapInArrow(check, "a long, b long"), "similar")
    finally:
        spark.conf.set(batch, before)
    labels = components(links)
    del few, mine, dealt, jobs, new, signed  # so that their shuffles can go
    release(sets, links, parts, chosen, near, *steps)
    return labels, nodes


class NearGroups:
    """The groups of drop_near_texts, for tables that differ in some of their texts: signatures of texts that an earlier
    call has seen are kept. Options are those of similar_texts."""

    def __init__(self, id_col: str = "doc_id", text_col: str = "text", **options):
        self.id_col, self.text_col, self.options, self.known = id_col, text_col, options, None

    def __call__(self, docs: DataFrame) -> DataFrame:
        """Rows (o, h, group, leads) for each distinct document, of integer id (o; null: the largest long) and text hash
        (h): the group of texts that links of enough similarity connect, and whether drop_near_texts keeps the document."""
        text = F.coalesce(F.col(self.text_col), F.lit(""))
        marked = docs.select(F.col(self.id_col).alias("k"), F.xxhash64(text).alias("h"), text.alias("text"))
        known = self.known
        links, self.known = similar_texts(marked, "h", "k", "text", known=known, **self.options)
        if known is not None:  # its signatures are among the new ones, as far as their texts are
            release(known)
        labels = hold(links, "labels").withColumnRenamed("node", "h")
        found = hold(marked.select("k", "h").distinct().join(labels, "h", "left").select("k", "h", F.coalesce("label", "h").alias("group")), "groups")
        ahead = _leaders(found, ["group"], "k", "h").select("k", "h", F.lit(True).alias("leads"))
        rows = found.alias("f").join(ahead.alias("a"), F.expr("f.k <=> a.k and f.h = a.h"), "left")
        # a null id and the largest one with the same text are one document
        return rows.groupBy(F.coalesce("f.k", F.lit((1 << 63) - 1)).alias("o"), F.col("f.h").alias("h")).agg(F.min("group").alias("group"), F.max(F.coalesce("leads", F.lit(False))).alias("leads"))


def drop_near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each group of texts that links of enough similarity connect: that of least integer id (null
    last), then of least text hash, stays. Equal texts are similar, as are texts without words. Options are those of
    similar_texts."""
    marked = docs.withColumn("__nd_hash", F.xxhash64(F.coalesce(text_col, F.lit(""))))
    labels = hold(similar_texts(marked, "__nd_hash", id_col, text_col, **options)[0], "labels").withColumnRenamed("node", "__nd_hash")
    found = marked.select(id_col, "__nd_hash").join(labels, "__nd_hash", "left").withColumn("group", F.coalesce("label", "__nd_hash"))
    return _leading(docs, marked, hold(found, "groups"), ["group"], id_col)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of least integer id (null last), then of least text
    hash, stays.

    Rows that repeat id and text leave one row. Components are told apart by label, not by id.
    """
    marked = docs.withColumn("__nd_hash", F.xxhash64(F.coalesce(text_col, F.lit(""))))
    found = hold(_labelled(marked, id_col, text_col, size, radius, ("__nd_hash",)), "groups")
    # by label: one id may come with unlinked texts, and then two components share a component_id
    return _leading(docs, marked, found, ["label"], id_col)


def _leaders(found: DataFrame, group: list, id_col: str, hash_col: str) -> DataFrame:
    """(id, hash) of each group's first row; both come from one row, since a null id may be beside any other."""
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("k"), F.col(hash_col).alias("h")))
    return found.groupBy(*group).agg(first.alias("first")).select(F.col("first.k").alias(id_col), F.col("first.h").alias(hash_col))


def _leading(docs: DataFrame, marked: DataFrame, found: DataFrame, group: list, id_col: str) -> DataFrame:
    """Of marked (docs with __nd_hash), one row of each group of found (id, __nd_hash and what names groups)."""
    leaders = _leaders(found, group, id_col, "__nd_hash").toDF("k", "h")
    rows = found.groupBy(F.col(id_col).alias("k"), F.col("__nd_hash").alias("h")).agg(F.count("*").alias("rows"))
    ahead = leaders.alias("l").join(rows.alias("r"), F.expr("l.k <=> r.k and l.h = r.h")).select(F.col("r.k").alias("__nd_k"), F.col("r.h").alias("__nd_h"), F.col("rows").alias("__nd_rows"))
    ahead = hold(ahead, "leaders")
    kept = marked.join(ahead, F.expr(f"`{id_col}` <=> __nd_k and __nd_hash = __nd_h"))
    if ahead.filter("__nd_rows > 1").isEmpty():
        return kept.select(*docs.columns)
    repeated = kept.filter("__nd_rows > 1").dropDuplicates(["__nd_k", "__nd_h"])
    return kept.filter("__nd_rows = 1").unionByName(repeated).select(*docs.columns)
