"""I-Match document fingerprints over randomised lexicons.

Document frequencies are counted over the whole corpus on hashed terms: 2^24 buckets, so that the lexicon (the
buckets whose inverse document frequency lies in the band) is a bitmap of 2 MB at any corpus size. Terms that share a
bucket share its frequency. What that can cost: a term leaves the lexicon if it shares its bucket with a term of more
than N / e^3 documents, which for F such terms happens to F of 2^24 terms (2,000 frequent words: 0.01 %). Sums of rare
terms stay far below that limit; the lower limit of e^-16 N documents only matters beyond nine million documents.

A fingerprint keeps a text's distinct terms of the lexicon and hashes, in ascending order of the terms' own hashes, the
part of them that falls into each of several random subsets of the lexicon. Subsets come in shares from 1/4 to 1/4096,
16 of each share, since whether a subset survives an edit depends on how many of a text's terms it holds; one more
holds the whole lexicon. Hashes are cut to 16 bits, so that two different parts agree by chance once in 65,536.

Likeness of two fingerprints is the share of equal hashes among subsets that hold a term of either, at the share
of subsets where it is largest (at least 4 such subsets). Equal texts have likeness 1.

Edge cases: a null text is empty; a text without terms of the lexicon has only empty hashes and is like an equal
fingerprint alone; ids are integers, may repeat (ordered by their texts' hashes) and come last if null; rows that
repeat both id and text stay in one range of ids; a single document's next document is itself; no rows give no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, shuffle_partitions

BITS, BLOCK = 24, 1 << 16
IDF_BAND = (3.0, 16.0)
LEVELS, COPIES, LEAST_LIVE = (2, 4, 6, 8, 10, 12), 16, 4
EMPTY = 0
#: Documents in a range of ids up to MANY ranges; beyond, ranges grow in size and number alike. Sampled ids a range.
ROWS_A_PART, MANY, SAMPLED, SALTS = 1000, 20_000, 8, 16


def term_hashes(text: str) -> np.ndarray:
    """64-bit hashes of a text's distinct words, A-Z lower-cased."""
    import xxhash

    found = set(text.encode("utf-8", "surrogatepass").lower().split())
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))


def lexicon(docs: DataFrame, text_col: str = "text", band: tuple[float, float] = IDF_BAND) -> tuple[bytes, int]:
    """A bitmap of the term buckets whose idf = ln((1 + N) / df) is in the band, and the number of documents.

    Each task counts into a fixed array and sends its counts packed by block; blocks are added up in two steps, so
    a group holds some hundreds of packed parts at most for every ten thousand tasks.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(1 << BITS, np.int32), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                if text:
                    seen[np.unique(term_hashes(text) & np.uint64((1 << BITS) - 1)).astype(np.int64)] += 1
        if n:
            salt = TaskContext.get().partitionId() % SALTS
            blocks = [b for b in range(1 << BITS >> 16) if seen[b * BLOCK : (b + 1) * BLOCK].any()]
            packed = [zlib.compress(seen[b * BLOCK : (b + 1) * BLOCK].astype("<i8").tobytes(), 1) for b in blocks]
            yield pa.RecordBatch.from_arrays([pa.array([-1, *blocks], pa.int32()), pa.array([salt] * (1 + len(blocks)), pa.int32()), pa.array([n] + [0] * len(blocks), pa.int64()), pa.array([b"", *packed], pa.binary())], ["block", "salt", "n", "counts"])

    def total(parts: pd.Series) -> np.ndarray:
        out = np.zeros(BLOCK, np.int64)
        for x in parts:
            if x:
                out += np.frombuffer(zlib.decompress(x), "<i8")
        return out

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": pdf.block[:1], "salt": pdf.salt[:1], "n": [int(pdf.n.sum())], "counts": [zlib.compress(total(pdf.counts).astype("<i8").tobytes(), 1)]})

    schema = "block int, salt int, n long, counts binary"
    counted = hold(docs.select(F.col(text_col).cast("string")).mapInArrow(count, schema).groupBy("block", "salt").applyInPandas(add, schema), "frequencies")
    n_docs = counted.filter("block = -1").agg(F.sum("n")).first()[0] or 0
    most, least = (n_docs + 1) / np.exp(band[0]), (n_docs + 1) / np.exp(band[1])

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        df = total(pdf.counts)
        return pd.DataFrame({"block": pdf.block[:1], "bits": [np.packbits((df > 0) & (df >= least) & (df <= max(most, 1)), bitorder="little").tobytes()]})

    bits = bytearray(1 << BITS >> 3)  # 2 MB
    for row in counted.filter("block >= 0").groupBy("block").applyInPandas(mark, "block int, bits binary").collect():
        bits[row.block * BLOCK // 8 : (row.block + 1) * BLOCK // 8] = row.bits
    return bytes(bits), n_docs


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = _mix(np.arange(1, COPIES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]


def fingerprint(text: str, bits: np.ndarray) -> np.ndarray:
    """1 + len(LEVELS) * COPIES hashes of 16 bits: of all terms of the lexicon, then of those in each subset."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    terms = term_hashes(text)
    bucket = terms & np.uint64((1 << BITS) - 1)
    terms = np.sort(terms[(bits[(bucket >> np.uint64(3)).astype(np.int64)] >> (bucket & np.uint64(7)).astype(np.uint8)) & 1 == 1]).astype("<u8")
    if not len(terms):
        return np.full(1 + len(LEVELS) * COPIES, EMPTY, np.uint16)
    out = [max(digest(terms.tobytes()) >> 48, 1)]
    place = _mix(terms[None, :] ^ _SEEDS)
    for level in LEVELS:
        copy, at = np.nonzero(place < np.uint64(1 << (64 - level)))  # by copy, each in the order of the terms
        held, ends = terms[at].tobytes(), (8 * np.searchsorted(copy, np.arange(COPIES + 1))).tolist()
        out += [max(digest(held[a:b]) >> 48, 1) if a < b else EMPTY for a, b in zip(ends, ends[1:])]
    return np.array(out, np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if np.array_equal(a, b):
        return 1.0
    live, same = (a != EMPTY) | (b != EMPTY), (a == b) & (a != EMPTY)
    by = [(int(live[1 + k * COPIES : 1 + (k + 1) * COPIES].sum()), int(same[1 + k * COPIES : 1 + (k + 1) * COPIES].sum())) for k in range(len(LEVELS))]
    enough = [s / n for n, s in by if n >= LEAST_LIVE]
    return max(enough) if enough else float(same.sum() / max(1, live.sum()))


def _hex(x: np.ndarray) -> str:
    return x.astype(">u2").tobytes().hex()


def edit(text: str, following: str) -> str:
    """The last half (rounded down) of a text's code points replaced by the first as many of another text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _ranges(n_docs: int, least: int) -> int:
    ranges = n_docs // ROWS_A_PART
    return max(least, ranges if ranges <= MANY else int((MANY * ranges) ** 0.5))


def _neighbours(docs: DataFrame, id_col: str, text_col: str, n_docs: int) -> DataFrame:
    """Rows (part, wrapped, own, place, id, text), parts sorted by place: ranges of places, which are ids (null last),
    then texts' hashes, as text. After a part's own rows comes the first document of the next one (after the last
    part: of the first). The bounds come from a sample of places; one task reads one part."""
    spark = docs.sparkSession
    parts = _ranges(n_docs, max(48, shuffle_partitions(spark)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    number = lambda x: F.lpad(F.hex(x.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    place = F.concat(F.col(id_col).isNull().cast("int").cast("string"), number(F.coalesce(F.col(id_col).cast("long"), F.lit(0))), number(F.xxhash64(text)))
    keyed = docs.select(F.col(id_col).alias("id"), place.alias("place"), text.alias("text"))
    share = int(min(1.0, SAMPLED * parts / max(1, n_docs)) * (1 << 30))
    sample = keyed.select("place").filter(F.pmod(F.xxhash64("place"), F.lit(1 << 30)) < share).orderBy("place")
    cuts = [r.place for k, r in enumerate(sample.toLocalIterator()) if k % SAMPLED == SAMPLED - 1]  # about one a part
    bounds = np.unique(np.array(cuts, "S33"))

    @F.pandas_udf("int")
    def part_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, place.to_numpy().astype("S33"), side="right").astype(np.int32))

    own = keyed.withColumn("part", part_of("place"))
    firsts = sorted(own.groupBy("part").agg(F.min("place").alias("place")).collect())  # a row a part
    before = spark.createDataFrame([(r.place, firsts[i - 1].part, i == 0) for i, r in enumerate(firsts)], "place string, to int, wrapped boolean")
    also = own.join(F.broadcast(before) if len(firsts) <= 50_000 else before, "place", "left")
    sent = F.array_compact(F.array(F.struct("part", F.lit(False).alias("wrapped"), F.lit(True).alias("own")), F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("part"), "wrapped", F.lit(False).alias("own")))))
    spread = also.withColumn("at", F.explode(sent)).select("at.part", "at.wrapped", "at.own", "place", "id", "text")
    return spread.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "wrapped", F.desc("own"), "place")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """For each row: n_chars, fingerprint, that of its edited text (see edit; the other text is the next document's
    by id), the edited text's SHA-256, and the likeness of the fingerprint to the edited and to the next text's."""
    bitmap, n_docs = lexicon(docs, text_col, band)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        last = None  # the row that waits for the next: part, id, text, fingerprint
        for batch in batches:
            out: list[tuple] = []
            for part, own, key, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 4, 5))):
                if not own and last is None:
                    continue  # further rows that share the next part's first id
                mine = fingerprint(text, bits)
                if last is not None and last[0] == part:
                    edited = edit(last[2], text)
                    other = fingerprint(edited, bits)
                    out.append((last[1], len(last[2]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), _hex(last[3]), _hex(other), likeness(last[3], other), likeness(last[3], mine)))
                last = (part, key, text, mine) if own else None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names)

    return _neighbours(docs, id_col, text_col, n_docs).mapInArrow(rows, f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
