"""Cross-tokenizer alignment with inverted pair bitmaps.

Each text is encoded by two tokenizers whose tokens spell the same bytes. Byte offsets at which tokens of both end cut
them into groups; a token of A and one of B are linked where their byte ranges overlap. The stretches between
neighbouring ends of either tokenizer are exactly the links, so a batch of texts is aligned in one pass over marks of
both tokenizers' ends.

Links are inverted in the tasks: documents are numbered within blocks (at most BLOCK_DOCS documents or about BLOCK_LINKS
links, so memory is bounded), and a block gives each pair of ids that it holds a posting: plane 0 is a bitmap of the
documents that hold the pair, and plane k one of those whose further links of the pair (their number less one) have
bit k - 1 set. A bitmap is compressed as its positions, 2 bytes each, or as bits, whichever is shorter. Bitmaps of a
pair from several batches of a block are OR-merged when the block is closed, those of different blocks cover different
documents, so that their popcounts add up: Spark sums plane 0 for document counts and all planes, weighted, for
link counts. Each posting then meets its pair's counts and returns the scores to its documents, summed by block.
A pair that a third of all documents hold is a row a block, never a list of documents.

Edge cases: a text that is null or empty, or whose bytes differ from what either tokenizer's tokens spell (a space is
put before the text, by A's caller and by B itself), has no tokens: all counts are 0 and the groups are ''. Special
tokens' strings are plain text. Documents are told apart by place, so ids may repeat or be null, and repeated rows
count each. No rows give no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN
from .common import hold

BLOCK_DOCS, BLOCK_LINKS = 8192, 1 << 21
#: Characters (about) that are encoded and aligned at once.
BATCH_CHARS = 1 << 20
_TASK_BLOCKS = 1 << 24
DOC_FIELDS = "block long, pos int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def byte_table() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 characters stand for
    themselves, the other bytes in turn for the characters from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def by_ranks(told: dict, token_bytes: list[bytes]) -> Callable[[str], list[int]] | None:
    """An encoder by ranks (several times as fast) for a plain byte-level BPE whose ids are the order of its merges; None
    for any other tokenizer. Tests hold it against the file's own library, for every code point too."""
    import tiktoken

    model, before = told["model"], told.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or told.get("normalizer") or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")):
        return None
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    made = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    ranks = {x: i for i, x in enumerate(token_bytes) if x}
    if made != list(range(256, 256 + len(made))) or len(ranks) != 256 + len(made):
        return None
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Tokenizers:
    """Both tokenizers, made once in each Python worker from the bytes of their files, with each id's bytes."""

    _made: Tokenizers | None = None
    _key: tuple | None = None

    def __init__(self, a_json: bytes, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = byte_table()
        told = json.loads(a_json)
        added = {t["id"] for t in told.get("added_tokens", [])}
        size = self.a.get_vocab_size(with_added_tokens=True)
        self.a_bytes = [b"" if i in added or (t := self.a.id_to_token(i)) is None else bytes(letters[c] for c in t) for i in range(size)]
        self.fast_a = by_ranks(told, self.a_bytes)
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace("▁", " ").encode() for i, p in pieces]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        text = lambda n, end: np.array([f"{i}{end}" for i in range(n)], object)
        self.names = {"a": text(size, ","), "a_end": text(size, "|"), "b": text(len(pieces), ","), "b_end": text(len(pieces), ";")}

    @classmethod
    def of(cls, a_json: bytes, b_model: bytes) -> Tokenizers:
        key = (hash(a_json), hash(b_model))
        if cls._key != key:
            cls._made, cls._key = cls(a_json, b_model), key
        return cls._made

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both, empty for a text that either does not spell."""
        wanted = [k for k, t in enumerate(texts) if t]
        a, b = [[] for _ in texts], [[] for _ in texts]
        if not wanted:
            return a, b
        spaced = [" " + texts[k] for k in wanted]
        of_a = list(map(self.fast_a, spaced)) if self.fast_a else [x.ids for x in self.a.encode_batch(spaced, add_special_tokens=False)]
        of_b = self.b.encode([texts[k] for k in wanted], num_threads=1)
        for k, text, ids, y in zip(wanted, spaced, of_a, of_b):
            whole = text.encode("utf-8", "surrogatepass")
            if b"".join(map(self.a_bytes.__getitem__, ids)) == whole == b"".join(map(self.b_bytes.__getitem__, y)):
                a[k], b[k] = ids, y
        return a, b


class Aligned:
    """The alignment of a batch of texts: arrays over all of its tokens, links and documents."""

    def __init__(self, t: Tokenizers, a: list[list[int]], b: list[list[int]]):
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a, b))
        self.a, self.b = (np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in ((a, self.n_a), (b, self.n_b)))
        a_ends, b_ends = np.cumsum(t.a_sizes[self.a]), np.cumsum(t.b_sizes[self.b])
        # texts end at the same byte in both, so the texts of a batch can be aligned as one
        marks = np.zeros(int(a_ends[-1]) + 1 if len(a_ends) else 1, np.uint8)
        marks[a_ends] = 1
        marks[b_ends] += 2
        cuts = np.flatnonzero(marks)
        of_a, of_b = (marks[cuts] & 1).astype(np.int64), (marks[cuts] >> 1).astype(np.int64)
        at_a, at_b = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b
        self.doc = np.repeat(np.arange(len(a)), self.n_a)[at_a]
        self.pair = self.a[at_a] * len(t.b_bytes) + self.b[at_b]
        self.n_links = np.bincount(self.doc, minlength=len(a))
        shared = (of_a & of_b).astype(bool)
        self.n_groups = np.bincount(self.doc[shared], minlength=len(a))
        self.last_a, self.last_b = at_a[shared], at_b[shared]  # each group's last tokens

    def group_digests(self, t: Tokenizers) -> list[str]:
        """SHA-256 of each text's groups as text; '' for a text without tokens."""
        names_a, names_b = t.names["a"][self.a], t.names["b"][self.b]
        names_a[self.last_a], names_b[self.last_b] = t.names["a_end"][self.a[self.last_a]], t.names["b_end"][self.b[self.last_b]]
        # in a group its tokens of A come first, then those of B
        group_a, group_b = np.searchsorted(self.last_a, np.arange(len(self.a))), np.searchsorted(self.last_b, np.arange(len(self.b)))
        before_a = np.concatenate(([-1], self.last_b))[group_a] + 1  # tokens of B in earlier groups
        spelt = np.empty(len(self.a) + len(self.b), object)
        spelt[np.arange(len(self.a)) + before_a] = names_a
        spelt[np.arange(len(self.b)) + self.last_a[group_b] + 1] = names_b
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        parts = ("".join(spelt[lo:hi].tolist())[:-1] for lo, hi in zip([0, *ends], ends))
        return [hashlib.sha256(p.encode()).hexdigest() if p else "" for p in parts]


def compressed(positions: np.ndarray, starts: np.ndarray, n_docs: int) -> tuple[pa.Array, np.ndarray]:
    """(bitmaps, their popcounts) of runs of ascending positions that begin at starts: 2 bytes a position, or, where
    that is longer than a bit a document, bits in whole bytes."""
    counts = np.diff(np.append(starts, len(positions)))
    dense = np.flatnonzero(counts * 2 > -(-n_docs // 8))
    sizes = counts * 2
    sizes[dense] = -(-n_docs // 8)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros(int(offsets[-1]), np.uint8)
    sparse = np.ones(len(positions), bool)
    for k in dense.tolist():  # each holds over a 16th of the block's documents
        sparse[starts[k] : starts[k] + counts[k]] = False
        bits = np.zeros(n_docs, np.uint8)
        bits[positions[starts[k] : starts[k] + counts[k]]] = 1
        out[offsets[k] : offsets[k + 1]] = np.packbits(bits, bitorder="little")
    kept = np.setdiff1d(np.arange(len(starts)), dense)
    owner = np.repeat(kept, counts[kept])
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts[kept]) - counts[kept], counts[kept])
    place = offsets[owner] + 2 * within
    held = positions[sparse].astype("<u2")
    out[place], out[place + 1] = held & 0xFF, held >> 8
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)]), counts


def positions_of(bits: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of all set bits of compressed bitmaps with those popcounts."""
    bits = bits.cast(pa.large_binary())
    offsets = np.frombuffer(bits.buffers()[1], np.int64)[bits.offset : bits.offset + len(bits) + 1]
    data = np.frombuffer(bits.buffers()[2], np.uint8) if bits.buffers()[2] is not None else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    dense = np.flatnonzero(sizes != 2 * counts)
    sparse = np.flatnonzero(sizes == 2 * counts)
    row = np.repeat(sparse, counts[sparse])
    within = np.arange(len(row)) - np.repeat(np.cumsum(counts[sparse]) - counts[sparse], counts[sparse])
    at = offsets[row] + 2 * within
    rows, found = [row], [data[at].astype(np.int64) | data[at + 1].astype(np.int64) << 8]
    for k in dense.tolist():
        set_bits = np.flatnonzero(np.unpackbits(data[offsets[k] : offsets[k + 1]], bitorder="little"))
        rows.append(np.full(len(set_bits), k))
        found.append(set_bits)
    return np.concatenate(rows), np.concatenate(found)


class _Block:
    """Links of the documents of one block, by pair and document with their number."""

    def __init__(self, number: int):
        self.number, self.docs, self.links, self.parts = number, 0, 0, []

    def add(self, x: Aligned) -> None:
        key, times = np.unique(x.pair * BLOCK_DOCS + (x.doc + self.docs), return_counts=True)
        self.parts.append((key, times))
        self.docs, self.links = self.docs + len(x.n_a), self.links + len(key)

    def postings(self) -> Iterator[list[pa.Array]]:
        """Columns pair, block, plane, n, bits."""
        if not self.links:
            return
        key, times = (np.concatenate(c) for c in zip(*self.parts))
        order = np.argsort(key, kind="stable")  # batches hold different documents, so OR-merging them is merging their lists
        key, more = key[order], times[order] - 1
        for plane in range(1 + int(more.max()).bit_length()):
            held = key if plane == 0 else key[more >> (plane - 1) & 1 == 1]
            if not len(held):
                continue
            pair = held // BLOCK_DOCS
            starts = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
            bits, counts = compressed(held % BLOCK_DOCS, starts, self.docs)
            n = len(starts)
            for at in range(0, n, 1 << 16):
                cut = slice(at, at + (1 << 16))
                m = len(starts[cut])
                yield [pa.array(pair[starts[cut]]), pa.array(np.full(m, self.number)), pa.array(np.full(m, plane)), pa.array(counts[cut]), bits[at : at + m]]


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, postings), held: rows (id, block, pos, n_a, n_b, n_groups, n_links, groups_sha256), and rows
    (pair, block, plane, n, bits) with pair = A's id * size of B's vocabulary + B's id."""
    spark = docs.sparkSession
    with open(a_path, "rb") as a_file, open(b_path, "rb") as b_file:
        files = spark.sparkContext.broadcast((a_file.read(), b_file.read()))  # under 3 MB for vocabularies of 50,000
    kind = dict(docs.dtypes)[id_col]
    doc_names, posting_names = ["id", *(f.split()[0] for f in DOC_FIELDS.split(", "))], ["pair", "block", "plane", "n", "bits"]
    id_type = docs.select(id_col).limit(0).toArrow().schema.field(0).type
    doc_type = pa.struct([("id", id_type), ("block", pa.int64()), ("pos", pa.int32()), *((c, pa.int64()) for c in doc_names[3:7]), ("groups_sha256", pa.string())])
    posting_type = pa.struct([("pair", pa.int64()), ("block", pa.int64()), ("plane", pa.int32()), ("n", pa.int64()), ("bits", pa.binary())])

    def rows(columns: list[pa.Array], kind: pa.DataType) -> pa.RecordBatch:
        """Rows with either of two structs, of documents or of postings; the other is null."""
        made = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, kind)], fields=list(kind))
        return pa.RecordBatch.from_arrays([made if kind is k else pa.nulls(len(made), k) for k in (doc_type, posting_type)], ["doc", "posting"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tokenizers.of(*files.value)
        next_block = TaskContext.get().partitionId() * _TASK_BLOCKS
        block = _Block(next_block)
        for whole in batches:
            texts = [x or "" for x in whole.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                stop, chars = at, 0
                while stop < len(texts) and stop - at < BLOCK_DOCS - block.docs and (chars == 0 or chars + len(texts[stop]) <= BATCH_CHARS):
                    chars += len(texts[stop])
                    stop += 1
                x = Aligned(t, *t.encode(texts[at:stop]))
                fields = [pa.array(np.full(stop - at, block.number)), pa.array(np.arange(block.docs, block.docs + stop - at, dtype=np.int32)), *(pa.array(c.astype(np.int64)) for c in (x.n_a, x.n_b, x.n_groups, x.n_links)), pa.array(x.group_digests(t), pa.string())]
                yield rows([whole.column(0).slice(at, stop - at), *fields], doc_type)
                block.add(x)
                at = stop
                if block.docs >= BLOCK_DOCS or block.links >= BLOCK_LINKS:
                    for found in block.postings():
                        yield rows(found, posting_type)
                    next_block += 1
                    block = _Block(next_block)
        for found in block.postings():
            yield rows(found, posting_type)

    schema = f"doc struct<id: {kind}, {DOC_FIELDS.replace(' ', ': ').replace(',:', ',')}>, posting struct<pair: long, block: long, plane: int, n: long, bits: binary>"
    made = hold(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema), "alignment")
    return made.filter("doc is not null").select(*(f"doc.{c}" for c in doc_names)), made.filter("posting is not null").select(*(f"posting.{c}" for c in posting_names))


def pair_counts(postings: DataFrame, b_size: int) -> DataFrame:
    """Rows (pair, docs, links, best): how many documents hold the pair, how many links it has, and whether no other
    pair of the same id of A is held by more documents."""
    links = F.expr("n * shiftleft(1L, greatest(plane - 1, 0))")
    counts = hold(postings.groupBy("pair").agg(F.sum(F.when(F.col("plane") == 0, F.col("n")).otherwise(0)).alias("docs"), F.sum(links).alias("links")), "pairs")
    a = F.expr(f"pair div {b_size}L")
    most = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))  # a row an id of A: as many as its vocabulary
    return counts.join(F.broadcast(most), a == F.col("a")).select("pair", "docs", "links", (F.col("docs") == F.col("most")).alias("best"))


def scores(postings: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows (block, pos, n_best, count_sum) of documents with links."""
    # never broadcast: pairs grow with the corpus
    counted = postings.join(counts.select("pair", "docs", "best").hint("merge"), "pair").select("block", "plane", "n", "bits", "docs", "best")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts of scores, of each block in turn."""
        for batch in batches:
            block, plane, n, docs, best = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 4, 5))
            row, pos = positions_of(batch.column(3), n)
            names, at = np.unique(block, return_inverse=True)
            place = at[row] * BLOCK_DOCS + pos
            weight = np.where(plane == 0, 1, 1 << np.maximum(plane - 1, 0)).astype(np.int64)
            spots, of = np.unique(place, return_inverse=True)
            sums, bests = np.zeros(len(spots), np.int64), np.zeros(len(spots), np.int64)
            np.add.at(sums, of, (weight * docs)[row])
            np.add.at(bests, of, (weight * best)[row])
            yield pa.RecordBatch.from_arrays([pa.array(names[spots // BLOCK_DOCS]), pa.array((spots % BLOCK_DOCS).astype(np.int32)), pa.array(bests), pa.array(sums)], ["block", "pos", "n_best", "count_sum"])

    # dealt out by block, so that a batch's postings share few documents and the partial sums are few
    dealt = counted.repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(score, "block long, pos int, n_best long, count_sum long").groupBy("block", "pos").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def b_vocabulary_size(b_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()


def alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows, postings = align(docs, a_path, b_path, id_col, text_col)
    found = scores(postings, pair_counts(postings, b_vocabulary_size(b_path)))
    none = F.lit(0).cast("long")
    return rows.join(found, ["block", "pos"], "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256"
    )
