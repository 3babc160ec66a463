"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is halved until a part is short; parts are encoded, and neighbours are joined by encoding a window around
their border again. The window grows until each side reaches a place that no token can cross: a visible character
followed by a blank. No match of the pattern holds a blank after a visible character, and the pattern's only look
ahead is after blanks, so such a place is a border of matches in the halves and in the whole alike, and all tokens
outside the window stay as they are. Decoding joins the tokens' bytes up the same kind of tree. This holds for the
pattern below; another one is refused, since nothing shows where its matches may be cut.

Edge cases: a null text is empty and has no tokens; a text without any blank is encoded in one window. Columns
other than the id and the text are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Characters of a part that is encoded at once (and tokens decoded at once), and of the first window.
LEAF, WINDOW = 1024, 48
# Fixed value: the pattern of the vocabulary, for which cuts between a visible character and a blank are proved.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_codecs: dict[tuple[int, str], Codec] = {}


class Codec:
    """Ranks and pattern, made once in each Python worker."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        if pattern != PATTERN:
            raise ValueError("texts can be cut for this pattern only: " + PATTERN)
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encode = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.bytes = {i: b for b, i in table.items()}

    @staticmethod
    def of(ranks: bytes, pattern: str) -> Codec:
        key = (hash(ranks), pattern)
        if key not in _codecs:
            _codecs[key] = Codec(ranks, pattern)
        return _codecs[key]


def _fixed(text: str, at: int) -> bool:
    """No match of the pattern can cross this place."""
    return text[at] in " \n" and not text[at - 1].isspace()


def _tokens(codec: Codec, ids, n_bytes: int) -> int:
    """How many of ids make up exactly n_bytes bytes."""
    k = 0
    for i in ids:
        if n_bytes <= 0:
            break
        n_bytes -= len(codec.bytes[i])
        k += 1
    return k


def _join(codec: Codec, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
    """Tokens of text[lo:hi] from those of its parts before and after mid."""
    a, seen, step = None, mid, WINDOW
    while a is None:
        start = max(lo, seen - step)
        a = next((p for p in range(seen - 1, start, -1) if _fixed(text, p)), lo if start == lo else None)
        seen, step = start + 1, step * 2
    b, seen, step = None, mid + 1, WINDOW
    while b is None:
        stop = min(hi, seen + step)
        b = next((p for p in range(seen, stop) if _fixed(text, p)), hi if stop == hi else None)
        seen, step = stop, step * 2
    keep = len(left) - _tokens(codec, reversed(left), len(text[a:mid].encode()))
    skip = _tokens(codec, right, len(text[mid:b].encode()))
    return left[:keep] + codec.encode(text[a:b]) + right[skip:]


def encode_tree(codec: Codec, text: str, lo: int = 0, hi: int | None = None, leaf: int = LEAF) -> list[int]:
    hi = len(text) if hi is None else hi
    if hi - lo <= leaf:
        return codec.encode(text[lo:hi])
    mid = (lo + hi) // 2
    return _join(codec, text, lo, mid, hi, encode_tree(codec, text, lo, mid, leaf), encode_tree(codec, text, mid, hi, leaf))


def decode_tree(codec: Codec, ids: list[int], leaf: int = LEAF) -> bytes:
    if len(ids) <= leaf:
        return b"".join(map(codec.bytes.__getitem__, ids))
    mid = len(ids) // 2
    return decode_tree(codec, ids[:mid], leaf) + decode_tree(codec, ids[mid:], leaf)


def read_ranks(path: str) -> bytes:
    """The vocabulary file, read by the driver and shipped with the tasks: under a megabyte."""
    with open(path, "rb") as file:
        return file.read()


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, *keep, ids array<int>, decoded binary): each text's tokens, and the bytes that they decode to."""
    if pattern != PATTERN:
        raise ValueError("texts can be cut for this pattern only: " + PATTERN)
    small_batches(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # a worker may come from another job
        codec = Codec.of(ranks.value, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                ids = [encode_tree(codec, x or "") for x in batch.column(1).to_pylist()]
                back = [decode_tree(codec, x) for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.binary())], [id_col, *keep, "ids", "decoded"])

    kinds = dict(docs.dtypes)
    return docs.select(id_col, F.col(text_col).cast("string").alias("__text"), *keep).mapInArrow(run, ", ".join([f"`{k}` {kinds[k]}" for k in (id_col, *keep)] + ["ids array<int>", "decoded binary"]))
