import random

import public_tokenizers
import pytest
import regex
import tiktoken

from shotlake.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec.of(bpe.read_ranks(PATH), public_tokenizers.PATTERN)


def test_tree_equals_whole(codec):
    rng = random.Random(4)
    pieces = ["word", " ", "  ", "\n", "\n\n", "\t", "'s", "'ll", "é", "ß", "😀", "123", " 45", "!!", "...", "\u3000", "\xa0", "\x1c", "\u2028", "xyz", " the", "\r\n"]
    for _ in range(300):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 120)))
        ids = bpe.encode_tree(codec, text, leaf=rng.choice([1, 2, 3, 8, 20]))
        assert ids == codec.encode(text), text
        assert bpe.decode_tree(codec, ids, leaf=2) == text.encode()
    blank_free = "ab" * 3000
    assert bpe.encode_tree(codec, blank_free, leaf=100) == codec.encode(blank_free)


def test_like_the_library(codec, docs):
    ranks = {bpe.base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in docs.limit(40).collect():
        assert bpe.encode_tree(codec, r.text, leaf=64) == other.encode_ordinary(r.text)


def plain_bpe(table, text):
    """Byte-pair encoding by its definition: in each match of the pattern the pair of least rank is joined first."""
    out = []
    for m in regex.finditer(public_tokenizers.PATTERN, text):
        parts = [bytes([b]) for b in m[0].encode()]
        while len(parts) > 1:
            rank, i = min((table.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 40:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out += [table[x] for x in parts]
    return out


def test_like_plain_merges(codec, docs):
    table = {b: i for i, b in codec.bytes.items()}
    texts = [r.text for r in docs.collect()]
    assert sum(len(t) > bpe.LEAF for t in texts) > len(texts) / 5  # ordinary texts are cut and joined
    for t in texts:
        if len(t) < 20_000:
            assert bpe.encode_tree(codec, t) == plain_bpe(table, t)


def test_other_patterns_are_refused(docs):
    with pytest.raises(ValueError):
        bpe.encode_decode(docs, PATH, r"\S+|\s+")


def test_odd_rows(odd, none, odd_rows):
    rows = bpe.encode_decode(odd, PATH, public_tokenizers.PATTERN).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in rows) == sorted((str(r[0]), (r[1] or "").encode()) for r in odd_rows)
    assert bpe.encode_decode(none, PATH, public_tokenizers.PATTERN).count() == 0


def test_query(spark, sf_dir, docs):
    assert queries.op5_byte_bpe(spark, sf_dir).count() == docs.count()


def test_batches_of_texts_are_bounded(spark, docs):
    """Batches as Spark makes them by itself, of 10,000 rows, take some hundred MB of an executor."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    try:
        for given, left in (("10000", "1000"), ("0", "1000"), ("50", "50")):
            spark.conf.set(setting, given)
            bpe.encode_decode(docs, PATH, public_tokenizers.PATTERN)
            assert spark.conf.get(setting) == left
    finally:
        spark.conf.set(setting, before)
