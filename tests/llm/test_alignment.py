import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from shotlake.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def brute(rows):
    """The contract's columns by loops over byte ranges. Bytes of A come from offsets' own decoder, token by token."""
    a_tok, b_tok = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True
    letters = alignment.byte_table()

    def ends(parts):
        return list(np.cumsum([len(x) for x in parts]))

    made = []
    for doc_id, text in rows:
        text = text or ""
        whole = (" " + text).encode()
        a = a_tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        a_bytes = [bytes(letters[c] for c in a_tok.id_to_token(i)) for i in a]
        pieces = [b_tok.id_to_piece(i) for i in b]
        b_bytes = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for p in pieces]
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            made.append((doc_id, [], [], [], ""))
            continue
        a_ends, b_ends = ends(a_bytes), ends(b_bytes)
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if max(a_ends[i] - len(a_bytes[i]), b_ends[j] - len(b_bytes[j])) < min(a_ends[i], b_ends[j])]
        groups, i, j = [], 0, 0
        for cut in sorted(set(a_ends) & set(b_ends)):
            x, y = a_ends.index(cut) + 1, b_ends.index(cut) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        made.append((doc_id, a, b, links, ";".join(groups)))
    counts = Counter(p for m in made for p in set(m[3]))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    for doc_id, a, b, links, groups in made:
        yield doc_id, len(a), len(b), groups.count(";") + bool(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(groups.encode()).hexdigest() if groups else ""


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in alignment.alignment(df, A, B).select(*COLUMNS).collect())))


def test_against_loops(spark, odd, odd_rows):
    short = [r for r in odd_rows if len(r[1] or "") < 5000]
    extra = [(900, "<|endoftext|> and </s> are plain"), (901, "two  blanks\tand\ttabs"), (902, "ﬁ ligature ① full width Ａ"), (903, "naïve 日本語 😀 ▁ mark"), (904, " leading"), (905, "x"), (906, "日本語と😀")]
    rows = [(r[0], r[1]) for r in short] + extra
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = sorted(map(repr, brute(rows)))
    assert rows_of(df.repartition(3)) == expected == rows_of(df.coalesce(1))
    assert sum("''" in r for r in expected) < len(rows) - 20  # most texts have tokens


def test_given_documents(spark, docs):
    some = [(r.doc_id, r.text) for r in docs.filter("n_chars < 1500").collect()]
    assert len(some) > 30
    assert rows_of(spark.createDataFrame(some, "doc_id long, text string").repartition(4)) == sorted(map(repr, brute(some)))


def test_batches_change_nothing(docs):
    x = docs.filter("n_chars < 3000").select("doc_id", "text")
    t = alignment.Tokenizers.of(open(A, "rb").read(), open(B, "rb").read())
    texts = [r.text or "" for r in x.collect()]
    whole = alignment.Aligned(t, *t.encode(texts))
    parts = []
    for at in range(0, len(texts), 10):
        part = alignment.Aligned(t, *t.encode(texts[at : at + 10]))
        parts += part.group_digests(t)
    assert parts == whole.group_digests(t)


def test_long_texts_and_clashing_columns(spark, odd, odd_rows):
    found = {r[0]: r for r in alignment.alignment(odd, A, B).collect()}
    assert found[4].n_links >= max(found[4].n_a, found[4].n_b) > 10_000  # the long text
    assert len(odd_rows) == alignment.alignment(odd, A, B).count()


@pytest.mark.parametrize("n_docs", [1, 9, 64, 8192])
def test_compressed_bitmaps_round_trip(n_docs):
    rng = np.random.default_rng(n_docs)
    lists = [np.flatnonzero(rng.random(n_docs) < p) for p in (0.001, 0.05, 0.5, 1.0)]
    lists = [x for x in lists if len(x)]
    starts = np.cumsum([0, *map(len, lists)])[:-1]
    bits, counts = alignment.compressed(np.concatenate(lists), starts, n_docs)
    assert counts.tolist() == [len(x) for x in lists]
    for array in (bits, bits.cast(pa.binary()), pa.concat_arrays([bits, bits])[len(bits) :]):
        row, pos = alignment.positions_of(array, counts)
        assert sorted(zip(row.tolist(), pos.tolist())) == [(k, p) for k, x in enumerate(lists) for p in x.tolist()]


def test_planes_count_links(spark):
    rows = [(1, "ha ha ha ha ha"), (2, "ha"), (3, "ha ha")]
    _, postings = alignment.align(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), A, B)
    counts = alignment.pair_counts(postings, alignment.b_vocabulary_size(B)).collect()
    assert max(c.links for c in counts) == 8 and max(c.docs for c in counts) == 3 and max(r.plane for r in postings.collect()) == 3


def test_no_rows(spark, none):
    assert alignment.alignment(none, A, B).collect() == []


def test_encoder_by_ranks_agrees_with_the_files_library(docs):
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    t = alignment.Tokenizers.of(open(A, "rb").read(), open(B, "rb").read())
    texts = [" " + r.text for r in docs.collect() if r.text]
    for lo in range(0, 0x110000, 512):  # every code point beside letters, digits, signs and blanks
        texts += [f" a{c}1{c} {c}." for c in map(chr, range(lo, lo + 512)) if not "\ud800" <= c <= "\udfff"]
    for at in range(0, len(texts), 10_000):
        part = texts[at : at + 10_000]
        assert [x.ids for x in a.encode_batch(part, add_special_tokens=False)] == list(map(t.fast_a, part))


def test_other_tokenizers_keep_their_library():
    told = {"model": {"type": "BPE", "vocab": {"a": 0}, "merges": []}, "pre_tokenizer": {"type": "ByteLevel", "use_regex": True}, "normalizer": None}
    assert alignment.by_ranks(told, [b"a"]) is None and alignment.by_ranks({**told, "normalizer": {"type": "Lowercase"}}, [b"a"]) is None
