import hashlib
import re

import numpy as np

from shotlake.llm import imatch, queries


def test_digests_and_neighbours(spark, sf_dir, docs):
    rows = {r.doc_id: r for r in queries.op3_imatch(spark, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    order = sorted(texts)
    for k, following in zip(order, order[1:] + order[:1]):
        half = len(texts[k]) // 2
        edited = texts[k][: len(texts[k]) - half] + texts[following][:half]
        assert rows[k].n_chars == len(texts[k]) and rows[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[k].near_next <= 1 and 0 <= rows[k].near_edited <= 1
    by_text = {}
    for k, t in texts.items():
        assert by_text.setdefault(t, rows[k].fingerprint) == rows[k].fingerprint
    assert np.mean([r.near_edited for r in rows.values()]) > 0.1 > 5 * np.mean([r.near_next for r in rows.values()])


def test_lexicon_is_the_band(spark):
    docs = spark.createDataFrame([(i, f"common word{i % 10} only{i}") for i in range(200)], "doc_id long, text string")
    bits, n = imatch.lexicon(docs)
    held = np.frombuffer(bits, np.uint8)

    def inside(term):
        b = int(imatch.term_hashes(term)[0]) & ((1 << imatch.BITS) - 1)
        return bool(held[b >> 3] >> (b & 7) & 1)

    assert n == 200 and not inside("common") and inside("only7") and not inside("word3") and not inside("absent")


def test_likeness():
    full = np.full(1 << imatch.BITS >> 3, 255, np.uint8)
    text = " ".join(f"t{i}" for i in range(300))
    a, b, c = (imatch.fingerprint(t, full) for t in (text, text + " more", " ".join(f"u{i}" for i in range(300))))
    assert imatch.likeness(a, a) == 1 and imatch.likeness(a, b) > 0.8 > 0.05 > imatch.likeness(a, c)
    assert imatch.likeness(imatch.fingerprint("", full), imatch.fingerprint("", full)) == 1


def test_odd_rows(odd, none, odd_rows):
    rows = imatch.edited_fingerprints(odd).collect()
    assert len(rows) == len(odd_rows)
    assert imatch.edited_fingerprints(none).count() == 0
    one = imatch.edited_fingerprints(odd.filter("doc_id = 4")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


M64 = (1 << 64) - 1


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


def plain_fingerprints(texts, low=3.0, high=16.0):
    """I-Match by its definition, with dictionaries and whole numbers: frequencies by bucket, terms in the band, and a
    hash of the sorted ones in each subset."""
    import math
    from collections import Counter

    import xxhash

    terms = [{xxhash.xxh64_intdigest(w) for w in re.findall(rb"[^ \t\n\v\f\r]+", t.encode().lower())} for t in texts]
    df = Counter(b for t in terms for b in {h % (1 << imatch.BITS) for h in t})
    held = {b for b, n in df.items() if (len(texts) + 1) / math.exp(high) <= n <= max(1, (len(texts) + 1) / math.exp(low))}
    for t in terms:
        kept = sorted(h for h in t if h % (1 << imatch.BITS) in held)
        subsets = [kept] + [[h for h in kept if mixed(h ^ mixed(((c + 1) * 0x9E3779B97F4A7C15) & M64)) < 1 << (64 - level)] for level in imatch.LEVELS for c in range(imatch.COPIES)]
        yield "".join(f"{max(1, xxhash.xxh64_intdigest(b''.join(h.to_bytes(8, 'little') for h in s)) >> 48) if s else 0:04x}" for s in subsets)


def test_like_a_plain_i_match(spark, sf_dir, docs):
    rows = {r.doc_id: r.fingerprint for r in queries.op3_imatch(spark, sf_dir).collect()}
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    for (k, _), want in zip(texts, plain_fingerprints([t for _, t in texts])):
        assert rows[k] == want


def test_ranges_keep_growing():
    sizes = [imatch._ranges(n, 48) for n in (10**3, 10**6, 2 * 10**7, 10**8, 10**9, 5 * 10**10)]
    assert sizes == sorted(set(sizes)) and sizes[1] == 1000


def test_hot_and_largest_ids(spark):
    """A null id isn't the largest id, and rows of one id are dealt by their texts."""
    rows = [((1 << 63) - 1, "the very last id"), (None, "no id at all"), (-(1 << 63), "the first of them"), *((None, f"other text {i}") for i in range(3000)), *((7, f"some text {i}") for i in range(3000))]
    got = imatch.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    edited = lambda a, b: hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest()
    last = next(r for r in got if r.doc_id == (1 << 63) - 1)
    assert last.edited_sha256 in {edited("the very last id", t) for k, t in rows if k is None}
    sent = imatch._neighbours(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", len(rows))
    assert sent.filter("own").groupBy("part").count().agg({"count": "max"}).first()[0] < 1200
