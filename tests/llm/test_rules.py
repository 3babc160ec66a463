import re
from collections import Counter

from shotlake.llm import rules

from .conftest import SCHEMA, row

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {i + d for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_measures(spark, docs, odd_rows):
    texts = [r.text for r in docs.collect()] + [r[1] for r in odd_rows] + ["a a a a", "a b a b a b", "a b c", "x y z\nx y z\n\n \nx y z", "a b c d a b c", "w " * 30000]
    got = rules.measures(spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)).collect()
    for r in got:
        assert (r["__qr_words"], r["__qr_word_chars"], r["__qr_symbols"], r["__qr_dup_lines"], r["__qr_repeat_words"]) == brute(texts[r.doc_id])


def test_order_changes_no_verdict(spark, docs):
    tests = rules.rules()
    one = {r.doc_id: r["__qr_reason"] is None for r in rules.apply_rules(docs).collect()}
    other = {r.doc_id: r["__qr_reason"] is None for r in rules.apply_rules(docs, tests=dict(reversed(tests.items()))).collect()}
    assert one == other


def test_order_follows_the_sample_alone(spark, docs):
    """Reasons don't depend on a clock; a costly rule that rejects little comes late, equal worth keeps the listed order."""
    runs = [{r.doc_id: r["__qr_reason"] for r in rules.apply_rules(docs).collect()} for _ in range(2)]
    assert runs[0] == runs[1]
    text = " ".join(f"word{i}" for i in range(60))
    sample = rules.measures(spark.createDataFrame([row(i, text + (" !" * 20 if i < 3 else "")) for i in range(9)], SCHEMA))
    n = rules.F.col("__qr_words")
    tests = {"none": rules.Rule(n < 0), "dear": rules.Rule(n > 70, 3), "cheap": rules.Rule(n > 70), "never": rules.Rule(n < 0, 1)}
    assert rules.cascade_order(sample, tests) == ["cheap", "dear", "none", "never"]


def test_places_beyond_24_bits():
    """A place keeps all of its bits: an array holds fewer than 2^31 elements."""
    assert (1 << rules._PLACE_BITS) - 1 >= 2**31 - 1


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1")
    done = rules.apply_rules(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id")
    assert done.filter("not __qr_base_failed and __qr_reason is not null").count() == 0


def test_odd_rows(odd, none, odd_rows):
    assert rules.apply_rules(odd).count() == len(odd_rows)
    assert rules.apply_rules(none).count() == 0
