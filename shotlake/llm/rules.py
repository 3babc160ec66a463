"""Quality rules as a short-circuit cascade, in DataFrame operations only.

Measures that the contract asks of every row are taken once a row. The further rules run as one conditional
expression that stops at the first rule that rejects, so that what a later rule alone has to read (a pass over the
text) is read only for rows that got there. A sample of bounded size gives each rule's rejections and its cost there:
the characters that it reads, times what its way of reading costs a character. Rules run in the order of rejections
per cost. No clock is involved, so reruns over the same rows name the same reasons; the order never changes a verdict.

Edge cases: null and empty texts have no words and fail the base rule; a table without rows is sampled as nothing and
gives no rows; rules of equal worth keep the listed order. Columns named __qr_* are the operator's own; others are kept.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

MIN_WORDS, SAMPLE_ROWS = 50, 2000
SYMBOLS, BLANKS = "[#*$%&|<>]", r"[\x20\x09-\x0D]+"
#: Bits of a window's place; an array holds fewer than 2^31 elements, so that any place fits.
_PLACE_BITS = 31
#: Nanoseconds a row for comparing measures, and a character for a pass of a pattern over the text (measured once).
ROW_COST, PASS_COST = 50.0, 8.0


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with __qr_text, __qr_lines (all lines), __qr_words, __qr_word_chars, __qr_symbols, __qr_dup_lines and
    __qr_repeat_words (all long).

    Words are hashed, then windows of three hashes. Only where a window's hash comes twice are windows sorted, one
    long each: the upper bits of the hash, then its place. Neighbours of equal upper bits are sorted once more by
    their whole hash; a word counts if a repeated window covers it, which is the sum of min(3, distance to the next
    one's start).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.withColumn("__qr_text", text).withColumn("__qr_w", F.array_remove(F.split("__qr_text", BLANKS), ""))
    n = F.size("__qr_w")
    none = F.array().cast("array<bigint>")
    hashed = split.withColumn("__qr_x", F.transform("__qr_w", lambda w: F.xxhash64(w)))
    pairs = F.zip_with("__qr_x", F.slice("__qr_x", F.lit(2), n), lambda a, b: F.xxhash64(a, b))  # ends are cut off below
    triples = F.slice(F.zip_with(pairs, F.slice("__qr_x", F.lit(3), n), lambda a, b: F.xxhash64(a, b)), F.lit(1), n - 2)
    windows = hashed.withColumn("__qr_h", F.when(n >= 3, triples).otherwise(none))
    mask = (1 << _PLACE_BITS) - 1
    packed = F.transform("__qr_h", lambda h, i: h.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("bigint")))
    ordered = windows.withColumn("__qr_s", F.when(F.size(F.array_distinct("__qr_h")) < F.size("__qr_h"), F.sort_array(packed)).otherwise(none))
    place = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")
    # neighbours whose upper bits are equal; the last one's neighbour is null
    near = F.zip_with("__qr_s", F.slice("__qr_s", F.lit(2), F.size("__qr_s")), lambda a, b: F.when(F.shiftrightunsigned(a.bitwiseXOR(b), _PLACE_BITS) == 0, F.struct(a.alias("a"), b.alias("b"))))
    likely = ordered.withColumn("__qr_n", F.array_compact(near)).withColumn("__qr_c", F.array_distinct(F.concat(F.col("__qr_n.a"), F.col("__qr_n.b"))))
    exact = F.array_sort(F.transform("__qr_c", lambda x: F.struct(F.get("__qr_h", place(x)).alias("h"), place(x).alias("i"))))
    sorted_ = likely.withColumn("__qr_e", exact)
    twice = F.filter("__qr_e", lambda x, i: F.coalesce(F.get("__qr_e", i + 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("__qr_e", i - 1)["h"] == x["h"], F.lit(False)))
    places = sorted_.withColumn("__qr_p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.transform("__qr_p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("__qr_p", i + 1) - p, F.lit(3)))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    done = (
        places.withColumn("__qr_words", n.cast("long"))
        .withColumn("__qr_word_chars", F.length(F.array_join("__qr_w", "")).cast("long"))
        .withColumn("__qr_symbols", _count(SYMBOLS))
        .withColumn("__qr_repeat_words", covered)
        .withColumn("__qr_all", F.split("__qr_text", "\n"))
        .withColumn("__qr_lines", F.size("__qr_all").cast("long"))
        .withColumn("__qr_l", F.filter("__qr_all", lambda x: x.rlike(WORD)))
        .withColumn("__qr_dup_lines", (F.size("__qr_l") - F.size(F.array_distinct("__qr_l"))).cast("long"))
        .drop("__qr_w", "__qr_x", "__qr_h", "__qr_s", "__qr_n", "__qr_c", "__qr_e", "__qr_p", "__qr_all", "__qr_l")
    )
    # observe() keeps a later filter on the measures above them; pushed below, it would compute each of them again
    return done.observe(f"measured-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def base_failed() -> Column:
    return (F.col("__qr_words") < MIN_WORDS) | (F.col("__qr_repeat_words") * 100 > F.col("__qr_words") * 50)


def _count(pattern: str) -> Column:
    return F.regexp_count("__qr_text", F.lit(pattern)).cast("long")


class Rule(NamedTuple):
    """rejects is true for rows to reject; it reads the measures, and __qr_text in so many passes."""

    rejects: Column
    passes: int = 0


def rules() -> dict[str, Rule]:
    """The further rules, in the order that settles ties."""
    n, lines, chars = F.col("__qr_words"), F.col("__qr_lines"), F.col("__qr_word_chars")
    return {
        "symbols": Rule(F.col("__qr_symbols") * 10 > n * 3),
        "word_length": Rule(~(chars / F.nullif(n, F.lit(0))).between(2.0, 15.0)),
        "dup_lines": Rule((F.col("__qr_dup_lines") >= 5) & (F.col("__qr_dup_lines") * 2 > lines)),
        "shouting": Rule(_count("[A-Z]") * 2 > chars, 1),
        "exclamations": Rule(_count("[!?]") * 5 > n, 1),
        "digits": Rule(_count("[0-9]") * 4 > chars, 1),
        "bullets": Rule(_count(r"(?m)^[\x20\t]*[-*•][\x20\t]") * 10 > lines * 9, 1),
        "ellipses": Rule(_count(r"(?m)(?:\.\.\.|…)$") * 10 > lines * 3, 1),
    }


def cascade_order(sample: DataFrame, tests: dict[str, Rule]) -> list[str]:
    """Rule names by rejections per cost on a measured sample, in one aggregation over it."""
    counts = {k: F.count_if(F.coalesce(t.rejects, F.lit(False))) for k, t in tests.items()}
    costs = {k: F.sum(F.lit(ROW_COST) + F.lit(PASS_COST * t.passes) * F.length("__qr_text")) for k, t in tests.items()}
    got = sample.agg(*[c.alias(f"n{i}") for i, c in enumerate(counts.values())], *[F.round(c).alias(f"c{i}") for i, c in enumerate(costs.values())]).first()
    worth = {k: got[f"n{i}"] / max(1.0, got[f"c{i}"] or 0.0) for i, k in enumerate(tests)}
    return sorted(tests, key=lambda k: -worth[k])


def apply_rules(docs: DataFrame, text_col: str = "text", tests: dict[str, Rule] | None = None, id_col: str = "doc_id") -> DataFrame:
    """docs with the __qr_ measures, __qr_base_failed, and __qr_reason: the first rule that rejects, or null."""
    tests = rules() if tests is None else tests
    total = docs.select(F.lit(1)).count()
    share = min(1.0, SAMPLE_ROWS / max(1, total))
    # about SAMPLE_ROWS rows, chosen by a hash of id and text, so that copies of one text aren't taken all together
    sample = docs.filter(F.pmod(F.xxhash64(*[c for c in (id_col, text_col) if c in docs.columns]), F.lit(1 << 30)) < int(share * (1 << 30)))
    order = cascade_order(measures(sample.select(text_col), text_col).filter(~base_failed()), tests)
    reason = F.when(F.col("__qr_base_failed"), F.lit("base"))
    for name in order:
        reason = reason.when(tests[name].rejects, F.lit(name))
    return measures(docs, text_col).withColumn("__qr_base_failed", base_failed()).withColumn("__qr_reason", reason).drop("__qr_text", "__qr_lines")
