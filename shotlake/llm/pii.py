"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Emails, addresses, card and phone numbers that match a strict form are seeds. The words around a seed make lexical
patterns ("w2 w1 _" and "w1 _ r1", with the class of the token in the slot). Candidates are tokens of the same
coarse classes that miss the strict forms. Patterns and instances make a graph that is scored in rounds: a
pattern's confidence is the sum of its instances' scores over their number plus one, if at least MIN_SEEDS of them
are seeds or were accepted in an earlier round; an instance's score is that of a seed (1), or 1 - the product of (1 - confidence) over its
patterns. Instances that end at ACCEPT or above are new identifiers and each of their places is added.

Places in a text are running sums over the pieces between matches, taken in blocks; overlaps are found in one sorted
array. So the work for one text grows in proportion to its matches (times a block's size, and a sort).

Edge cases: a null or empty text has no spans; positions are code points from 0, ends exclusive; matches are taken
leftmost and do not overlap within a kind; spans of different kinds may; rows that repeat are treated one by one;
an empty table gives no rows. Only the id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hold

KINDS = ("email", "ip", "card", "phone")
PLACES = "array<struct<value:string,start:int,end:int,before:string,after:string>>"
#: The strict forms. Possessive loops and the look-behind change no match; they keep long runs linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A token of the coarse classes: groups of digits with single blanks, dots or hyphens and brackets between them, or at
#: least six of the characters listed last, with a digit or an at sign among them.
TOKEN = r"(?<![A-Za-z0-9@._+(-])(?:\(?[0-9]++(?:\)?+[\x20.-]?+\(?+[0-9]++)++(?![A-Za-z0-9@_+-])|(?=[A-Za-z._+-]*+[0-9@])[A-Za-z0-9@._+-]{6,}+)"
CONTEXT, WORD_CHARS, BLOCK = 40, 20, 64
ROUNDS, MIN_SEEDS, ACCEPT, MIN_CONFIDENCE = 3, 3, 0.7, 0.3


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value taken once, however often body names it, inside other functions too."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each whole number of an array what op makes of those before it, from 0 on. Lists grow within blocks and by
    the block, not by the number."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("got"))

    def scan(items: Column, value: Callable[[Column], Column]) -> Column:
        return F.aggregate(items, start, lambda acc, x: F.struct(op(acc["at"], value(x)).alias("at"), F.concat(acc["got"], F.array(acc["at"])).alias("got")))

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / BLOCK).cast("int")), lambda b: scan(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)), lambda x: x))
        return _let(blocks, lambda bs: F.flatten(F.zip_with(bs, scan(bs, lambda x: x["at"])["got"], lambda b, o: F.transform(b["got"], lambda x: op(o, x)))))

    return _let(values, whole)


def _places(text: Column, pattern: str, valid: Callable[[Column], Column]) -> Column:
    """array<struct<value, start, end, before, after>> of the matches that are valid, in order, with the text around
    each: CONTEXT characters, fewer only where matches stand close together."""

    def made(found: Column, pieces: Column, sums: Column) -> Column:
        piece, value = (lambda i: F.coalesce(F.get(pieces, i), F.lit(""))), (lambda i: F.coalesce(F.get(found, i), F.lit("")))
        last, first = (lambda x: F.right(x, F.lit(CONTEXT))), (lambda x: F.left(x, F.lit(CONTEXT)))
        before = lambda i: last(F.concat(last(piece(i - 2)), value(i - 2), last(piece(i - 1)), value(i - 1), last(piece(i))))
        after = lambda i: first(F.concat(first(piece(i + 1)), value(i + 1), first(piece(i + 2))))
        start = lambda i: F.get(sums, i) + F.length(piece(i))
        good = F.filter(F.transform(found, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda x: valid(x["v"]))
        return F.transform(good, lambda x: F.struct(x["v"].alias("value"), start(x["i"]).alias("start"), (start(x["i"]) + F.length(x["v"])).alias("end"), before(x["i"]).alias("before"), after(x["i"]).alias("after")))

    def split(found: Column) -> Column:
        return _let(F.split(text, pattern, -1), lambda pieces: _let(running(F.transform(found, lambda v, i: F.length(v) + F.length(F.get(pieces, i))), lambda a, b: a + b), lambda sums: made(found, pieces, sums)))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.exists(found, valid), split(found)).otherwise(F.array().cast(PLACES)))


def _ip_part(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+", "")
    return (F.length(short) < 3) | ((F.length(short) == 3) & (short <= "255"))


def _luhn(digits: Column) -> Column:
    """Luhn check of 16 to 19 digits."""

    def value(i: Column, text: Column) -> Column:
        d = F.ascii(F.substring(text, i + 1, F.lit(1))) - 48
        twice = F.when(F.pmod(F.length(text) - i, F.lit(2)) == 0, d * 2).otherwise(d)
        return twice - F.when(twice > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, i: acc + value(i, digits)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), _ip_part)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    digits = F.translate(value, " -", "")
    return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind, the places of the strict matches."""
    none = F.array().cast(PLACES)
    digit = text.rlike("[0-9]")
    may = {"email": F.contains(text, F.lit("@")), "ip": digit & F.contains(text, F.lit(".")), "card": digit, "phone": F.contains(text, F.lit("+"))}
    forms = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}

    def strict(kind: str) -> Column:
        return F.when(may[kind], _places(text, forms[kind], lambda v: _valid(kind, v))).otherwise(none)

    return {k: strict(k) for k in KINDS}


def _class(value: Column) -> Column:
    """The kind whose coarse class a token is of, or null."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    dots = F.length(value) - F.length(F.translate(value, ".", ""))
    numeric = ~value.rlike("[A-Za-z_@]")
    return F.when(F.contains(value, F.lit("@")), "email").when(numeric & (dots >= 3), "ip").when(numeric & (digits >= 13), "card").when(numeric & (digits >= 7), "phone")


def _contexts(before: Column, after: Column, kind: Column) -> Column:
    """Hashes of the two patterns around a place."""
    trim = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
    words = lambda x: F.split(F.lower(F.regexp_replace(x, trim, "")), r"[\x20\x09-\x0D]+")
    cut = lambda x: F.right(F.coalesce(x, F.lit("")), F.lit(WORD_CHARS))
    left, right = words(before), words(after)
    w1, w2 = cut(F.try_element_at(left, F.lit(-1))), cut(F.try_element_at(left, F.lit(-2)))
    r1 = F.left(F.coalesce(F.get(right, F.lit(0)), F.lit("")), F.lit(WORD_CHARS))
    return F.array(F.xxhash64(F.lit("l2"), kind, w2, w1), F.xxhash64(F.lit("lr"), kind, w1, r1))


def _free(tokens: Column, base: Column) -> Column:
    """The tokens that no base span overlaps; both are arrays of (start, token, end, ...), tokens in order and apart.

    In order of their starts a span overlaps a token if the farthest end before the token is beyond its start, or if
    the next one is a span that starts before its end."""

    def apart(both: Column) -> Column:
        ends = running(F.transform(both, lambda x: F.when(x["token"], F.lit(0)).otherwise(x["end"])), lambda a, b: F.greatest(a, b))
        following = lambda i: F.get(both, i + 1)
        return _let(ends, lambda e: F.filter(both, lambda x, i: x["token"] & (F.get(e, i) <= x["start"]) & F.coalesce(following(i)["token"] | (following(i)["start"] >= x["end"]), F.lit(True))))

    return _let(F.array_sort(F.concat(base, tokens)), apart)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Held rows (uid, id, base, seen): base spans by kind, and seeds and candidates with their patterns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = docs.select(F.col(id_col), text.alias("__text"))
    spans = base_spans(F.col("__text"))
    with_base = first.select(id_col, "__text", *[spans[k].alias(k) for k in KINDS])

    def listed(places: Column, kind: Callable[[Column], Column], token: bool) -> Column:
        return F.transform(places, lambda x: F.struct(x["start"].alias("start"), F.lit(token).alias("token"), x["end"].alias("end"), kind(x).alias("kind"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after")))

    base = F.concat(*[listed(F.col(k), lambda x, k=k: F.lit(k), False) for k in KINDS])
    tokens = listed(_places(F.col("__text"), TOKEN, lambda v: _class(v).isNotNull()), lambda x: _class(x["value"]), True)
    free = F.when(F.col("__text").rlike("[0-9@]"), _let(tokens, lambda t: F.when((F.size(t) > 0) & (F.size("base") > 0), _free(t, F.col("base"))).otherwise(t)))
    candidates = with_base.select(id_col, "__text", base.alias("base")).select(id_col, "base", free.alias("free"))
    both = F.concat("base", F.coalesce("free", F.slice("base", 1, 0)))
    seen = F.transform(both, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.xxhash64(x["kind"], F.lower(x["value"])).alias("node"), (~x["token"]).alias("seed"), _contexts(x["before"], x["after"], x["kind"]).alias("patterns")))
    plain = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return hold(candidates.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col), plain.alias("base"), seen.alias("seen")), "pii")


def discovered(scanned: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, accept: float = ACCEPT) -> DataFrame:
    """Rows (node): instances that are no seeds and that the pattern graph accepts."""
    edges = hold(
        scanned.select(F.explode("seen").alias("s")).select("s.node", "s.seed", F.explode("s.patterns").alias("pattern")).groupBy("pattern", "node").agg(F.max("seed").alias("seed")),
        "pii-edges",
    )
    # a pattern of fewer instances can never count, and one of seeds alone adds nothing
    useful = edges.groupBy("pattern").agg(F.sum(F.col("seed").cast("long")).alias("seeds"), F.count("*").alias("n")).filter((F.col("n") >= min_seeds) & (F.col("n") > F.col("seeds")))
    edges = hold(edges.join(useful.select("pattern"), "pattern", "left_semi"), "pii-graph")
    scores = None
    for _ in range(rounds):
        if scores is None:
            scored = edges.withColumn("score", F.col("seed").cast("double"))
        else:
            scored = edges.join(scores, "node", "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("found", F.lit(0.0))))
        known = F.sum((F.col("score") >= accept).cast("long"))  # seeds, and what earlier rounds accepted
        confidence = scored.groupBy("pattern").agg((F.sum("score") / (F.count("*") + 1)).alias("confidence"), known.alias("known")).filter((F.col("confidence") >= MIN_CONFIDENCE) & (F.col("known") >= min_seeds)).drop("known")
        missed = F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999999))))
        scores = hold(edges.filter("not seed").join(confidence, "pattern").groupBy("node").agg((1 - F.exp(missed)).alias("found")), "pii-scores")
    return scores.filter(F.col("found") >= accept).select("node")


def _written(spans: Column) -> Column:
    """kind:start:end by kind as listed, then start, comma-joined."""
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(F.array_position(order, x["kind"]).alias("k"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows (id, base, added) for each row of docs: arrays of (kind, start, end)."""
    scanned = scan(docs, id_col, text_col)
    new = hold(discovered(scanned, **options), "pii-new")
    places = scanned.select("uid", F.explode(F.filter("seen", lambda x: ~x["seed"])).alias("s")).select("uid", F.col("s.node").alias("node"), F.struct("s.kind", "s.start", "s.end").alias("span"))
    added = places.join(new, "node", "left_semi").groupBy("uid").agg(F.collect_list("span").alias("added"))
    return scanned.select("uid", id_col, "base").join(added, "uid", "left").select(id_col, "base", F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("added"))


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select(id_col, *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.concat("base", "added")).alias("spans"))
