"""URL filters, in DataFrame operations only.

Two lists meet each url: rules (host, path, verdict), which fit a host with its subdomains and any path that starts
with theirs, and listed canonical urls, which are blocked. Every key under which a list could hold a url is made in
its row, a blocked Bloom filter of all listed keys (one 64-bit block for a key, four bits in it) passes the possible
hits, and an exact hash join of these with the lists removes false positives. The longest rule wins; without a rule a
listed url is blocked and any other allowed. Rows are not regrouped: only urls that a list holds are joined back.

The filter grows with the lists: at most KEYS_A_BLOCK keys a block on average, so that about 0.5 % of other keys pass
(measured by a test). Up to LITERAL_BLOCKS blocks it is a literal, then a table of blocks, broadcast if its counted
rows are at most TABLE_BLOCKS.

Edge cases: a null url, or one without "://", has an empty host and path, no rule and the verdict allow; rows that
repeat id and url are returned as often; rules that repeat a host and path with both verdicts block; a null in a rule
drops it; an empty canonical url is not listed; an empty list matches nothing; no rows give no rows. Only the id and
url are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, hold

MIN_BLOCKS, KEYS_A_BLOCK, LITERAL_BLOCKS, TABLE_BLOCKS = 64, 4, 1 << 15, 1 << 20
#: Beyond so many lengths of rule paths, starts of every length are tried.
MAX_LENGTHS = 256
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without www., m. or blog., path without a final slash or .html."""
    return F.concat(F.regexp_replace(host, r"^(?:www|m|blog)\.", ""), F.regexp_replace(path, r"(?:/|\.html)$", ""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks)).cast("int")


def _bits(key: Column) -> Column:
    h = F.xxhash64(key, F.lit(2))
    bits = [F.call_function("shiftleft", F.expr("1L"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(63).cast("int")) for k in range(4)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def filter_blocks(keys: DataFrame, n: int, key: str = "key") -> tuple[DataFrame, int]:
    """Rows (block, bits) of a blocked Bloom filter over n distinct keys, and how many blocks it deals them into."""
    blocks = MIN_BLOCKS
    while blocks * KEYS_A_BLOCK < n:
        blocks *= 2
    return keys.groupBy(_block(F.col(key), blocks).alias("block")).agg(F.bit_or(_bits(F.col(key))).alias("bits")), blocks


def filter_literal(made: DataFrame, blocks: int) -> Column:
    """A filter of at most LITERAL_BLOCKS blocks as an array of longs."""
    words = [0] * blocks
    for row in made.collect():  # a row a block
        words[row.block] = row.bits
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")


def might_hold(bloom: Column, blocks: int, key: Column) -> Column:
    return F.get(bloom, _block(key, blocks)).bitwiseAND(_bits(key)) == _bits(key)


def _possible(urls: DataFrame, keys: DataFrame, url_col: str) -> DataFrame:
    """Distinct (url, key) of the rows' keys that the filter of all listed keys passes."""
    n = keys.count()
    made, blocks = filter_blocks(keys.select("key"), n)
    if blocks <= LITERAL_BLOCKS:
        bloom = filter_literal(made, blocks)
        passed = urls.select(url_col, F.explode(F.filter("keys", lambda k: might_hold(bloom, blocks, k))).alias("key"))
    else:
        each = urls.select(url_col, F.explode("keys").alias("key")).withColumn("block", _block(F.col("key"), blocks))
        passed = each.join(broadcast_if_small(hold(made, "url-blocks"), TABLE_BLOCKS), "block").filter(F.col("bits").bitwiseAND(_bits(F.col("key"))) == _bits(F.col("key"))).select(url_col, "key")
    return passed.distinct()


def _keys_of(host: Column, path: Column, lengths: list[int] | None, labels: list[int]) -> Column:
    """All keys under which a list could hold a url: rules for its host and the domains above it (of as many labels as
    rules' hosts have) with each start of its path (of the lengths that rules have, or of any length), and its
    canonical form. A host of very many labels costs no more than a rule's hosts do."""
    most = F.size(F.split(host, r"\."))
    suffixes = F.array_compact(F.array(*[F.when(most >= n, F.substring_index(host, ".", -n)) for n in labels])) if labels else F.array().cast("array<string>")
    if lengths is None:
        tried = F.sequence(F.lit(0), F.length(path))
    else:
        tried = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(path))
    prefixes = F.transform(tried, lambda n: F.substring(path, F.lit(1), n))
    rule_keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(F.lit("r "), s, p))))
    return F.concat(F.when(host != "", rule_keys).otherwise(F.array().cast("array<string>")), F.array(F.concat(F.lit("u "), canonical(host, path))))


def url_filter(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Rows (id, url, host, path, rule, verdict, listed) for each row of pages.

    rules: rule_host, rule_path, verdict (allow or block). listed: canonical (see canonical()).
    """
    rule_keys = rules.groupBy(F.concat(F.lit("r "), "rule_host", "rule_path").alias("key")).agg(F.max(F.concat("rule_host", "rule_path")).alias("rule"), F.max("verdict").alias("rule_verdict")).filter("key is not null and rule_verdict is not null")
    listed_keys = listed.filter("canonical <> ''").select(F.concat(F.lit("u "), "canonical").alias("key")).distinct().select("key", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("rule_verdict"))
    keys = hold(rule_keys.unionByName(listed_keys), "url-keys")
    lengths = [r[0] for r in rules.select(F.length("rule_path").alias("n")).dropna().distinct().limit(MAX_LENGTHS + 1).collect()]
    labels = sorted(r[0] for r in rules.select(F.size(F.split("rule_host", r"\.")).alias("n")).filter("n > 0").distinct().collect())  # a domain name has 127 at most
    parsed = pages.select(id_col, url_col).withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    urls = parsed.select(url_col, _keys_of(F.col("host"), F.col("path"), lengths if len(lengths) <= MAX_LENGTHS else None, labels).alias("keys"))
    # the exact join: one row a url that a list holds, however many rows have that url
    found = hold(
        _possible(urls, keys, url_col).join(broadcast_if_small(keys), "key").groupBy(url_col).agg(
            F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), "rule", "rule_verdict"))).alias("best"), F.max(F.col("rule").isNull()).alias("listed")
        ), "url-hits",
    )
    listed_there = F.coalesce("listed", F.lit(False))
    verdict = F.coalesce(F.col("best.rule_verdict"), F.when(listed_there, F.lit("block")).otherwise(F.lit("allow")))
    return parsed.join(broadcast_if_small(found, 5_000), url_col, "left").select(id_col, url_col, "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), listed_there.alias("listed"))
