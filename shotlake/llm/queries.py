"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, exact_dedup, html_text, imatch, line_dedup, mixing, pii, quality, rules, simhash, urls, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    plan = mixing.plan_mix(docs)
    return plan.select("doc_id", F.col("__mix_size").alias("size"), F.col("__mix_source_size").alias("source_size"), F.round("__mix_target", 6).alias("target"), (F.col("__mix_size") * F.col("__mix_copies")).alias("taken"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_components(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = line_dedup.line_dedup(docs, report=True)
    return done.select("doc_id", F.col("__ld_lines").alias("n_lines"), F.size("__ld_gone").alias("n_deleted"), F.array_join("__ld_gone", ",").alias("deleted"), "text")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_scores(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


#: The rules of op7, and the sites whose pages' canonical urls are listed: fixed values. Also listed are the canonical
#: urls of pages whose html is junk: more than one symbol in so many characters.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
LISTED_SITES = ("spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets", "ads-track")
JUNK, ONE_IN = "[#*$%]", 50


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    given = spark.createDataFrame(URL_RULES, "rule_host string, rule_path string, verdict string")
    host, path = urls.host_of(F.col("url")), urls.path_of(F.col("url"))
    named = host.rlike(rf"(?:^|\.)(?:{'|'.join(LISTED_SITES)})\.")
    junk = F.regexp_count("html", F.lit(JUNK)) * ONE_IN > F.length("html")
    listed = pages.filter(named | junk).select(urls.canonical(host, path).alias("canonical"))
    return urls.url_filter(pages, given, listed).select("page_id", "host", "path", "rule", "verdict")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("__qr_words").alias("n_words"), F.col("__qr_word_chars").alias("word_chars"), F.col("__qr_symbols").alias("n_symbols"), F.col("__qr_dup_lines").alias("n_dup_lines"), F.col("__qr_repeat_words").alias("n_repeat_words"), F.col("__qr_base_failed").alias("base_failed"), F.col("__qr_reason").isNull().alias("kept"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.alignment(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mix_sources, op2_simhash, op3_imatch, op4_line_dedup, op5_byte_bpe, op6_quality, op7_url_filter, op8_pii, op9_quality_rules, op10_main_text, op11_whiten, op12_exact_dedup, op13_token_alignment, pipeline)
}

ORACLES: dict[str, str] = {
    "op1_mix_sources": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, (ARRAY[5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s),
c AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / w AS ratio FROM r),
u AS (SELECT *, sum(cap) OVER o AS caps, sum(w) OVER o AS ws, sum(source_size) OVER () * 1.0::DOUBLE AS budget, sum(w) OVER () AS all_w FROM c WINDOW o AS (ORDER BY ratio, k ROWS UNBOUNDED PRECEDING)),
v AS (SELECT *, ratio <= (budget - (caps - cap)) / (all_w - (ws - w)) AS stops FROM u),
t AS (SELECT source, source_size, CASE WHEN stops THEN cap ELSE (budget - coalesce(max(CASE WHEN stops THEN caps END) OVER (), 0)) / nullif(all_w - coalesce(max(CASE WHEN stops THEN ws END) OVER (), 0), 0) * w END AS target FROM v),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target, least(3.0::DOUBLE, coalesce(t.target / nullif(t.source_size, 0), 0)) AS rate,
 ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS draw FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS taken FROM j""",
    "op7_url_filter": rf"""
WITH p AS (SELECT page_id, url, coalesce(length(regexp_replace(html, '[^{JUNK[1:-1]}]', '', 'g')) * {ONE_IN} > length(html), false) AS junk, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(rule_host, rule_path, rule_verdict) AS (VALUES {", ".join(str(x) for x in URL_RULES)}),
c AS (SELECT *, regexp_replace(host, '^(?:www|m|blog)\.', '') || regexp_replace(path, '(?:/|\.html)$', '') AS canonical FROM p),
l AS (SELECT DISTINCT canonical FROM c WHERE canonical <> '' AND (junk OR regexp_matches(host, '(?:^|\.)(?:{'|'.join(LISTED_SITES)})\.')))
SELECT page_id, host, path,
 (SELECT max_by(rule_host || rule_path, length(rule_host || rule_path)) FROM r WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS rule,
 coalesce((SELECT max_by(rule_verdict, length(rule_host || rule_path)) FROM r WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
  CASE WHEN canonical IN (SELECT canonical FROM l) THEN 'block' ELSE 'allow' END) AS verdict FROM c""",
    "op9_quality_rules": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
p AS (SELECT k, unnest(range(1, len(ws) - 1)) AS i, ws FROM d),
t AS (SELECT k, i, count(*) OVER (PARTITION BY k, ws[i], ws[i + 1], ws[i + 2]) AS times FROM p),
c AS (SELECT k, count(*) AS covered FROM (SELECT DISTINCT k, unnest([i, i + 1, i + 2]) AS at FROM t WHERE times > 1) GROUP BY 1),
m AS (SELECT doc_id, text, len(ls) AS n_lines, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
 (len([x for x in ls if regexp_matches(x, '[^\x20\x09-\x0D]')]) - len(list_distinct([x for x in ls if regexp_matches(x, '[^\x20\x09-\x0D]')])))::BIGINT AS n_dup_lines, coalesce(covered, 0)::BIGINT AS n_repeat_words,
 length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(text, '[^!?]', '', 'g')) AS marks, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits,
 len(regexp_extract_all(text, '(?m)^[\x20\t]*[-*•][\x20\t]')) AS bullets, len(regexp_extract_all(text, '(?m)(?:\.\.\.|…)$')) AS dots FROM d LEFT JOIN c USING (k)),
b AS (SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR n_symbols * 10 > n_words * 3 OR coalesce(word_chars / nullif(n_words, 0) NOT BETWEEN 2 AND 15, false) OR (n_dup_lines >= 5 AND n_dup_lines * 2 > n_lines)
 OR upper * 2 > word_chars OR marks * 5 > n_words OR digits * 4 > word_chars OR bullets * 10 > n_lines * 9 OR dots * 10 > n_lines * 3) AS kept FROM b""",
    "op12_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256, row_number() OVER () AS k FROM documents),
r AS (SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id NULLS LAST, k))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r""",
}
