from shotlake.llm import queries, urls

URLS = [None, "", "no scheme", "http://", "HTTP://Www.Example.NET/en/1", "https://a.example.net/de/1?x=/en/", "https://notexample.net/en/", "https://example.com/de/", "https://x.example.com/DE/", "https://a.org/fr/x#y", "https://a.org/en/", "https://b.net", "https://b.net/", "ftp://b.net?q://z.org/fr/", "https://casino-win.example.org/en/1.html", "https://m.casino-win.example.org/en/1/", "https://a.b.c.d.example.net/en/", "http://ÄÖ.net/ü"]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((i for i, c in enumerate(rest) if c in "/?#"), default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fits = [r for r in queries.URL_RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


def test_rules_and_list(spark):
    rows = [(i if i % 5 else None, u, i, "h", "p", "r", "v") for i, u in enumerate(URLS + URLS[4:7])]
    pages = spark.createDataFrame(rows, "page_id long, url string, copies int, host string, path string, rule string, verdict string")
    rules = spark.createDataFrame(queries.URL_RULES, "rule_host string, rule_path string, verdict string")
    listed = spark.createDataFrame([("casino-win.example.org/en/1",), (None,), ("b.net",)], "canonical string")
    got = urls.url_filter(pages, rules, listed).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = brute(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule), r
        assert r.verdict == (verdict or ("block" if "casino-win" in host or (host, path) == ("b.net", "") else "allow")), r
    assert urls.url_filter(pages.limit(0), rules, listed).count() == 0
    assert urls.url_filter(pages, rules.limit(0), listed.limit(0)).filter("verdict = 'block'").count() == 0


def test_bloom_has_no_false_negatives(spark):
    from pyspark.sql import functions as F

    keys = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"))
    made, blocks = urls.filter_blocks(keys, 20000)
    bloom = urls.filter_literal(made, blocks)
    assert keys.filter(~urls.might_hold(bloom, blocks, F.col("key"))).count() == 0
    others = spark.range(100000).select(F.concat(F.lit("z"), "id").alias("key"))
    share = others.filter(urls.might_hold(bloom, blocks, F.col("key"))).count() / 100000
    print(f"false positives: {share:.4f}")
    assert share < 0.02


def test_filter_as_a_table(spark, monkeypatch):
    """Lists beyond the literal's size give the same hits."""
    from pyspark.sql import functions as F

    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.b"), F.col("id") % 700, F.lit(".net/x")).alias("url"))
    listed = spark.range(2000).filter("id % 3 = 0").select(F.concat(F.lit("a.b"), "id", F.lit(".net/x")).alias("canonical"))
    none = spark.createDataFrame([], "rule_host string, rule_path string, verdict string")
    want = {k for k in range(3000) if k % 700 % 3 == 0}
    for most in (urls.LITERAL_BLOCKS, 1):
        monkeypatch.setattr(urls, "LITERAL_BLOCKS", most)
        assert {r.page_id for r in urls.url_filter(pages, none, listed).filter("verdict = 'block'").collect()} == want


def test_rules_of_very_many_lengths(spark):
    """4,300 rules of one host, each of another length: the longest that fits wins."""
    given = spark.createDataFrame([("h.net", "/" + "a" * n, "block" if n % 2 else "allow") for n in range(4300)], "rule_host string, rule_path string, verdict string")
    rows = [(n, "http://h.net/" + "a" * n) for n in (0, 1, 255, 4095, 4096, 4299, 5000)]
    listed = spark.createDataFrame([], "canonical string")
    got = {r.page_id: r for r in urls.url_filter(spark.createDataFrame(rows, "page_id long, url string"), given, listed).collect()}
    for n, _ in rows:
        fits = min(n, 4299)
        assert got[n].rule == "h.net/" + "a" * fits and got[n].verdict == ("block" if fits % 2 else "allow")


def test_listed_pages_are_found_by_their_other_urls(spark):
    pages = spark.createDataFrame([(1, "http://www.a.com/x.html"), (2, "https://a.com/x/?q=1"), (3, "http://a.com/xy"), (4, None)], "page_id long, url string")
    given = spark.createDataFrame([("a.com", "/", None), ("b.com", "/", "allow"), ("b.com", "/", "block")], "rule_host string, rule_path string, verdict string")
    listed = spark.createDataFrame([("a.com/x",), ("",), (None,)], "canonical string")
    assert {r.page_id for r in urls.url_filter(pages, given, listed).filter("verdict = 'block'").collect()} == {1, 2}


def test_hosts_of_very_many_labels(spark):
    """32,000 labels before a rule's host, and a host that is only longer in its last label."""
    import time

    deep = ".".join(["a"] * 32_000)
    pages = spark.createDataFrame([(1, f"http://{deep}.b.net/x"), (2, "http://bb.net/x"), (3, "http://b.net/x"), (4, f"http://{deep}")], "page_id long, url string")
    rules = spark.createDataFrame([("b.net", "/", "block"), ("net", "/", "allow")], "rule_host string, rule_path string, verdict string")
    began = time.perf_counter()
    got = {r.page_id: r.rule for r in urls.url_filter(pages, rules, spark.createDataFrame([], "canonical string")).collect()}
    assert got == {1: "b.net/", 2: "net/", 3: "b.net/", 4: None} and time.perf_counter() - began < 30


def test_decisions_that_only_the_join_makes(spark):
    """A list from one part of the pages decides about other urls of the same documents in the other part."""
    pages = spark.range(400).selectExpr("id as page_id", "concat(case when id % 4 = 0 then 'http://www.' when id % 4 = 1 then 'https://m.' when id % 4 = 2 then 'http://' else 'https://blog.' end, 's', id div 4 % 7, '.net/', id div 4, case when id % 2 = 0 then '.html' else '/' end, case when id % 3 = 0 then '?x=1' else '' end) as url")
    host, path = urls.host_of(pages.url), urls.path_of(pages.url)
    listed = pages.filter("page_id % 4 = 0 and page_id div 4 % 7 = 3").select(urls.canonical(host, path).alias("canonical"))
    none = spark.createDataFrame([], "rule_host string, rule_path string, verdict string")
    blocked = {r.page_id for r in urls.url_filter(pages, none, listed).filter("verdict = 'block'").collect()}
    assert blocked == {k for k in range(400) if k // 4 % 7 == 3} and sum(k % 4 != 0 for k in blocked) > 30
