import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shotlake.llm import exact_dedup


def brute(rows):
    """(doc_id, keep_id, group_size, kept, sha) of rows (doc_id, text)."""
    groups = defaultdict(list)
    for k, (doc_id, text) in enumerate(rows):
        plain = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups[hashlib.sha256(plain.encode()).hexdigest()].append((-len(text or ""), doc_id is None, doc_id or 0, k, doc_id))
    for sha, found in groups.items():
        best = min(found)
        yield from ((x[4], best[4], len(found), x is best, sha) for x in found)


@pytest.mark.parametrize("support", [1e-4, 0.05, 1.0])
def test_against_brute_force(spark, odd, odd_rows, support):
    found = exact_dedup.exact_duplicates(odd, support=support)
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, brute([(r[0], r[1]) for r in odd_rows])))


def test_both_paths_agree_on_a_hot_text(spark, docs):
    hot = spark.range(4000).select((F.col("id") + 10_000).alias("doc_id"), F.when(F.col("id") % 2 == 0, "one very\tcommon text").otherwise("one  very common text ").alias("text"))
    rows = docs.select("doc_id", "text").unionByName(hot)
    every = exact_dedup.exact_duplicates(rows).collect()
    heavy = exact_dedup.heavy_winners(exact_dedup.digests(rows), 0.1).collect()
    assert [(r["size"], r.best.id) for r in heavy] == [(4000, 10_001)]  # the longest, then the smallest id
    assert sorted(every) == sorted(exact_dedup.exact_duplicates(rows, support=0.1).collect())
    assert sorted(every) == sorted(exact_dedup.exact_duplicates(rows, support=1.0).collect())  # nothing is frequent: all by shuffle


def test_candidates_that_are_not_frequent_are_dropped(spark):
    # more distinct texts than counters: the summary may name rare ones
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    assert [r["size"] for r in exact_dedup.heavy_winners(exact_dedup.digests(rows), 0.01).collect()] == [1000]


def test_exactly_one_row_a_group_stays(spark, odd, odd_rows):
    left = exact_dedup.drop_exact_duplicates(odd)
    assert left.columns == odd.columns
    kept = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in left.collect()]
    assert len(kept) == len(set(kept)) == len({re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in odd_rows})


def test_no_rows(spark, none):
    assert exact_dedup.exact_duplicates(none).collect() == [] and exact_dedup.drop_exact_duplicates(none).collect() == []


def test_no_python_in_the_plan(spark, docs):
    plan = exact_dedup.exact_duplicates(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
