import random
from collections import Counter

from shotlake.llm import mixing, queries


def brute_targets(sizes, weights=(5, 2, 1), cap=3.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    free, left, target = set(sizes), float(sum(sizes.values())), {}
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > cap * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_targets_match_repeated_capping(spark):
    rng = random.Random(1)
    for n in (1, 2, 5, 30):
        sizes = {(None if i == 3 else f"s{i}"): rng.choice([0, 1, 5, 40, 1000, 50_000]) for i in range(n)}
        got = {r.source: r.target for r in mixing.mixing_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = brute_targets(sizes)
        assert all(abs((got[s] or 0.0) - want[s]) < 1e-6 * max(1, want[s]) for s in sizes), (sizes, got, want)


def test_emitted_rows_follow_the_plan(docs):
    plan = mixing.plan_mix(docs).select("doc_id", "__mix_copies", "__mix_size", "__mix_target", "source").collect()
    copies = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert all(copies[r.doc_id] == r["__mix_copies"] <= 3 for r in plan)
    assert mixing.mix(docs).columns == docs.columns
    again = mixing.plan_mix(docs.repartition(7)).select("doc_id", "__mix_copies").collect()
    assert {r.doc_id: r["__mix_copies"] for r in again} == {r.doc_id: r["__mix_copies"] for r in plan}


def test_odd_rows(odd, none, odd_rows):
    assert mixing.plan_mix(odd).count() == len(odd_rows)
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.mix(none).count() == 0


def test_query(spark, sf_dir):
    rows = queries.op1_mix_sources(spark, sf_dir).collect()
    assert all(r.taken <= 3 * r["size"] for r in rows)
