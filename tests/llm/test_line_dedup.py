import random
import time

from shotlake.llm import line_dedup as L

from .conftest import SCHEMA, row, sentence


def test_patience_keeps_order():
    a, b = [1, 2, 3, 4, 5], [9, 1, 3, 4, 8, 5]
    assert L.patience(a, b) == [(0, 1), (2, 2), (3, 3), (4, 5)]
    assert L.patience([], [1]) == [] and L.patience([1, 1, 1], [1, 1]) == [(0, 0), (1, 1)]
    for seed in range(50):
        rng = random.Random(seed)
        a, b = ([rng.randint(0, 8) for _ in range(rng.randint(0, 15))] for _ in range(2))
        got = L.patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))


def test_moved_blocks_go_and_short_ones_stay():
    a, b, sizes = [1, 2, 3, 10, 4, 5], [4, 5, 20, 1, 2, 3, 30, 10], [5, 5, 1, 5, 5, 5, 1, 1]
    assert L.common_blocks(a, b, sizes, 8) == [0, 1, 3, 4, 5]
    assert L.common_blocks([1, 2, 3, 4], [8, 4, 1], [9, 1, 9], 8) == [2]  # the short line 4 crosses line 1


def brute_blocks(a, b, sizes, least):
    """Lines of b in runs of at least `least` words that are runs of a."""
    gone = set()
    for i in range(len(b)):
        for j in range(len(a)):
            n = 0
            while i + n < len(b) and j + n < len(a) and b[i + n] == a[j + n]:
                n += 1
            while n and sizes[i + n - 1] == 0:
                n -= 1
            if n and sizes[i] and sum(sizes[i : i + n]) >= least:
                gone.update(range(i, i + n))
    return gone


def test_common_blocks_against_all_runs():
    for seed in range(300):
        rng = random.Random(seed)
        words = [rng.choice([0, 1, 2, 3, 5, 9]) for _ in range(12)]
        a, b = ([rng.randrange(12) for _ in range(rng.randint(0, 25))] for _ in range(2))
        sizes = [words[x] for x in b]
        got = L.common_blocks(a, b, sizes, 8)
        assert {p for p in got if sizes[p]} == {p for p in brute_blocks(a, b, sizes, 8) if sizes[p]}
        assert set(got) >= brute_blocks(a, b, sizes, 8)  # and lines without words at the ends of aligned blocks


def test_any_order_of_lines_is_linear():
    a = list(range(40_000))
    swapped = [x + (1 if x % 2 == 0 else -1) for x in a]
    began = time.perf_counter()
    for b in (a[::-1], swapped, a[20_000:] + a[:20_000], [x % 7 for x in a], a):
        for size in (9, 3):
            L.common_blocks(a, b, [size] * len(b), 8)
        if len(set(b)) == len(a):
            assert L.common_blocks(a, b, [9] * len(b), 8) == a
    assert L.common_blocks(a, a[::-1], [3] * len(a), 8) == []
    assert time.perf_counter() - began < 20


def test_planted_passages(spark):
    rng = random.Random(2)
    passage = [sentence(rng, 14) for _ in range(4)]
    rows, clean = [], []
    for i in range(60):
        own = [sentence(rng, 12) for _ in range(6)]
        if i % 3 == 0:
            own[2:2] = passage
        else:
            clean.append(i)
        rows.append(row(i, "\n".join(own)))
    docs = spark.createDataFrame(rows, SCHEMA)
    done = {r.doc_id: r for r in L.line_dedup(docs, report=True).collect()}
    assert L.line_dedup(docs).columns == docs.columns
    for i, r in enumerate(rows):
        assert done[i].text == (r[1] if i in clean or i == 0 else "\n".join(x for x in r[1].split("\n") if x not in passage))
        assert done[i]["__ld_gone"] == ([] if i in clean or i == 0 else [2, 3, 4, 5])


def test_runs():
    sizes = {1: 9, 2: 3, 3: 4, 4: 2, 5: 0}
    two = L.runs([2, 3, 5, 4], [3, 4, 0, 2])
    assert len(two) == 1 and two == L.runs([2, 3, 4], [3, 4, 2]) and L.runs([1], [9]) == [1]
    assert L.runs([2, 3], [3, 4]) == [] == L.runs([], []) and L.runs([5, 5], [0, 0]) == []
    assert set(L.runs([1, 2, 3, 4], [sizes[k] for k in (1, 2, 3, 4)])) == {1, two[0]}


def test_every_repeated_run_goes(spark):
    """Brute force over all earlier documents: blocks of short lines go although each line was seen before elsewhere."""
    rng = random.Random(6)
    short = [sentence(rng, rng.randint(1, 5)) for _ in range(900)]
    texts = [rng.sample(short, rng.randint(1, 12)) for _ in range(150)]
    for i in range(20, 150, 3):
        block = texts[rng.randrange(i)]
        start = rng.randrange(len(block))
        texts[i] = [x for x in texts[i] if x not in block] + block[start : start + 5]
    expected = []
    for i, lines in enumerate(texts):
        gone = set()
        for earlier in texts[:i]:
            for a in range(len(lines)):
                for b in range(len(earlier)):
                    n = 0
                    while a + n < len(lines) and b + n < len(earlier) and lines[a + n] == earlier[b + n]:
                        n += 1
                    if sum(len(x.split()) for x in lines[a : a + n]) >= L.MIN_BLOCK_WORDS:
                        gone.update(range(a, a + n))
        expected.append(sorted(gone))
    assert sum(map(bool, expected)) >= 8
    docs = spark.createDataFrame([row(i, "\n".join(x)) for i, x in enumerate(texts)], SCHEMA)
    assert [r["__ld_gone"] for r in L.line_dedup(docs, report=True).orderBy("doc_id").collect()] == expected


def test_short_lines_of_different_first_holders(spark):
    rng = random.Random(8)
    own = [sentence(rng, 5) for _ in range(4)]
    texts = [[own[k], sentence(rng, 12)] for k in range(4)] + [own, [sentence(rng, 12), *own]]
    docs = spark.createDataFrame([row(i, "\n".join(x)) for i, x in enumerate(texts)], SCHEMA)
    assert [r["__ld_gone"] for r in L.line_dedup(docs, report=True).orderBy("doc_id").collect()] == [[], [], [], [], [], [1, 2, 3, 4]]


def test_odd_rows(odd, none, odd_rows):
    done = L.line_dedup(odd)
    assert done.columns == odd.columns and done.count() == len(odd_rows)
    assert {(r.doc_id, r.text) for r in done.collect() if r.doc_id in (1, 2, 3)} == {(1, None), (2, ""), (3, " \n\t \n")}
    assert L.line_dedup(none).count() == 0
