import random
import re

import corpus_pipeline
import numpy as np
import xxhash

from shotlake.llm import simhash
from shotlake.llm.common import components

from .conftest import SCHEMA, row, sentence


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids_fps, radius):
    parent = list(range(len(ids_fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(ids_fps):
        for j in range(i):
            if (a ^ ids_fps[j][1]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(ids_fps):
        least[find(i)] = min((x for x in (k, least.get(find(i))) if x is not None), default=None)
    return [least[find(i)] for i in range(len(ids_fps))]


def test_fingerprints(docs, odd_rows):
    texts = [r[1] for r in odd_rows] + [r.text for r in docs.limit(60).collect()]
    assert [simhash.simhash(None if t is None else t.encode()) for t in texts] == [brute(t) for t in texts]


def test_tiles_lose_no_link(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for b in base:  # chains whose ends are far apart
        for _ in range(6):
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                b ^= 1 << bit
            fps.add(b)
    rows = [(i, x) for i, x in enumerate(sorted(fps))]
    signed = np.array([x for _, x in rows], np.uint64).view(np.int64)
    links = simhash.near_links(spark.createDataFrame([(int(x),) for x in signed], "fp long"), tile=16)
    label = {r.node: r.label for r in components(links).collect()}
    want = groups(rows, 4)
    got = {}
    for (i, _), s in zip(rows, signed.tolist()):
        got.setdefault(label.get(s, s), []).append(i)
    expected = {}
    for (i, _), w in zip(rows, want):
        expected.setdefault(w, []).append(i)
    assert sorted(got.values()) == sorted(expected.values())


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 40)] + [(7, 7)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(51)) and all(found[1000 + i] == 1000 for i in range(40))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd, none, odd_rows):
    rows = simhash.near_components(odd).collect()
    assert len(rows) == len(odd_rows)
    want = groups([(r[0], brute(r[1])) for r in odd_rows], 4)
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == sorted((str(r[0]), str(w)) for r, w in zip(odd_rows, want))
    assert simhash.near_components(none).count() == 0
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, set(want)))
    assert simhash.drop_near_duplicates(none).count() == 0


def jaccard(a, b, size=5):
    x, y = ({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_near_texts_go_by_similarity(spark, odd, none, monkeypatch):
    rng = random.Random(9)
    texts = []
    for k in range(12):
        base = sentence(rng, 80).split()
        texts.append(" ".join(base))
        for edits in range(1, 5):
            copy = list(base)
            for at in rng.sample(range(80), edits):
                copy[at] = "changed"
            texts.append(" ".join(copy))
    texts += [texts[0].upper(), texts[0], "", " \n", "two words", "two words more"]
    parent = list(range(len(texts)))
    for i, x in enumerate(texts):
        for j in range(i):
            if jaccard(x.lower(), texts[j].lower()) >= 0.8:
                parent = [parent[j] if p == parent[i] else p for p in parent]
    want = sorted({p: parent.index(p) for p in parent}.values())
    assert 12 < len(want) < 60
    table = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)
    for job in (simhash.JOB_TEXTS, 2):  # as one job for a group, and as several
        monkeypatch.setattr(simhash, "JOB_TEXTS", job)
        assert sorted(r.doc_id for r in simhash.drop_near_texts(table).collect()) == want
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_near_duplicates(spark, table, "").collect()) == want
    kept = simhash.drop_near_texts(odd)
    assert kept.columns == odd.columns and kept.count() == len({(r.text or "").strip() for r in odd.collect()})
    assert simhash.drop_near_texts(none).count() == 0


def test_one_id_with_unlinked_texts(spark):
    rng = random.Random(11)
    x, y = sentence(rng, 60), sentence(rng, 60)
    table = spark.createDataFrame([row(1, x), row(1, y), row(2, y)], SCHEMA)
    for drop in (simhash.drop_near_duplicates, simhash.drop_near_texts):
        assert sorted((r.doc_id, r.text) for r in drop(table).collect()) == sorted([(1, x), (1, y)])


def test_every_group_has_a_leader(spark):
    """The largest id and a null one in a group: the leader's id and text come from one row."""
    rng = random.Random(12)
    x = sentence(rng, 200).split()
    texts = [" ".join(x), " ".join([*x[:100], "changed", *x[101:]])]
    near = lambda df: simhash.drop_near_duplicates(df, radius=20)
    for ids, drop in (((2**63 - 1, None), simhash.drop_near_texts), ((None, 2**63 - 1), near), ((None, None), near)):
        table = spark.createDataFrame([row(i, t) for i, t in zip(ids, texts)], SCHEMA)
        kept = drop(table).collect()
        assert len(kept) == 1 and kept[0].doc_id == (None if ids == (None, None) else 2**63 - 1)
    assert sum(r.leads for r in simhash.NearGroups()(table).collect()) == 1


def test_repeated_lines_do_not_hide_near_texts(spark):
    rng = random.Random(13)
    lines = [sentence(rng, 30) for _ in range(6)]
    table = spark.createDataFrame([row(1, "\n".join([lines[0]] * 40 + lines[1:])), row(2, "\n".join(lines))], SCHEMA)
    assert [r.doc_id for r in simhash.drop_near_texts(table).collect()] == [1]


def test_recall_of_candidates_by_length(spark):
    """Pairs just above a similarity of 0.8, 150 of each length: at least 99 in 100 are found."""
    rng = random.Random(16)
    for n in (14, 40, 200, 1000):
        rows = []
        for k in range(150):
            base = sentence(rng, n).split()
            copy = list(base)
            spots = list(range(0, n, 5))  # a change takes five shingles of a text at most
            rng.shuffle(spots)
            for at in spots:
                before = copy[at]
                copy[at] = "changed"
                if jaccard(" ".join(base), " ".join(copy)) < 0.8:
                    copy[at] = before
                    if n > 40:
                        break
            assert base != copy or n == 14
            rows += [row(2 * k, " ".join(base)), row(2 * k + 1, " ".join(copy))]
        kept = {r.doc_id for r in simhash.drop_near_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
        missed = sum(2 * k + 1 in kept for k in range(150) if rows[2 * k][1] != rows[2 * k + 1][1])
        assert missed <= 1, (n, missed)


def test_rounds_of_few_links_leave_few_files(spark):
    """A chain and a hub in a session of many partitions: of all rounds the last one's table stays, in a file a core at most."""
    from pathlib import Path

    from shotlake.llm.common import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file://")) / spark.sparkContext.applicationId
    edges = [(k, k + 1) for k in range(500)] + [(1000, 1001 + k) for k in range(500)]
    before = set(folder.glob("*")) if folder.exists() else set()
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert found == {k: 0 for k in range(501)} | {k: 1000 for k in range(1000, 1501)}
    left = set(folder.glob("*")) - before
    assert len(left) == 1 and len(list(left.pop().glob("part-*"))) <= spark.sparkContext.defaultParallelism
