import random

import corpus_pipeline as P
from pyspark.sql import functions as F

from shotlake.llm import simhash

from .conftest import sentence


def test_stages_and_run(spark, sf_dir, docs):
    frame = docs
    for name, stage in P.STAGES[:-1]:
        made = stage(spark, frame, sf_dir)
        assert made.columns == docs.columns, name
        frame = spark.createDataFrame(made.collect(), docs.schema)
    last = P.STAGES[-1][1](spark, frame, sf_dir)
    by_stage = sorted((r.doc_id, r.n_tokens) for r in last.collect())
    whole = P.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in whole) == by_stage and all(r.decodes for r in whole)


def test_no_exact_copies_stay(spark, sf_dir, docs):
    kept = P.one_of_near_duplicates(spark, P.unique_lines(spark, docs, sf_dir), sf_dir)
    assert kept.groupBy("text").count().filter("count > 1").count() == 0
    assert kept.filter(F.length(F.trim("text")) == 0).count() <= 1


def test_near_copies_go(spark, sf_dir):
    """A near copy that shares whole lines with its source is dropped as a whole; a shared passage goes by itself."""
    rng = random.Random(6)
    lines = [sentence(rng, 30) for _ in range(10)]
    changed = [" ".join("changed" if i == 7 and k % 4 == 0 else w for i, w in enumerate(x.split())) for k, x in enumerate(lines)]
    other = [sentence(rng, 30) for _ in range(10)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(changed)), (3, "\n".join([*other[:5], lines[2], *other[5:]])), (4, "\n".join(lines))]
    frame = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    cut = P.unique_lines(spark, frame, sf_dir)
    kept = {r.doc_id: r for r in P.one_of_near_duplicates(spark, cut, sf_dir).collect()}
    assert set(kept) == {1, 3} and kept[1].text == "\n".join(lines) and kept[3].text == "\n".join(other) and kept[3].n_chars == len(kept[3].text)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def frame_of(spark, texts):
    return spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in texts], DOCUMENTS)


def test_a_passage_held_first_by_a_near_copy_stays(spark, sf_dir):
    """Document 2 is a near copy of 1 with a passage more, which 3 holds as well: 2 goes, the passage stays in 3."""
    rng = random.Random(14)
    base, passage, other = ([sentence(rng, 12) for _ in range(n)] for n in (40, 2, 20))
    texts = [(1, base), (2, base[:20] + passage + base[20:]), (3, other[:10] + passage + other[10:])]
    docs = frame_of(spark, [(k, "\n".join(x)) for k, x in texts])
    kept = {r.doc_id: r.text.split("\n") for r in P.one_of_near_duplicates(spark, P.unique_lines(spark, docs, sf_dir), sf_dir).collect()}
    assert set(kept) == {1, 3} and kept[1] == base and kept[3] == texts[2][1]


def test_a_holder_that_becomes_a_near_copy_stays_a_holder_no_longer(spark, sf_dir):
    """Documents 2 and 3 differ in lines that 1 holds: without these they are near copies, so 3, which also holds what 4
    has, is dropped. The passage of 4 must not have gone by then."""
    rng = random.Random(15)
    a, b, core, passage, other = ([sentence(rng, 12) for _ in range(n)] for n in (20, 20, 40, 2, 20))
    texts = [(1, a + b), (2, a + core), (3, b + core[:39] + passage), (4, other + passage)]
    docs = frame_of(spark, [(k, "\n".join(x)) for k, x in texts])
    # 2 and 3 share lines, so plain line dedup would leave only the passage of 3; as 3 is kept with it, 4 loses it
    kept = {r.doc_id: r.text.split("\n") for r in P.one_of_near_duplicates(spark, P.unique_lines(spark, docs, sf_dir), sf_dir).collect()}
    held = [x for lines in kept.values() for x in lines]
    assert set(held) >= {*a, *b, *core, *passage, *other} and len(held) == len(set(held))


def test_no_line_is_lost(spark, sf_dir):
    """Each line of the documents is in some kept document, or only in near copies that go, in none of which it is held
    for others: every group's leader keeps it, or a document outside the group does."""
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    kept = P.one_of_near_duplicates(spark, P.unique_lines(spark, docs, sf_dir), sf_dir).collect()
    held = {x.strip() for r in kept for x in r.text.split("\n")}
    groups = {(r.o, r.h): r for r in simhash.NearGroups()(docs).collect()}
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    leading = {x.strip() for r in rows if groups[r.doc_id, r.h].leads for x in (r.text or "").split("\n") if len(x.split()) >= 8}
    assert len(leading) > 5000 and len(leading - held) == 0


def test_odd_rows(spark, odd, none, odd_rows, sf_dir):
    """Nulls, blanks, repeats and clashing columns: what each stage keeps is defined, and it keeps the columns."""
    size = len(odd_rows)
    for (name, stage), low, high in zip(P.STAGES, (0, size, size - 5, 1, size), (size, size, size - 5, 3 * size, size)):
        assert stage(spark, none, sf_dir).count() == 0, name
        made = stage(spark, odd, sf_dir)
        assert low <= made.count() <= high, (name, made.count())
        assert name == P.STAGES[-1][0] or made.columns == odd.columns
    texts = [r.text or "" for r in P.one_of_near_duplicates(spark, odd, sf_dir).collect()]
    assert len(texts) == len(set(texts)) and sum(not t.strip() for t in texts) == 1  # of equal texts, and of those without words, one stays
    lines = {(r.doc_id, r.text) for r in P.unique_lines(spark, odd, sf_dir).collect()}
    assert (None, None) in lines and (1, None) in lines and (3, " \n\t \n") in lines
