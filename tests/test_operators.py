import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotlake.functions import json_text as J
from shotlake.operators import boosting as B
from shotlake.operators import evaluation as E
from shotlake.operators import features as X
from shotlake.operators import merge as M
from shotlake.operators import models, networks, ranges
from shotlake.operators import quality as Q
from shotlake.operators import retrieval as R
from shotlake.operators import splits as P
from shotlake.operators import store as store_module
from shotlake.operators.store import Batch, Refused, Store, bucketed
from shotlake.sources import checks as C
from shotlake.sources import documents as D

SCORED = "y int, p double, g string"


def brute_auc(rows):
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def brute_ap(rows):
    total, out, tp = sum(y for y, _ in rows), 0.0, 0
    for s in sorted({p for _, p in rows}, reverse=True):
        new = sum(y for y, p in rows if p == s)
        tp += new
        out += new / total * tp / sum(p >= s for _, p in rows)
    return out


def test_rank_metrics(spark):
    known = [(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)]
    tied = [(i * 7 % 3 == 0, (i * 13 % 20) / 20) for i in range(200)]
    tied = [(int(y), p) for y, p in tied]
    rows = [(y, p, "known") for y, p in known] + [(y, p, "tied") for y, p in tied] + [(1, 0.5, "one class")]
    for parts in (1, 8):
        got = {r.g: r for r in E.rank_metrics(spark.createDataFrame(rows, SCORED).repartition(parts), ["g"]).collect()}
        assert (got["known"].roc_auc, got["known"].pr_auc) == pytest.approx((0.75, 0.8333333333333333))
        assert (got["tied"].roc_auc, got["tied"].pr_auc) == pytest.approx((brute_auc(tied), brute_ap(tied)))
        assert got["one class"].roc_auc is None and got["one class"].pr_auc is None


def test_reliability_has_all_bins(spark):
    table = E.reliability(spark.createDataFrame([(1, 0.0, "a"), (0, 0.2, "a"), (1, 1.0, "a"), (1, 0.999999999999, "a")], SCORED), []).orderBy("bin").collect()
    assert [r.n for r in table] == [1, 1, 0, 0, 2] and table[2].mean_p is None
    none = spark.createDataFrame([], SCORED)
    assert E.reliability(none, []).count() == 5
    dev = E.supported_deviation(E.reliability(none, []), []).first()
    assert dev.max_deviation == 0.0 and E.supported_deviation(E.reliability(none, []), [], empty=None).first().max_deviation is None


def test_bootstrap_of_equal_clusters_has_no_width(spark):
    rows = [(y, 0.25, str(k)) for k in range(12) for y in (0, 1)]
    got = E.cluster_bootstrap(spark.createDataFrame(rows, SCORED), "g", 30).collect()
    assert all(r.low == pytest.approx(r.high) for r in got)


def test_vocabulary_threshold_is_exact(spark):
    levels = ["ref"] * 3 + ["a"] * 25 + ["b"] * 24 + [None] * 30 + ["c"] * 2
    rows = spark.createDataFrame([(x,) for x in levels], "f string")
    table = {r.level: (r.role, r.position) for r in X.fit_vocabulary(rows, {"f": "ref"}, 25).collect()}
    assert table == {"ref": ("reference", None), "a": ("kept", 2), "None": ("kept", 1), "b": ("rare", 3), "c": ("rare", 3)}
    fitted = X.fit_vocabulary(rows, {"f": "ref"}, 25).collect()
    new = spark.createDataFrame([("a",), ("b",), ("ref",), ("never",), ("rare",), (None,)], "f string")
    got = X.encode(new, fitted, ["f"]).select("`f=None`", "`f=a`", "`f=rare`").collect()
    assert [tuple(r) for r in got] == [(0, 1, 0), (0, 0, 1), (0, 0, 0), (0, 0, 0), (0, 0, 0), (1, 0, 0)]


def test_fold_scaler_leaves_the_fold_out(spark):
    rows = spark.createDataFrame([(i % 3, 1e9 + i * i) for i in range(30)], "fold int, v double")
    for r in X.fold_scalers(rows, ["v"]).collect():
        other = rows.filter(F.col("fold") != r.fold).agg(F.avg("v"), F.stddev_pop("v")).first()
        assert (r["mean"], r.sd) == pytest.approx(tuple(other))


def test_merge_life_cycle(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1)], "k int, v string, n int")
    first = M.merge_counters(old, old.limit(0), ["k"], ["v", "n"]).first()
    again = M.merge_counters(old, old, ["k"], ["v", "n"]).first()
    assert tuple(first) == (2, 2, 0, 0, 0, 2) and tuple(again) == (2, 0, 0, 2, 0, 2)
    changed = spark.createDataFrame([(1, "a", 3), (2, "b", 1), (3, "c", None)], old.schema)
    assert [r.k for r in M.changed_rows(changed, old, ["k"], ["v", "n"]).collect()] == [1]
    assert sorted(r.k for r in M.insert_only_merge(changed, old, ["k"]).collect()) == [1, 2, 3]
    assert [r.k for r in M.scope_extras(old, changed.filter("k = 1"), old.select("v"), ["v"], ["k"]).collect()] == [2]
    assert M.duplicate_keys(changed.union(changed.limit(1)), ["k"]).count() == 1


def test_first_load_refuses_a_second(spark, tmp_path):
    df = spark.range(3)
    assert M.first_load({"t": df}, str(tmp_path)).first().n == 3
    with pytest.raises(Exception, match="(?i)already exists"):
        M.first_load({"t": df}, str(tmp_path))


def test_folds_follow_date_order(spark):
    rows = [(i, f"2020-{1 + i * 7 % 12:02d}-{1 + i % 27:02d}", "development" if i % 4 else "holdout") for i in range(60)]
    groups = spark.createDataFrame(rows, "match_id int, d string, split string").select("match_id", F.to_date("d").alias("match_date"), "split")
    got = {r.match_id: r.fold for r in P.assign_folds(groups).collect()}
    order = sorted((d, i) for i, d, s in rows if s == "development")
    assert {i: k % 5 for k, (_, i) in enumerate(order)} == {i: f for i, f in got.items() if f is not None}


def test_assignment_file_rules(spark, tmp_path):
    lines = ["match_id,competition_id,season_id,match_date,split,fold", "1,1,1,2020-01-01,development,0", "2,1,1,2020-01-01,holdout,", "3,1,1,2020-01-01,holdout,2", "4,1,1,2020-01-01,development,7", "5,1,1,2020-01-01,other,"]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    good, bad = P.read_assignments(spark, str(tmp_path))
    assert sorted(r.match_id for r in good.collect()) == [1, 2]
    assert {r.match_id: r.reason for r in bad.collect()} == {3: "fold off development", 4: "bad fold", 5: "unknown split"}


EVENTS = [
    {"id": "AA", "index": 1, "type": {"id": 16, "name": "Shot"}, "player": {"id": 0, "name": "Z"}, "location": [1.5, 2], "related_events": ["BB", "cc"], "_comment": "x",
     "shot": {"outcome": {"id": 1, "name": "Goal"}, "end_location": [1.0, 2.0], "freeze_frame": [{"teammate": True, "location": [3.0, 4.0]}, {"player": {"id": 5, "name": "Q"}, "teammate": False}]}},
    {"id": "bb", "index": 2, "type": {"id": 30, "name": "Pass"}, "tactics": {"formation": 442}, "pass": {"length": 3.5}, "_comment": "y"}, {"id": "cc", "index": 3, "type": {"id": 2, "name": "Ball"}, "_note": 1},
]


def test_nested_events(spark, tmp_path):
    (tmp_path / "77.json").write_text(json.dumps(EVENTS, indent=1))
    docs = D.read_documents(spark, str(tmp_path)).select(F.col("name").cast("long").alias("match_id"), "json")
    events = {r.event_id: r for r in D.scan_events(docs).collect()}
    assert events["aa"].match_id == 77 and events["aa"].player_id == 0 and (events["aa"].x, events["aa"].y) == (1.5, 2.0) and events["bb"].x is None
    assert [(r.source_event_id, r.related_event_id, r.source_order) for r in D.explode_relations(docs).collect()] == [("aa", "bb", 1), ("aa", "cc", 2)]
    assert [(r.source_order, r.player_id, r.x) for r in D.explode_freeze_frame(docs).orderBy("source_order").collect()] == [(1, None, 3.0), (2, 5, None)]
    shot = D.project_shot_detail(docs).collect()
    assert len(shot) == 1 and shot[0].end_z is None and shot[0].outcome_name == "Goal" and shot[0].technique_name is None
    left = {r.event_id: r.type_data and json.loads(r.type_data) for r in D.project_residual_json(docs).collect()}
    assert left["aa"] is None and left["cc"] is None and set(left["bb"]) == {"tactics", "pass"}


def test_strict_events(spark):
    bad = [{"id": "a", "type": {"id": True, "name": "x"}}, {"id": 5, "type": {"id": 1, "name": "x"}}, {"id": "b", "type": {"id": 1, "name": "x"}, "location": [1, 2, 3]}, {"id": "c", "type": {"id": 1, "name": "x"}, "player": {"id": 1}}, {"id": "d", "type": {"id": 1, "name": "x"}, "minute": "1"}, {"id": "e", "type": {"id": 1, "name": "x"}, "minute": 1, "location": [1, 2.5]}]
    docs = spark.createDataFrame([(1, json.dumps(bad))], "match_id long, json string")
    errors = [r.errors for r in D.validate_events(docs).orderBy("position").collect()]
    assert errors == [["type.id: integer required"], ["id: text required"], ["location: two numbers expected"], ["player: id and name go together"], ["minute: integer expected"], []]


def test_manifest_and_pages(spark):
    found = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    pinned = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, sha256 string")
    assert {r.path: r.status for r in D.verify_manifest(found, pinned).collect()} == {"a": "ok", "b": "changed", "c": "extra", "d": "missing"}
    assert R.page(spark.range(30), ["id"], 0).count() == 1 and [r.id for r in R.page(spark.range(30), ["id"], 3, 5).collect()] == [5, 6, 7]
    with pytest.raises(ValueError):
        R.page(spark.range(3), ["id"], 3, -1)
    with pytest.raises(ValueError):
        R.filter_equal(found, ("path",), path=" ")


def test_logistic_matches_newton(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [1.0, -2.0] + 0.3)))).astype(int)
    rows = models.assembled(spark.createDataFrame([(int(b), float(u), float(v)) for b, (u, v) in zip(y, x)], "y int, u double, v double"), ["u", "v"])
    model = models.logistic(1.0, 300).fit(rows)
    z, w = np.column_stack([x, np.ones(300)]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag([1, 1, 0]), z.T @ (p - y) + np.array([1, 1, 0]) * w)
    assert [*model.coefficients, model.intercept] == pytest.approx(list(w), abs=1e-4)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_residual_keeps_types_and_loses_the_forbidden_key(spark):
    events = [
        {"id": "A", "type": {"id": 30, "name": "Pass"}, "pass": {"length": 3.5, "forbidden": 1, "n": 2, "late": True, "list": [1, {"forbidden": 3, "k": "v"}]}, "tactics": {"formation": 442, "forbidden": 2}, "none": None, "_c": 1},
        {"id": "B", "type": {"id": 2, "name": "X"}, "forbidden": {"a": 1}}, {"id": "C", "type": {"id": 2, "name": "X"}, "tactics": None, "note": 'says "forbidden": here'}, {"id": "D", "type": {"id": 2, "name": "X"}, "shot": {"x": 1}},
    ]
    docs = spark.createDataFrame([(1, json.dumps(events))], "match_id long, json string")
    found = D.project_residual_json(docs, "forbidden").select("event_id", "type_data", J.has_key(F.col("type_data"), "forbidden").alias("leaks")).collect()
    assert {r.event_id: r.type_data and json.loads(r.type_data) for r in found} == {
        "a": {"pass": {"length": 3.5, "n": 2, "late": True, "list": [1, {"k": "v"}]}, "tactics": {"formation": 442}, "none": None}, "b": None, "c": {"note": 'says "forbidden": here'}, "d": {"shot": {"x": 1}}
    }
    assert not any(r.leaks for r in found)
    with_key = D.project_residual_json(docs).filter("event_id in ('a', 'b')").select(J.has_key(F.col("type_data"), "forbidden").alias("leaks")).collect()
    assert all(r.leaks for r in with_key)


def test_strict_documents(spark):
    one = lambda rows, more=(): spark.createDataFrame([(*more, json.dumps(rows))], ", ".join([*(["match_id long"] if more else []), "json string"]))
    good = {"match_id": 5, "competition": {"competition_id": "1"}, "season": {"season_id": 2}, "home_team": {"home_team_id": 2, "home_team_name": "x"}, "away_team": {"away_team_id": 3, "away_team_name": "y"}, "match_date": "2020-11-01T00:00", "competition_stage": None}
    bad = good | {"season": {}, "home_team": {"home_team_id": "two", "home_team_name": None}, "match_date": "2020-13-01", "competition_stage": {"id": 1}}
    assert [r.errors for r in D.validate_matches(one([good, bad])).orderBy("position").collect()] == [[], ["season.season_id: whole required", "home_team.home_team_id: whole required", "home_team.home_team_name: value required", "match_date: date expected", "competition_stage.name: text required"]]
    assert [r.errors for r in D.validate_competitions(one([{"competition_id": 1, "season_id": "2", "competition_name": "c", "season_name": 3}, {"competition_id": "x"}])).orderBy("position").collect()] == [[], ["competition_id: whole required", "season_id: whole required", "competition_name: value required", "season_name: value required"]]
    lineups = [{"team_id": True, "lineup": [{"player_id": 1, "player_name": "a", "country": {"id": "x", "name": "y"}, "positions": [{"position_id": 1}], "cards": [{"card_type": 5}]}, {"player_id": "2"}]}, {"team_id": 1, "team_name": 2, "lineup": {}}]
    got = {(r.part, r.position): r.errors for r in D.validate_lineups(one(lineups, (1,))).collect()}
    assert got == {("team", 0): ["team_id: integer required"], ("team", 1): ["team_name: text expected", "lineup: list required"], ("member", 0): ["country.id: integer required"], ("member", 1): ["player_id: integer required", "player_name: text required"], ("position", 0): ["id and name go together"], ("card", 0): ["card_type: text required"]}


def test_possession_conflicts(spark):
    rows = [(1, 1, 5), (1, 1, 5), (1, 2, 5), (1, 2, None), (1, 3, 7), (1, 3, 4), (1, 4, None)]
    got = {r.possession_id: (r.team_id, r.conflict) for r in D.derive_possessions(spark.createDataFrame(rows, "match_id int, possession_id int, team_id int")).collect()}
    assert got == {1: (5, False), 2: (5, True), 3: (4, True), 4: (None, False)}


def test_digest_of_many_rows(spark):
    """Sums of 40-bit slices pass the largest long near 17 million rows."""
    row = P.membership_digest(spark.range(0, 18_000_000, 1, 16).select(F.col("id").alias("event_id"), F.lit(1).alias("match_id"))).first()
    assert row.n == 18_000_000 and int(row.low) + int(row.high) > 2 * 2**63 * 0.95


def test_numbers_of_keys(spark):
    keys = [-(10**12), -5, 0, 1, 2, 3, 700, 10**15]
    got = ranges.numbered(spark.createDataFrame([(k,) for k in keys], "c long"), "c").collect()
    assert {r.c: r.place for r in got} == {k: i for i, k in enumerate(keys)}
    names = sorted(["", "a", "ab", "b", *(f"user-{k:05d}" for k in range(300))])  # most share a prefix
    assert {r.c: r.place for r in ranges.numbered(spark.createDataFrame([(k,) for k in names], "c string"), "c", ranges=7).collect()} == {k: i for i, k in enumerate(names)}
    assert ranges.numbered(spark.createDataFrame([], "c long"), "c").count() == 0


def test_ranges_are_even_beside_an_outlier(spark):
    """One score far off and all others within a thousandth: no range has over twice the mean rows, and sums are exact."""
    scores = spark.range(20_000).select((F.lit(0.5) + F.col("id") / 20_000_000).alias("p"), F.lit(1.0).alias("n")).unionByName(spark.createDataFrame([(1e9, 1.0)], "p double, n double"))
    counts = [r["count"] for r in ranges.in_ranges(scores, [F.col("p").desc()], 16).groupBy("__range").count().collect()]
    assert sum(counts) == 20_001 and max(counts) <= 2 * 20_001 / 16
    ran = ranges.running_sums(scores, [], [("p", True)], ["n"], 16)
    assert ran.agg(F.min("__to_n"), F.max("__to_n"), F.countDistinct("__to_n"), F.min("__all_n")).first()[:] == (1.0, 20_001.0, 20_001, 20_001.0)
    assert ran.orderBy(F.desc("p")).first()["__to_n"] == 1.0


def test_exact_quantiles(spark):
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 40, 1001).astype(float), rng.normal(size=1001) ** 3
    df = spark.createDataFrame([(float(x), None if k % 5 == 0 else float(z), None) for k, (x, z) in enumerate(zip(a, b))], "a double, b double, c double").repartition(5)
    shares = [0.0, 0.025, 0.05, 0.5, 0.777, 1.0]
    got = {(r["name"], r.share): r["value"] for r in ranges.exact_quantiles(df, ["a", "b", "c"], shares, 9).collect()}
    assert len(got) == 12 and not any(name == "c" for name, _ in got)
    for name, values in (("a", a), ("b", b[np.arange(1001) % 5 != 0])):
        for q in shares:
            assert got[name, q] == pytest.approx(np.quantile(values, q), abs=1e-12)
            assert got[name, q] == pytest.approx(df.agg(F.expr(f"percentile({name}, {q})")).first()[0], abs=1e-12)
    assert ranges.exact_quantiles(df.limit(0), ["a"], [0.5]).count() == 0


def test_bootstrap_against_plain_draws(spark, monkeypatch):
    import hashlib

    rng = np.random.default_rng(7)
    rows = [(int(rng.random() < 0.4), float(rng.random()), f"c{int(k)}") for k in rng.integers(0, 23, 400)]
    names = sorted({g for _, _, g in rows})
    sums = np.array([[sum(1.0 for *_, g in rows if g == c), sum(-np.log(p if y else 1 - p) for y, p, g in rows if g == c), sum((y - p) ** 2 for y, p, g in rows if g == c)] for c in names])
    values = []
    for r in range(100):
        drawn = [int(hashlib.md5(f"{r}:{k}".encode()).hexdigest()[:8], 16) % len(names) for k in range(len(names))]
        t = sums[drawn].sum(axis=0)
        values.append((t[1] / t[0], t[2] / t[0]))
    expected = {m: (np.quantile([v[i] for v in values], 0.025), np.quantile([v[i] for v in values], 0.975)) for i, m in enumerate(("ll_p", "se_p"))}
    for block in (8192, 5):  # one block, and several
        monkeypatch.setattr(E, "BLOCK", block)
        got = {r.metric: (r.low, r.high) for r in E.cluster_bootstrap(spark.createDataFrame(rows, SCORED), "g", 100).collect()}
        assert got.keys() == expected.keys() and all(got[m] == pytest.approx(expected[m], abs=1e-12) for m in got)


def test_quarantine_of_unreadable_documents(spark, tmp_path):
    """Good, truncated, null, object, and missing documents, a broken line, and elements that are no objects."""
    good = {"id": "a", "type": {"id": 30, "name": "Pass"}}
    lines = [json.dumps({"match_id": k, "json": t}) for k, t in enumerate([json.dumps([good, good]), json.dumps([good])[:-9], "null", json.dumps(good), None, json.dumps([good, 5, None, "x", [1]]), "[]", "", json.dumps([good]) + "]"])]
    (tmp_path / "docs.json").write_text("\n".join([*lines, lines[0][:25], ""]))
    docs = D.read_document_lines(spark, str(tmp_path), "match_id", faults=True)
    accepted, rejected = C.quarantine(docs, "events")
    got = sorted((str(r.match_id), r.position, ";".join(r.reasons)) for r in rejected.collect())
    assert got == sorted([("1", None, "not JSON"), ("2", None, "null document"), ("3", None, "not a list"), ("4", None, "no document"), *(("5", k, "not an object") for k in (1, 2, 3, 4)), ("7", None, "not JSON"), ("8", None, "not JSON"), ("None", None, "unreadable line")], key=lambda x: (x[0], x[1] or 0))
    assert all(r.file.endswith("docs.json") for r in rejected.collect())
    assert sorted((r.match_id, r.event_id) for r in D.scan_events(accepted).collect()) == [(0, "a"), (0, "a"), (5, "a")]
    assert accepted.columns == ["match_id", "json", "file"]
    assert {(r.match_id, *r.errors) for r in D.validate_events(docs).collect() if r.position is None} == {(1, "not JSON"), (2, "null document"), (3, "not a list"), (4, "no document"), (7, "not JSON"), (8, "not JSON"), (None, "unreadable line")}
    assert len(C.refuse_faults(docs.filter("match_id in (0, 6)"), "events").collect()) == 2
    for k in (1, 2, 5):
        with pytest.raises(Exception, match="rejected document"):
            C.refuse_faults(docs.filter(f"match_id = {k}"), "events").collect()


def test_rules_reach_into_lists(spark):
    """One fault at a time in an event that is otherwise sound, with its path and place."""
    shot = {"end_location": [1, 2.5, 3], "freeze_frame": [{"location": [1, 2], "player": {"id": 0, "name": "x"}, "teammate": True, "position": {"id": 1, "name": "p"}}, {}], "outcome": {"id": 1, "name": "Goal"}, "first_time": True, "key_pass_id": "k"}
    sound = {"id": "e", "type": {"id": 16, "name": "Shot"}, "team": {"id": 1, "name": "t"}, "location": [0, 1.5], "related_events": ["x"], "minute": 3, "duration": 1e3, "player": None, "shot": shot}
    with_shot = lambda **k: {**sound, "shot": {**shot, **k}}
    cases = [
        (sound, []), ({k: v for k, v in sound.items() if k != "shot"}, ["shot: object required"]), ({**sound, "team": None}, ["team: object required"]), ({**sound, "team": {"id": True, "name": "t"}}, ["team.id: integer required"]),
        (with_shot(end_location=[1]), ["shot.end_location: two or three numbers expected"]), (with_shot(end_location=[1, "2"]), ["shot.end_location: two or three numbers expected"]), (with_shot(end_location=[1, None]), ["shot.end_location: two or three numbers expected"]), (with_shot(end_location=None), []),
        (with_shot(first_time="true"), ["shot.first_time: boolean expected"]), (with_shot(freeze_frame={}), ["shot.freeze_frame: list expected"]), (with_shot(freeze_frame=None), ["shot.freeze_frame: list expected"]), (with_shot(freeze_frame=[]), []),
        (with_shot(freeze_frame=[{}, 3]), ["shot.freeze_frame[1]: object required"]), (with_shot(freeze_frame=[{}, {"location": [1], "teammate": 1, "player": {}, "position": 5}]), ["shot.freeze_frame[1].location: two numbers expected", "shot.freeze_frame[1].player.id: integer required", "shot.freeze_frame[1].teammate: boolean expected", "shot.freeze_frame[1].position: object expected"]),
        ({**sound, "related_events": [1]}, ["related_events: list of texts expected"]), ({**sound, "related_events": None}, ["related_events: list of texts expected"]), ({**sound, "related_events": ["a", None]}, ["related_events: list of texts expected"]), ({**sound, "related_events": []}, []),
        ({**sound, "location": [1, True]}, ["location: two numbers expected"]), ({**sound, "possession_team": "x"}, ["possession_team: object expected"]), ({**sound, "timestamp": 5}, ["timestamp: text expected"]), ({**sound, "tactics": []}, ["tactics: object expected"]),
        ({**sound, "type": {"id": 30, "name": "Pass"}, "shot": 5, "team": None}, []), (with_shot(outcome={"id": 1}), ["shot.outcome: id and name go together"]), (with_shot(technique={"id": "1", "name": "n"}), ["shot.technique.id: integer required"]),
    ]
    docs = spark.createDataFrame([(1, json.dumps([c for c, _ in cases]))], "match_id long, json string")
    assert [r.errors for r in D.validate_events(docs).orderBy("position").collect()] == [e for _, e in cases]


def test_ids_as_text_are_scanned(spark):
    one = {"match_id": "5", "competition": {"competition_id": "1"}, "season": {"season_id": 2}, "home_team": {"home_team_id": "7", "home_team_name": "x"}, "away_team": {"away_team_id": 3, "away_team_name": "y"}}
    row = D.scan_matches(spark.createDataFrame([(json.dumps([one]),)], "json string")).first()
    assert (row.match_id, row.competition_id, row.season_id, row.home_team_id, row.away_team_id) == (5, 1, 2, 7, 3)


def plain_newton(x, y, c):
    z, w, ridge = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1), np.array([0.0 if c is None else 1 / c] * x.shape[1] + [0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
    return w


def test_all_fits_at_once_equal_single_ones(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 4)) * [1, 3, 0.2, 1]
    y = (rng.random(500) < 1 / (1 + np.exp(-(x @ [1.0, -1.0, 2.0, 0.0] - 2)))).astype(int)
    fold = np.arange(500) % 5
    rows = spark.createDataFrame([(i, int(k), int(b), *map(float, v)) for i, (k, b, v) in enumerate(zip(fold, y, x))], "row_id int, fold int, y int, a double, b double, c double, d double").repartition(3)
    columns, cs = ["a", "b", "c", "d"], [0.01, 0.1, 1.0, 10.0]
    fits = {(r.fold, r.c): r.weights for r in models.fold_fits(rows, columns, cs).collect()}
    assert len(fits) == 20
    for (k, c), w in fits.items():
        assert w == pytest.approx(list(plain_newton(x[fold != k], y[fold != k], c)), abs=1e-7)
    # MLlib stops earlier, but agrees
    train = models.assembled(rows.filter("fold <> 2"), columns)
    model = models.logistic(0.1, 400).fit(train)
    assert fits[2, 0.1] == pytest.approx([*model.coefficients, model.intercept], abs=1e-5)
    scores = models.out_of_fold_scores(rows, columns, models.fold_fits(rows, columns, [0.1])).collect()
    assert len(scores) == 500
    for r in scores[:50]:
        assert r.p == pytest.approx(1 / (1 + np.exp(-(np.append(x[r.row_id], 1.0) @ fits[r.fold, 0.1]))), abs=1e-9)


def test_platt_against_newton_and_failures(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=400) * 3
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.5 * z + 1)))).astype(int)
    table = spark.createDataFrame([(float(a), int(b)) for a, b in zip(z, y)], "z double, y int")
    assert models.fit_platt(table) == pytest.approx(tuple(plain_newton(z[:, None], y, None)), abs=1e-7)
    with pytest.raises(ValueError, match="not converged"):
        models.fit_platt(spark.createDataFrame([(float(k), int(k > 3)) for k in range(8)], "z double, y int"))
    with pytest.raises(ValueError, match="not finite"):
        models.fit_platt(spark.createDataFrame([(None, 1), (1.0, 0)], "z double, y int"))


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_store_keeps_batches(spark, tmp_path):
    store = Store.create(spark, f"file://{tmp_path}/s", 3)
    frame = lambda rows: spark.createDataFrame(rows, "k int, g int, v string")
    batch = lambda rows, scope=None: {"t": Batch(frame(rows), ("k",), ("g", "v"), scope)}
    held = lambda: sorted(tuple(r) for r in Store(spark, f"file://{tmp_path}/s").read("t").collect())
    first, second = [(1, 1, "a"), (2, 1, None)], [(2, 1, None), (3, 2, "c")]
    assert tuple(store.merge(batch(first)).first()) == ("t", 2, 2, 0, 2) and held() == sorted(first, key=lambda r: r[0])
    for bad, reason in (([(2, 1, "x"), (9, 9, "y")], "changed"), ([(7, 1, "a"), (7, 2, "b")], "repeated"), ([(None, 1, "a")], "null")):
        with pytest.raises(Refused, match=reason):
            store.merge(batch(bad))
        assert held() == first
    with pytest.raises(Refused, match="missing"):
        store.merge(batch([(2, 1, None)], lambda part: part.filter("g = 1")))
    with pytest.raises(Refused, match="key is"):
        store.merge({"t": Batch(frame(first), ("g",))})
    assert tuple(store.merge(batch(second)).first()) == ("t", 2, 1, 1, 3) and held() == [*first, (3, 2, "c")]
    assert tuple(store.merge(batch(second)).first()) == ("t", 2, 0, 2, 3) and len(store.parts("t")) == 2
    assert tuple(store.merge(batch([])).first()) == ("t", 0, 0, 0, 3)
    # a second table in the same run fails: the first one's rows are not seen either
    with pytest.raises(Refused):
        store.merge({"t": Batch(frame([(5, 5, "e")]), ("k",), ("g", "v")), "u": Batch(frame([(1, 1, "a"), (1, 1, "a")]), ("k",))})
    assert held() == [*first, (3, 2, "c")] and store.names() == ["t"]
    runs = [r.status for r in store.runs().orderBy("seq").collect()]
    assert runs.count("failed") == 6 and runs.count("succeeded") == 5 and M.manifest_errors(store.runs()).count() == 0
    with pytest.raises(Exception, match="(?i)already exists"):
        Store.create(spark, f"file://{tmp_path}/s")


def test_store_after_a_crash_and_beside_another_writer(spark, tmp_path):
    store = Store.create(spark, f"file://{tmp_path}/s", 2)
    rows = spark.createDataFrame([(1, "a")], "k int, v string")
    store.merge({"t": Batch(rows, ("k",), ("v",))})
    seq, version = store._last()
    store._append("gone", "running", seq + 1, version.buckets, [])  # its writer died
    assert store.read("t").count() == 1
    store.merge({"t": Batch(rows, ("k",), ("v",))})
    assert {r.run_id: r.status for r in store.runs().collect()}["gone"] == "interrupted"
    with pytest.raises(Exception, match="(?i)already exists"):
        store._append("late", "succeeded", seq + 1, version.buckets, [])  # from the version before


def test_bucketed_joins_shuffle_nothing(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = {t: bucketed(spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v")), ["k"], 4, f"file://{tmp_path}/{t}") for t, n in (("a", 50), ("b", 40), ("c", 45))}
        assert exchanges(Q.expect_foreign_key(kept["a"], ["k"], kept["b"], ["k"], "x")) == 1  # of the counts, one row a task
        orphans = kept["a"].join(kept["b"], "k", "left_anti").join(kept["c"], "k", "left_anti")
        assert exchanges(orphans) == 0 and orphans.count() == 5
        extras = M.scope_extras(kept["a"], kept["b"], kept["c"], ["k"], ["k"])
        assert exchanges(extras) == 0 and extras.count() == 5
        assert exchanges(M.changed_rows(kept["b"], kept["a"], ["k"], ["v"])) == 0
        # a session that did not write the part learns its buckets
        spark.sql(f"DROP TABLE {store_module._name(f'file://{tmp_path}/b')}")
        again = store_module.open_bucketed(spark, f"file://{tmp_path}/b", ["k"], 4)
        assert exchanges(kept["a"].join(again, "k", "left_anti")) == 0 and again.count() == 40
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plain_boosting(x, y, point, rounds):
    """Scores of all rows by trees grown best first on whole columns of bins, one fit alone."""
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)

        def split(rows):
            best = None
            for j in range(x.shape[1]):
                for b in range(x[:, j].max() + 1):
                    low = rows[x[rows, j] <= b]
                    high = rows[x[rows, j] > b]
                    if min(len(low), len(high)) < point.least or min(h[low].sum(), h[high].sum()) < B.LEAST_CURVE:
                        continue
                    gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[high].sum() ** 2 / (h[high].sum() + 1) - g[rows].sum() ** 2 / (h[rows].sum() + 1)
                    if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-9)):
                        best = (gain, j, b, low, high)
            return best

        leaves = [(np.arange(len(y)), [])]
        found = [split(leaves[0][0])]
        while len(leaves) < point.leaves and any(found):
            k = max((i for i, s in enumerate(found) if s), key=lambda i: found[i][0])
            _, j, b, low, high = found.pop(k)
            _, path = leaves.pop(k)
            for rows, side in ((low, True), (high, False)):
                leaves.append((rows, [*path, (j, b, side)]))
                found.append(split(rows))
        values = [(path, -point.step * g[rows].sum() / (h[rows].sum() + 1)) for rows, path in leaves]
        for (rows, _), (_, value) in zip(leaves, values):
            margin[rows] += value
        trees.append(values)
    return margin, trees


def test_boosting_of_all_fits_equals_plain_trees(spark):
    rng = np.random.default_rng(8)
    n = 400
    a, b, c = rng.integers(0, 9, n).astype(float), rng.integers(0, 2, n).astype(float), rng.integers(0, 5, n) / 4
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.6 * (a - 4) * np.where(b > 0, 1, -1) + c)))).astype(int)
    fold = np.arange(n) % 3
    rows = spark.createDataFrame([(int(k), int(t), float(u), float(v), float(w)) for k, t, u, v, w in zip(fold, y, a, b, c)], "fold int, y int, a double, b double, c double").repartition(3)
    points = [B.Point(0.1, 4, 10), B.Point(0.3, 7, 20)]
    columns = ["a", "b", "c"]
    edges = B.bin_edges(rows, columns)
    x = np.column_stack([np.searchsorted(e, v, side="left") for e, v in zip(edges, (a, b, c))])
    got = {}
    for r in B.boosted_scores(rows, columns, points, folds=3, rounds=10).collect():
        got.setdefault((r.step, r.leaves, r.fold), []).append((r.y, round(r.p, 9), r.weight))
    for point in points:
        for k in range(3):
            train = fold != k
            margin, trees = plain_boosting(x[train], y[train].astype(float), point, 10)
            base = np.log(y[train].mean() / (1 - y[train].mean()))
            expected = {}
            for row, label in zip(x[~train], y[~train]):
                z = base + sum(value for tree in trees for path, value in tree if all((row[j] <= at) == side for j, at, side in path))
                key = (int(label), round(float(1 / (1 + np.exp(-z))), 9))
                expected[key] = expected.get(key, 0) + 1
            found = {}
            for label, p, weight in got[point.step, point.leaves, k]:
                found[label, p] = found.get((label, p), 0) + weight
            assert found == expected


def test_bins_of_columns(spark):
    df = spark.createDataFrame([(0.0, 5.0, None), (1.0, 5.0, 2.0), (1.0, 5.0, 3.0)], "a double, b double, c double").repartition(2)
    edges = B.bin_edges(df, ["a", "b", "c"], 4)
    assert [e.tolist() for e in edges] == [[0.0, 1.0], [5.0], [2.0, 3.0]]
    cells = B.cells(df.withColumn("fold", F.lit(0)).withColumn("y", F.lit(1)), ["a", "b", "c"], edges).collect()
    assert sorted((r.b0, r.b1, r.b2, r.n, r.ones) for r in cells) == [(0, 0, 0, 1.0, 1.0), (1, 0, 0, 1.0, 1.0), (1, 0, 1, 1.0, 1.0)]


def test_pages_by_token(spark):
    rng = np.random.default_rng(9)
    rows = [(k, None if x == 3 else int(x), None if y == 0 else f"s{y}") for k, (x, y) in enumerate(rng.integers(0, 5, (230, 2)))]
    table = spark.createDataFrame(rows, "id int, a int, b string").repartition(3)
    order = {"a": False, "b": True, "id": False}
    want = sorted(sorted(sorted(rows), key=lambda r: r[2] or "", reverse=True), key=lambda r: (r[1] is None, r[1] or 0))
    token, got, pages = R.START, [], 0
    while token is not None:
        page, token = R.page_from(table, order, 50, token)
        got += [tuple(r) for r in page.orderBy("place").collect()]
        pages += 1
    assert pages == 5 and [r[:3] for r in got] == want and [r[3] for r in got] == list(range(1, 231))
    empty, token = R.page_from(table.limit(0), order, 50)
    assert empty.count() == 0 and token is None and empty.columns == ["id", "a", "b", "place"]
    plan = table.filter(R._after(list(order.items()), (1, "s2", 7)))._jdf.queryExecution().optimizedPlan().toString()
    assert ">= 1" in plan


def test_boosting_needs_both_labels(spark):
    one = spark.createDataFrame([(k % 2, 1, float(k)) for k in range(10)] + [(None, 0, 1.0), (0, None, 1.0)], "fold int, y int, a double")
    with pytest.raises(ValueError, match="both labels"):
        B.boosted_scores(one, ["a"], [B.Point(0.1, 4, 1)], folds=2, rounds=1)


def test_last_label_of_rows_that_tie_is_the_first_in_the_file(spark, tmp_path):
    from shotlake import registry

    rows = [(s, 7, 2, flag, "O") for s in range(50) for flag in "ARN"] + [(s, 6, 9, "R", "F") for s in range(50)]
    columns = "l_suppkey long, l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {r.label for r in registry.QUERIES["dim_last_label_in_scope"](spark, str(tmp_path)).collect()} == {"AO"}


def test_last_label_with_nulls_and_least_numbers_is_that_of_its_sql(spark, tmp_path):
    import duckdb

    from shotlake import registry

    rows = [(1, 7, 1, "A", "O"), (1, None, 1, "R", "O"), (2, 7, 1, "A", "O"), (2, 8, 1, None, "O"), (3, 7, 1, None, "O"), (4, 7, None, "A", "O"), (4, 7, 3, "R", "O"), (None, 7, 1, "N", "F"), (5, None, None, "A", "O"), (6, -(2**63), 1, "A", "O"), (6, 5, 1, "R", "O")]
    columns = "l_suppkey long, l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    connection = duckdb.connect()
    connection.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    theirs = connection.sql(registry.ORACLES["dim_last_label_in_scope"]).fetchall()
    assert sorted(map(str, map(tuple, registry.QUERIES["dim_last_label_in_scope"](spark, str(tmp_path)).collect()))) == sorted(map(str, theirs))


def test_a_season_of_many_matches_comes_in_documents_of_bounded_size(spark):
    from shotlake import registry  # noqa: F401
    from shotlake.plans.normalization import match_documents

    sizes = match_documents(spark, "/root/testdata/sf0.1").select(F.size(F.from_json("json", "array<string>")).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("n")).first()
    assert sizes.most <= 1000 and sizes.n == 150_000  # whole seasons have more than 4,000 here


def test_documents_take_little_disk_and_are_dealt_by_size(spark, sf_dir, monkeypatch):
    from shotlake import registry  # noqa: F401
    from shotlake.plans import normalization as N
    from shotlake.sources import shared

    monkeypatch.setattr(N, "_files", {})
    for kind in ("events", "lineups"):
        docs = N.documents(spark, sf_dir, kind)
        text = docs.agg(F.sum(F.length("json"))).first()[0]
        files = spark.read.format("binaryFile").load(next(p for (_, _, k), p in N._files.items() if k == kind))
        assert files.agg(F.sum("length")).first()[0] * 4 < text
    monkeypatch.setattr(shared, "_shares", {})
    monkeypatch.setattr(shared, "SHARE", 1 << 12)
    assert shared.shares(spark, f"{sf_dir}/lineitem.parquet") > 4
    assert "hashpartitioning(l_orderkey" in N.event_documents(spark, sf_dir)._jdf.queryExecution().toString()


def test_shuffles_after_a_view_begin_with_shares_of_bounded_size(spark, sf_dir, monkeypatch):
    from shotlake import registry
    from shotlake.sources import shared

    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    monkeypatch.setattr(shared, "_shares", {})
    monkeypatch.setattr(shared, "SHARE", 1 << 12)
    plan = registry.QUERIES["staged_duplicate_keys"](spark, sf_dir)._jdf.queryExecution().toString()
    n = int(spark.conf.get(name))
    spark.conf.unset(name)
    assert n > 4 and f", {n})" in plan.split("Physical Plan")[-1]


def test_encoded_rows_are_joined_once(spark, sf_dir):
    from shotlake import registry  # noqa: F401
    from shotlake.plans.modelling import encoded_rows

    files = encoded_rows(spark, sf_dir)[0].inputFiles()
    assert files and all("/eligible-" in f for f in files)


def test_ids_beyond_four_bytes_are_read(spark):
    big = 3_000_000_000
    match = {"match_id": big, "competition": {"competition_id": str(big)}, "season": {"season_id": 1}, "home_team": {"home_team_id": big + 1, "home_team_name": "H"}, "away_team": {"away_team_id": big + 2, "away_team_name": "A"}, "match_date": "1999-01-01"}
    text = lambda *items: spark.createDataFrame([(big, json.dumps(list(items)))], "match_id long, json string")
    m = D.scan_matches(text(match)).first()
    assert (m.match_id, m.competition_id, m.home_team_id, m.away_team_id) == (big, big, big + 1, big + 2)
    e = D.scan_events(text({"id": "a", "team": {"id": big, "name": "T"}, "player": {"id": big + 1, "name": "P"}})).first()
    assert (e.team_id, e.player_id) == (big, big + 1)
    teams, members = D.scan_lineups(text({"team_id": big, "team_name": "T", "lineup": [{"player_id": big + 1, "player_name": "P"}]}))
    assert (teams.first().team_id, members.first().team_id, members.first().player_id) == (big, big, big + 1)


def test_event_documents_are_made_row_by_row(spark, sf_dir):
    """Each event becomes text on its own, after rows are dealt out; no transform runs over a match's list of rows."""
    from shotlake import registry  # noqa: F401
    from shotlake.plans.normalization import event_documents

    made = event_documents(spark, sf_dir)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(invoke(StructsToJson" in plan  # what is gathered is text already
    assert made.count() == made.select("match_id").distinct().count()


def test_lineups_meet_in_shares_of_the_tables(spark, sf_dir, monkeypatch):
    from shotlake import registry  # noqa: F401
    from shotlake.plans import normalization as N

    monkeypatch.setattr(N, "shares", lambda *a: 9)
    assert "hashpartitioning(match_id" in (plan := N.scan_lineups(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()) and plan.count("9), REPARTITION_BY_NUM") == 2


def test_boosting_takes_all_rounds_and_no_job_a_round(spark, sf_dir, monkeypatch):
    import inspect

    from shotlake import registry

    asked = {}

    def seen(rows, columns, *args, **named):
        asked.update(inspect.signature(boosted).bind(rows, columns, *args, **named).arguments)
        return boosted(rows, columns, [B.Point(0.1, 4, 2)], rounds=1)

    boosted = B.boosted_scores
    monkeypatch.setattr(B, "boosted_scores", seen)
    registry.QUERIES["gbt_fit"](spark, sf_dir)
    assert set(asked) == {"rows", "columns"} and inspect.signature(boosted).parameters["rounds"].default == 200

    rows = spark.createDataFrame([(k % 3, int(k % 5 == 0), float(k % 7)) for k in range(90)], "fold int, y int, a double")

    def jobs(rounds):
        group = f"boosting-{rounds}"
        spark.sparkContext.setJobGroup(group, group)
        boosted(rows, ["a"], [B.Point(0.1, 4, 2)], folds=3, rounds=rounds)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(2) == jobs(12)


def test_boosting_without_a_path_of_the_machines_gives_the_same_scores(spark, monkeypatch):
    rows = spark.createDataFrame([(k % 2, int(k % 3 == 0), float(k % 7)) for k in range(60)], "fold int, y int, a double").repartition(2)
    scores = lambda: sorted(tuple(r) for r in B.boosted_scores(rows, ["a"], [B.Point(0.1, 3, 2)], folds=2, rounds=2).collect())
    known = scores()
    monkeypatch.setattr(B, "local_folder", lambda spark, folder: None)
    assert scores() == known and len(known) > 4


def test_boosting_deletes_the_scores_of_earlier_rounds(spark):
    from pathlib import Path

    folder = Path(D.shared_folder(spark).removeprefix("file://"))
    rows = spark.createDataFrame([(k % 2, int(k % 3 == 0), float(k % 7)) for k in range(60)], "fold int, y int, a double")
    tables = lambda: {p.name for kind in ("cells", "scores") for p in folder.glob(f"{kind}-*")}
    before = tables()
    scored = B.boosted_scores(rows, ["a"], [B.Point(0.1, 4, 2)], folds=2, rounds=10)
    assert len(tables() - before) == 1 and scored.agg(F.sum("weight")).first()[0] == 60


def test_checks_parse_each_document_once(spark):
    """Also where rows with a fault are filtered out, and for all parts of a lineup."""
    docs = spark.createDataFrame([(1, '[{"team_id":1,"lineup":[{"player_id":2,"player_name":"P","cards":[{"card_type":5}]}]},7]'), (2, "{"), (3, None)], "match_id long, json string").repartition(1)
    checked = D.validate_lineups(docs)
    for frame in (C.quarantine(docs, "lineups")[0], checked):
        assert frame._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    found = sorted((r.match_id, r.part, -1 if r.position is None else r.position, tuple(r.errors)) for r in checked.collect())
    assert found == [(1, "card", 0, ("card_type: text required",)), (1, "member", 0, ()), (1, "team", 0, ()), (1, "team", 1, ("not an object",)), (2, "document", -1, ("not JSON",)), (3, "document", -1, ("no document",))]


def network_table(spark, n=640):
    rng = np.random.default_rng(3)
    u, v, flag = rng.normal(size=n).round(1), rng.normal(size=n).round(1), rng.integers(0, 2, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(u * v + flag - 0.5)))).astype(int)
    rows = [(i, i % 5, int(b), float(p), int(f), float(q)) for i, (b, p, q, f) in enumerate(zip(y, u, v, flag))]
    return spark.createDataFrame(rows, "row_id int, fold int, y int, u double, flag int, v double").coalesce(1)


def test_networks_of_all_folds_equal_the_librarys_and_step_together(spark):
    rows, columns = network_table(spark), ["u", "flag", "v"]  # 512 rows in one partition for a fit: MLlib's batches are all full

    def scores_and_jobs(group, scores):
        spark.sparkContext.setJobGroup(group, group)
        found = {r.row_id: (r.y, r.fold, r.p) for r in scores().collect()}
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    known, one_by_one = scores_and_jobs("perceptrons", lambda: models.out_of_fold(models.assembled(rows, columns), lambda train: models.perceptron(3, rounds=20)))
    found, together = scores_and_jobs("networks", lambda: networks.network_scores(rows, columns, ["u", "v"], rounds=20))
    assert found.keys() == known.keys() and all(found[k] == pytest.approx(known[k], abs=1e-7) for k in known)
    assert together < one_by_one / 2


def test_network_sums_equal_plain_ones_at_any_weights(spark):
    rows = network_table(spark)
    blocks = [tuple(bytes(c) if isinstance(c, bytearray) else c for c in r) for r in networks.cell_blocks(rows, ["u", "v"], ["flag"]).collect()]
    x = np.array([(r.u, r.v, r.flag) for r in rows.collect()])
    y, fold = (np.array([r[c] for r in rows.collect()], float) for c in ("y", "fold"))
    for scale in (1, 50, 3000):
        w = np.random.default_rng(1).normal(size=8 * 4 + 18) * scale
        first, shift, second, last = networks._layers(w, 3, 8)
        mine, own = x[fold != 2], y[fold != 2]
        with np.errstate(over="ignore"):
            a = 1 / (1 + np.exp(-(mine @ first.T + shift)))
            z = a @ second + last
            left = 1 / (1 + np.exp(-z)) - own
        inner = (left[:, None] * a * (1 - a)).T @ np.column_stack((mine, np.ones(len(mine)))) * second[:, None]
        plain = [len(mine), (np.logaddexp(0, z) - own * z).sum(), *inner.T.ravel(), *np.stack((-(a.T @ left), a.T @ left), axis=1).ravel(), -left.sum(), left.sum()]
        assert sum(networks._block_sums(b, [(2, w)], 2, 3, 8, 5) for b in blocks)[0] == pytest.approx(plain, rel=1e-9, abs=1e-9)


def test_networks_refuse_what_cannot_be_fitted(spark):
    schema = "row_id int, fold int, y int, u double, flag int"
    for bad in ((1, 0, None, 1.0, 1), (1, 0, 2, 1.0, 1), (1, 0, 1, None, 1), (1, 0, 1, float("nan"), 1)):
        with pytest.raises(Exception, match="not finite, or a label"):
            networks.network_fits(spark.createDataFrame([bad, (2, 1, 0, 0.0, 0)], schema), ["u", "flag"], ["u"], rounds=1)
    with pytest.raises(ValueError, match="no rows outside"):
        networks.network_fits(spark.createDataFrame([(1, 0, 1, 1.0, 1), (2, 0, 0, 0.0, 0)], schema), ["u", "flag"], ["u"], rounds=1)


def test_grains_share_one_parsing_of_events_and_one_of_lineups(spark, sf_dir):
    from shotlake import registry  # noqa: F401
    from shotlake.plans.grains import GRAINS, grains

    plans = {k: df._jdf.queryExecution().optimizedPlan().toString() for k, df in grains(spark, sf_dir).items()}
    assert [k for k in GRAINS if "from_json" in plans[k]] == ["competitions", "seasons", "competition_seasons", "teams", "matches", "match_teams"]
