import math

import pytest
from pyspark.sql import functions as F

from shotlake.functions import geometry as G
from shotlake.functions import json_text as J
from shotlake.functions import scores as S
from shotlake.sources.documents import clock

POINTS = {(108, 40): (12, 2 * math.atan(1 / 3)), (112, 40): (8, 2 * math.atan(0.5)), (116, 40): (4, math.pi / 2), (118, 40): (2, 2 * math.atan(2)), (120, 40): (0, math.pi), (120, 10): (30, 0), (120, 0): (40, 0), (60, 0): (math.hypot(60, 40), math.atan2(480, 5184))}


def test_geometry(spark):
    rows = spark.createDataFrame([(float(x), float(y)) for x, y in POINTS], "x double, y double")
    for r in rows.select("x", "y", G.distance_to_goal(F.col("x"), F.col("y")).alias("d"), G.visible_goal_angle(F.col("x"), F.col("y")).alias("a")).collect():
        assert (r.d, r.a) == pytest.approx(POINTS[r.x, r.y], abs=1e-12)


def test_mirror_and_monotony(spark):
    at = spark.range(0, 81).select(F.col("id").cast("double").alias("y"), F.lit(100.0).alias("x"))
    x, y = F.col("x"), F.col("y")
    rows = at.orderBy("y").select(G.visible_goal_angle(x, y).alias("a"), G.visible_goal_angle(x, F.lit(80.0) - y).alias("m")).collect()
    assert all(abs(r.a - r.m) < 1e-12 for r in rows)
    assert all(p.a < q.a for p, q in zip(rows[:40], rows[1:41]))


def test_location_errors(spark):
    cases = [(120.0, 36.0, "on a post"), (120.1, 44.0, "on a post"), (120.2, 40.0, "x out of range"), (-0.1, 40.0, "x out of range"), (50.0, 80.5, "y out of range"), (float("nan"), 1.0, "not finite"), (None, 1.0, "missing"), (120.1, 40.0, None), (0.0, 0.0, None)]
    rows = spark.createDataFrame(cases, "x double, y double, want string")
    assert rows.filter(~G.location_error(F.col("x"), F.col("y")).eqNullSafe(F.col("want"))).count() == 0


def test_bins_differ_at_three_fifths(spark):
    rows = spark.createDataFrame([(0.0, 0, 0), (0.2, 1, 1), (0.6, 2, 3), (0.999999999999, 4, 4), (1.0, 4, 4), (None, None, None)], "p double, a int, b int")
    wrong = rows.filter(~S.edge_bin(F.col("p"), S.EQUAL_WIDTH_EDGES).eqNullSafe(F.col("a")) | ~S.edge_bin(F.col("p"), S.RAW_ANCHOR_EDGES).eqNullSafe(F.col("b")))
    assert wrong.count() == 0


def test_losses(spark):
    rows = spark.createDataFrame([(1, 0.5), (0, 0.5)], "y int, p double")
    one = rows.agg(F.avg(S.log_loss(F.col("y"), F.col("p"))), F.avg(S.squared_error(F.col("y"), F.col("p")))).first()
    assert one[0] == pytest.approx(math.log(2)) and one[1] == 0.25
    far = spark.createDataFrame([(1, 0.0), (0, 1.0)], "y int, p double").agg(F.avg(S.log_loss(F.col("y"), F.col("p")))).first()[0]
    assert far == pytest.approx(-math.log(1e-15))


def test_clock(spark):
    cases = [("00:00", 0), ("90:59", 5459), ("10:60", None), ("1:2", None), ("x", None), (None, None), ("-1:00", None), ("120:05", 7205)]
    got = spark.createDataFrame(cases, "t string, want int").select("want", clock(F.col("t")).alias("c")).collect()
    assert [None if r.c is None else int(r.c.total_seconds()) for r in got] == [w for _, w in cases]


def test_json_keys(spark):
    texts = ['{"a": {"bad" : 1, "x": [ {"bad": 2, "y": "é"} ]}}', '{"a": "\\"bad\\": 1"}', None, "{}"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = rows.select(J.has_key(F.col("t"), "bad").alias("has"), J.strip_key(F.col("t"), "bad").alias("clean")).collect()
    assert [r.has for r in got] == [True, False, False, False]
    assert [r.clean for r in got] == ['{"a":{"x":[{"y":"é"}]}}', texts[1], None, "{}"]


def test_keys_spelt_with_escapes(spark):
    from shotlake.functions import json_text as J

    texts = ['{"\\u0066orbidden": 1}', '{"a": {"forbidde\\u006E" : 2}}', '{"a": "\\"forbidden\\": no"}', '{"forbidden2": 1}', None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.f for r in rows.select("k", J.has_key(rows.t, "forbidden").alias("f")).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: False}
    left = rows.filter("k < 2").select(J.strip_key(rows.t, "forbidden").alias("s")).collect()
    assert [r.s for r in left] == ["{}", '{"a":{}}']


def test_distance_at_a_band_edge_is_that_of_the_sql(spark):
    """Places 10, 20 or 30 yards off, where hypot() and the root of the sum of squares lie on two sides of the edge."""
    at = [(i / 10, j / 10) for i in range(600, 1201) for j in range(801)]
    plain = {(x, y): math.sqrt((120 - x) * (120 - x) + (y - 40) * (y - 40)) for x, y in at}
    edges = [(x, y) for (x, y), d in plain.items() if any((math.hypot(120 - x, y - 40) < e) != (d < e) for e in (10, 20, 30))]
    assert edges
    rows = spark.createDataFrame(edges, "x double, y double")
    assert all(r.d == plain[r.x, r.y] for r in rows.select("x", "y", G.distance_to_goal(rows.x, rows.y).alias("d")).collect())
