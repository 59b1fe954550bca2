import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracksmith.functions import geometry as g
from tracksmith.operators import smoothing, spatial, tables, trips
from tracksmith.operators.kalman import State, truncated_moments
from tracksmith.operators.search import best_path
from tracksmith.sources import described


def test_truncation_is_the_identity_on_wide_bounds():
    assert truncated_moments(-math.inf, math.inf) == (0.0, 0.0, 1.0)
    logp, mean, var = truncated_moments(-9, 9)
    assert abs(logp) < 1e-9 and abs(mean) < 1e-9 and abs(var - 1) < 1e-9
    logp, mean, var = truncated_moments(0, math.inf)
    assert math.isclose(logp, math.log(0.5)) and math.isclose(mean, math.sqrt(2 / math.pi)) and math.isclose(var, 1 - 2 / math.pi)
    up, down = truncated_moments(0.3, 1.2), truncated_moments(-1.2, -0.3)
    assert np.allclose(up, (down[0], -down[1], down[2]))


def test_unscented_measurement_equals_the_linear_one_for_linear_functions():
    p = np.array([[2.0, 0.3], [0.3, 1.0]])
    a, b, h = State([1, 2], p), State([1, 2], p), np.array([[1.0, 0.5]])
    d1, d2 = a.measure([3.0], h, np.eye(1)), b.measure_unscented([3.0], lambda s: h @ s, np.eye(1))
    assert math.isclose(d1, d2) and np.allclose(a.x, b.x) and np.allclose(a.p, b.p)


def test_constraints():
    s = State([1, 2], np.eye(2))
    s.constrain([5], np.array([[1.0, 1.0]]))
    assert np.allclose(s.x, [2, 3]) and abs(np.array([1, 1]) @ s.p @ np.array([1, 1])) < 1e-12
    t = State([0, 0], np.eye(2))
    cost = t.bound(np.array([[1.0, 0.0]]), [0.0], [math.inf])
    assert math.isclose(cost, math.log(2)) and t.x[0] > 0 and t.x[1] == 0
    assert math.isclose(State([0, 0], np.eye(2)).bound_distance(np.array([1.0, 0.0]), low=0.0), math.log(2))


def test_a_straight_trip_is_smoothed_and_a_wild_one_rejected():
    rows = np.array([[3.0 * k, 2.0 * k, 3.6, 2, 2] for k in range(30)])
    rows[10:13, 0] = np.nan
    out = smoothing.backward(smoothing.forward(rows))
    assert len(out) == 30 and np.allclose(out[11].x[:2], [33, 22], atol=2)
    rows[20, 0] += 100_000
    assert smoothing.forward(rows) is None
    assert smoothing.forward(rows[:1]) is None


def _trail(*positions):
    """States at such x, as sure as can be, with the velocity that leads to the next."""
    xs = np.array(positions, float)
    v = np.append(np.diff(xs), 0)
    return [State([x, 0, u, 0], np.eye(4)) for x, u in zip(xs, v, strict=True)]


@pytest.mark.parametrize("samples", [19, 20, 21])
def test_a_stop_counts_from_twenty_samples(samples):
    # 10 steps of 50 m, one sample that stands still, so many more there, then 10 steps away.
    away = [50.0 * k for k in range(11)]
    trail = _trail(*away, *[500.0] * samples, *[500 + 50.0 * k for k in range(1, 11)])
    found = smoothing.stops(trail)
    assert [k for k, _ in found] == [0, *([10 + samples] if samples >= 20 else []), len(trail) - 1]
    assert abs(found[0][1].x[0]) < 1e-9 and found[-1][1].x[0] == 1000
    if samples >= 20:  # the fused state, not the raw one
        assert abs(found[1][1].x[0] - 500) < 1 and np.allclose(found[1][1].x[2:], 0) and found[1][1].p[0, 0] < 1


def test_a_trip_that_never_leaves_is_one_place():
    found = smoothing.stops(_trail(*[0.0] * 30))
    assert [k for k, _ in found] == [29] and found[0][1].p[0, 0] < 1
    assert smoothing.stops([]) == []
    assert [k for k, _ in smoothing.stops(_trail(*[30.0 * k for k in range(60)]))] == [0, 59]


def test_trimming_holds_a_state_at_either_end():
    trail = _trail(*[0.0] * 5, *[40.0 * k for k in range(1, 6)], *[200.0] * 4)
    out, noise = smoothing.trim(trail)
    # The fifth state stands at 0 but moves on already; the last of five steps stands at the end.
    x, p = np.zeros(2), np.array([3.0, 2.0])  # variance of place and velocity of the held state
    for _ in range(3):
        p = p + [2, 0]
        p[0] = p[0] / (p[0] + 1)
    assert np.allclose(noise, smoothing.NOISE) and len(out) == 1 + 5 + 1
    assert np.allclose(out[0].x[:2], x) and math.isclose(out[0].p[0, 0], p[0] + 2) and math.isclose(out[0].p[2, 2], 2)
    assert [s.x[0] for s in out[1:-1]] == [0, 40, 80, 120, 160] and abs(out[-1].x[0] - 200) < 1e-9
    assert len(smoothing.trim(_trail(*[0.0] * 9))[0]) == 2  # without a departure: its two ends
    assert len(smoothing.trim(_trail(0.0, 50.0))[0]) == 2
    same, shared = smoothing.trim(trail, compat=True)
    # One matrix for all: no noise in velocity, and the variances of both ends in place.
    assert math.isclose(shared[0, 0], 2 + 1 + 1) and shared[2, 2] == 0 and same[0].p[2, 2] == 0
    assert not np.allclose(same[0].p, out[0].p)


def test_affinity_propagation_finds_two_places():
    rng = np.random.default_rng(1)
    pts = np.vstack([rng.normal(0, 5, (10, 2)), rng.normal(5000, 5, (10, 2))])
    label = smoothing.affinity_propagation(pts)
    assert len(set(label[:10])) == 1 and len(set(label[10:])) == 1 and label[0] != label[10]


def test_search_along_a_chain_and_round_an_obstacle():
    path, priority = best_path(0, lambda s: s == 4, lambda s: [s + 1], heuristic=lambda s: 4 - s)
    assert path == [0, 1, 2, 3, 4] and priority == 4
    assert best_path(0, lambda s: s == 9, lambda s: [s + 1] if s < 3 else []) == (None, None)
    assert best_path(0, lambda s: s == 4, lambda s: [s + 1], max_visited=2) == (None, None)
    cost = {(0, 1): 1, (0, 2): 5, (1, 3): math.inf, (2, 3): 1}
    path, _ = best_path(0, lambda s: s == 3, lambda s: [b for a, b in cost if a == s], move_cost=lambda a, b: cost[a, b])
    assert path == [0, 2, 3]


def test_projection(spark):
    rows = [(-73.5, 45.5, 304800.0, 5040008.6581), (-73.5673, 45.5017, 299540.6466, 5040199.7831), (-71.0, 46.8, 495625.5335, 5187530.4858)]
    df = spark.createDataFrame(rows, "lon double, lat double, ex double, ey double").withColumn("p", g.to_plane(F.col("lon"), F.col("lat")))
    for r in df.withColumn("b", g.to_geographic(F.col("p.x"), F.col("p.y"))).collect():
        assert abs(r.p.x - r.ex) < 1e-3 and abs(r.p.y - r.ey) < 1e-3
        assert abs(r.b.lon - r.lon) < 1e-10 and abs(r.b.lat - r.lat) < 1e-10


def test_log_erfc(spark):
    df = spark.createDataFrame([(x / 4,) for x in range(-12, 20)], "x double").select("x", g.log_erfc(F.col("x")).alias("v"))
    for r in df.collect():
        assert abs(r.v - math.log(math.erfc(r.x))) < 2e-6


def test_polyline(spark):
    line = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in [(0, 0), (100, 0), (100, 100)]])
    df = spark.createDataFrame([(50.0, 10.0), (130.0, 40.0), (-5.0, 0.0)], "x double, y double")
    got = df.select(g.nearest_on_line(line, F.col("x"), F.col("y")).alias("n"), g.line_length(line).alias("len")).select("n.*", "len").collect()
    assert [(r.distance, r.measure, r.len) for r in got] == [(10.0, 50.0, 200.0), (30.0, 140.0, 200.0), (5.0, 0.0, 200.0)]
    at = df.limit(1).select(g.point_at(line, F.lit(150.0)).alias("a"), g.point_at(line, F.lit(999.0)).alias("b")).first()
    assert (at.a.x, at.a.y, at.b.x, at.b.y) == (100.0, 50.0, 100.0, 100.0)


def test_an_id_that_comes_back_is_another_trip(spark):
    df = spark.createDataFrame([("f", k, t) for k, t in enumerate("aabba")], "file string, pos long, trip string")
    assert [r.session for r in trips.sessions_by_id(df, "trip", "pos", "file").orderBy("pos").collect()] == [1, 1, 2, 2, 3]


@pytest.mark.parametrize("cell", [7.0, 50.0])
def test_box_join_has_each_pair_once(spark, cell):
    rng = np.random.default_rng(3)
    boxes = [(int(k), float(x), float(y), float(x + w), float(y + h)) for k, (x, y, w, h) in enumerate(zip(*rng.uniform(1, 60, (4, 60)), strict=True))]
    a = spark.createDataFrame(boxes, "i long, a0 double, a1 double, a2 double, a3 double")
    b = spark.createDataFrame(boxes, "j long, b0 double, b1 double, b2 double, b3 double")
    got = sorted((r.i, r.j) for r in spatial.box_join(a, b, ("a0", "a1", "a2", "a3"), ("b0", "b1", "b2", "b3"), cell, ("i", "j")).collect())
    want = sorted((p[0], q[0]) for p in boxes for q in boxes if p[1] < q[3] and q[1] < p[3] and p[2] < q[4] and q[2] < p[4])
    assert got == want


def test_nearest_values_with_ties(spark, tmp_path):
    def stored(rows, schema, name):  # read from files: Spark 4.1 fails to plan k=1 over rows of the driver
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    cases = [([100.0] * 3, 1), ([100.0] * 3 + [160.0, 150.0], 3), ([100.0] * 5, 3), ([100.0] * 4 + [300.0] * 4, 3), ([5.0, 5.0, 7.0, 9.0, 9.0, 9.0, 200.0, 200.0], 2), ([], 2), ([3.0], 2)]
    lefts = [(1, 200.0), (2, 100.0), (3, 8.0), (4, -1.0), (5, 1000.0), (6, 200.0)]
    left = stored(lefts, "a long, v double", "left")
    for n, (values, k) in enumerate(cases):
        rights = [(key, v) for key, v in zip(range(len(values), 0, -1), values, strict=True)]
        want = {(a, b, m + 1) for a, v in lefts for m, (_, b) in enumerate(sorted((abs(v - w), key) for key, w in rights)[:k])}
        near = spatial.nearest_on_axis(left, stored(rights, "b long, w double", f"right{n}"), "a", "v", "b", "w", k)
        assert {(r.a, r.b, r["rank"]) for r in near.collect()} == want


def test_neighbours_in_the_plane_with_ties(spark, tmp_path):
    rng = np.random.default_rng(8)
    left = [(f"a{k}", *map(float, rng.integers(0, 6, 2))) for k in range(40)] + [("far", 5000.0, -3000.0), ("none", None, 1.0), ("nan", float("nan"), 0.0)]
    right = [(k, *map(float, rng.integers(0, 6, 2))) for k in rng.permutation(60).tolist()] + [(900, 1.0, None), (901, 900.0, 900.0)]
    ldf, rdf = spark.createDataFrame(left, "l string, x double, y double"), spark.createDataFrame(right, "r long, x double, y double")
    save = tables.saver(spark, "t")
    for k, cell in ((1, None), (3, None), (5, 0.5), (100, None)):
        got = {}
        for row in spatial.nearest_in_plane(ldf, rdf, "l", "r", k, save, cell).collect():
            got.setdefault(row.l, []).append((row["rank"], row.distance, row.r))
        want = {n: sorted((math.hypot(a - x, b - y), r) for r, a, b in right if b is not None)[:k] for n, x, y in left[:41]}
        assert {n: [(d, r) for _, d, r in sorted(v)] for n, v in got.items()} == want
    assert spatial.nearest_in_plane(ldf.limit(0), rdf, "l", "r", 2, save).count() == 0 == spatial.nearest_in_plane(ldf, rdf.limit(0), "l", "r", 2, save).count()


def test_regions(spark):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    regions = spark.createDataFrame([(7, ring((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))), (3, ring((5, 5), (25, 5), (25, 25), (5, 5)))], "region int, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 2.0, 3.0), (2, 9.0, 8.0), (3, 20.0, 8.0), (4, 50.0, 50.0), (5, None, 1.0), (6, 6.0, 9.0)], "id long, x double, y double")
    for cell in (1.0, 4.0, 100.0):
        assert {r.id: r.region for r in spatial.regions_of(points, regions, "id", "x", "y", cell).collect()} == {1: 7, 2: 3, 3: 3, 4: None, 5: None, 6: 7}
    assert {r.region for r in spatial.regions_of(points, regions.limit(0), "id", "x", "y", 2.0).collect()} == {None}


def test_features_as_files(spark, tmp_path):
    rows = [("a", 1.5, None), ("b", 2.0, 3)]
    df = spark.createDataFrame(rows, "trip_id string, length double, left_turn int")
    more = spark.createDataFrame([("b", 9.0, 4), ("c", 0.0, 1)], df.schema)
    for ending in ("json", "csv"):
        paths = [f"{tmp_path}/one.{ending}", f"{tmp_path}/two.{ending}"]
        described.write(df, paths[0])
        described.write(more, paths[1])
        assert sorted(map(tuple, described.read(spark, paths, df.schema).collect())) == [("a", 1.5, None), ("b", 9.0, 4), ("c", 0.0, 1)]
    with pytest.raises(ValueError):
        described.write(df, f"{tmp_path}/one.txt")


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_turns_take_zeros_with_their_sign(spark):
    ways = [(a, b, c, d) for a in (0.0, -0.0, 2.0, -2.0) for b in (0.0, -0.0, 3.0) for c in (0.0, -0.0, 1.0, -1.0) for d in (0.0, -0.0, -5.0)]
    got = spark.createDataFrame(ways, "a double, b double, c double, d double").select("a", "b", "c", "d", g.turn_angle(*map(F.col, "abcd")).alias("t")).collect()
    assert all(r.t == pytest.approx(math.degrees(math.atan2(r.a * r.d - r.b * r.c, r.a * r.c + r.b * r.d))) for r in got)


def test_neighbours_of_a_crowded_place_are_few(spark):
    saved, save = {}, tables.saver(spark, "t")
    left = spark.range(200).select("id", (F.col("id") % 3).cast("double").alias("x"), F.lit(0.0).alias("y"))
    right = spark.range(300).select(F.col("id").alias("r"), (F.col("id") % 2).cast("double").alias("x"), F.lit(0.0).alias("y"))
    got = spatial.nearest_in_plane(left, right, "id", "r", 2, lambda df, name: saved.setdefault(name, save(df, name))).collect()
    assert {(r.id, r.r, r.distance, r["rank"]) for r in got} == {(i, [(0, 2), (1, 3), (1, 3)][i % 3][n], float(i % 3 == 2), n + 1) for i in range(200) for n in (0, 1)}
    assert len(got) == 400 and all(df.count() <= 12 for name, df in saved.items() if name != "plane-points")


def test_box_join_deals_out_a_crowded_cell(spark, monkeypatch):
    box = lambda df, p: df.select(F.col("id").alias(p), *[F.lit(v).alias(f"{p}{k}") for k, v in enumerate((1.0, 1.0, 9.0, 9.0))])
    a, b = box(spark.range(400), "a"), box(spark.range(50), "b")
    monkeypatch.setattr(spatial, "GROUP_PAIRS", 1000)
    got = spatial.box_join(a, b, ("a0", "a1", "a2", "a3"), ("b0", "b1", "b2", "b3"), 100.0, ("a", "b"))
    assert got.select("a", "b").distinct().count() == got.count() == 400 * 50
    assert max(r.n for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) < 400 * 50 / 4


def test_trips_smoothed_together_are_as_one_by_one():
    r, rides = np.random.default_rng(1), []
    for k in range(60):  # moving and standing ones, gaps, unknown speeds, single rows
        n = int(r.integers(1, 40))
        at = np.arange(n)[:, None] * r.uniform(0, 6, 2) * (k % 3 > 0) + r.normal(0, 1, (n, 2))
        rows = np.column_stack([at, np.where(r.random(n) < 0.2, -1.0, r.uniform(0, 5, n)), r.uniform(1, 4, (n, 2))])
        rows[r.random(n) < 0.15, 0] = np.nan
        rides.append(rows)
    rides[7][:, 0], rides[9][len(rides[9]) // 2 :, 0] = np.nan, 1e5  # nothing seen, a jump
    rides[10] = np.vstack([np.ones((2, 5)), np.full((50, 5), np.nan), np.ones((2, 5))])  # too vague
    x, p, first, length = smoothing.smooth_all(np.vstack(rides), np.array([len(t) for t in rides]))
    for k, rows in enumerate(rides):
        states = smoothing.forward(rows)
        states = smoothing.backward(states) if states else None
        states = smoothing.trim(states)[0] if states else []
        assert length[k] == (len(states) if len(states) >= 2 else 0)
        for j in range(length[k]):
            assert np.allclose(states[j].x, x[first[k] + j], atol=1e-9) and np.allclose(states[j].p, p[first[k] + j], atol=1e-9)


def test_copies_of_a_place_are_its_weight():
    points, times = np.array([[0.0, 0.0], [40.0, 0.0], [90.0, 0.0], [900.0, 5.0]]), [4, 1, 9, 2]
    copies = np.repeat(points, times, 0)
    want = {tuple(copies[k]) for k in smoothing.affinity_propagation(copies)}
    label = smoothing.affinity_propagation(points, weights=times)
    assert {tuple(points[k]) for k in label} == want
    # Many at one place are worth an exemplar of their own.
    assert smoothing.affinity_propagation(points, weights=[900, 1, 900, 1])[0] == 0
