"""The lane path equals a search over all paths; recordings survive a round trip."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from roadweft.functions.geometry import extended
from roadweft.operators import locate
from roadweft.operators.locate import chunk_faults
from roadweft.operators.maps import lane_edges, nearest_lane, route
from roadweft.sources.events import tracks_from_events
from roadweft.sources.recordings import Recording, read_recording


def test_lane_path_is_cheapest(spark):
    """Blocks of any size give the path that a search over all paths gives, the smaller lane on ties, last times first."""
    rng = np.random.default_rng(2)
    links = {(int(a), int(b)): str(rng.choice(["successor", "predecessor", "left neighbour"])) for a, b in rng.integers(0, 8, (24, 2)) if a != b}
    rows = [(r, idx, t * 10, int(x)) for r in "ab" for idx in range(4) for t in range(6) for x in rng.choice(8, rng.integers(1, 4), replace=False)]

    def cost(a, b):
        if a == b:
            return 1
        return 4 if (a, b) not in links or (b, a) not in links else 2 if links[a, b] in ("successor", "predecessor") else 3

    want = set()
    for r, idx in itertools.product("ab", range(4)):
        at = [sorted(x for *k, x in rows if k == [r, idx, t * 10]) for t in range(6)]
        best = min(itertools.product(*at), key=lambda p: (sum(itertools.starmap(cost, itertools.pairwise(p))), p[::-1]))
        want |= {(r, idx, t * 10, x) for t, x in enumerate(best)}
    located = spark.createDataFrame(rows, "recording_id string, idx long, total_nanos long, lane_id long")
    edges = spark.createDataFrame([(*k, v) for k, v in links.items()], "src long, dst long, label string")
    for size in (1, 2, 4, 100):
        assert {tuple(x) for x in locate.single_lane(located, edges, size).select("recording_id", "idx", "total_nanos", "lane_id").collect()} == want
    assert locate.single_lane(located.limit(0), edges).isEmpty()
    assert locate.single_lane(located, edges.limit(0)).count() == len(want)


def test_short_objects_share_a_call(spark):
    """Objects of one block are not a call each, and each keeps its path where batches cut it."""
    located = spark.range(900).selectExpr("id div 3 as idx", "id % 3 as total_nanos", "id div 3 % 5 + id % 2 * 10 as lane_id")
    edges = spark.createDataFrame([], "src long, dst long, label string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = locate.single_lane(located, edges)
        assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
        assert sorted(map(tuple, got.select(*located.columns).collect())) == sorted(map(tuple, located.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_recording_round_trip(spark, tmp_path):
    r = Recording.of(tracks_from_events(spark, "/root/testdata/sf0.001"), host_vehicle_idx=8, projections={"proj_string": "x", None: {"x": 1.0}, 5: {"yaw": 0.5}})
    path = f"{tmp_path}/r.parquet"
    r.write_parquet(path)
    back = read_recording(spark, path)
    assert back.host_vehicle_idx == 8 and back.projections[None]["x"] == 1.0 and back.projections[5]["yaw"] == 0.5
    assert back.df.count() == r.df.count() and back.objects().count() == r.objects().count()


def test_faults_and_routes(spark):
    point = "idx long, total_nanos long, x double, y double, lane_id long"
    located = spark.createDataFrame([(1, 1, 1.0, 1.0, 5), (1, 2, 2.0, 1.0, 5), (1, 3, 3.0, 1.0, 5), (1, 4, 1.0, 1.0, None), (1, 5, 1.0, 1.0, 77), (1, 6, 1.0, 1.0, 6)], point)
    lanes = spark.createDataFrame([(5,), (6,)], "lane_id long")
    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    segments = spark.createDataFrame([(0, ring)], "segment_idx long, ring array<struct<x:double,y:double>>")
    found = chunk_faults(located, lanes, spark.createDataFrame([(5, 0)], "lane_id long, segment_idx long"), segments)
    assert {(r["total_nanos"], r["fault"]) for r in found.collect()} == {(3, "outside"), (4, "no_lane"), (5, "unknown_lane"), (6, "no_segment")}
    edges = spark.createDataFrame([(1, 2, "successor"), (3, 2, "predecessor"), (3, 4, "successor"), (1, 9, "successor")], "src long, dst long, label string")
    assert route(edges, 1, 4) == [1, 2, 3, 4] and route(edges, 4, 1) is None and route(edges, 2, 2) == [2]


def test_short_lines_become_stubs(spark):
    lines = spark.createDataFrame([([(1.0, 2.0)],), ([(1.0, 2.0), (1.0, 2.0)],), ([(0.0, 0.0), (0.0, 0.0), (3.0, 0.0)],)], "line array<struct<x:double,y:double>>")
    got = [[tuple(p) for p in r[0]] for r in lines.select(extended(F.col("line"), 5.0)).collect()]
    assert got == [[(1.0, 1.0), (1.0, 3.0)]] * 2 + [[(-5.0, 0.0), (0.0, 0.0), (0.0, 0.0), (3.0, 0.0), (8.0, 0.0)]]


def test_far_points_have_a_lane(spark):
    rng = np.random.default_rng(5)
    lines = [(i, [tuple(map(float, p)) for p in rng.uniform(-200, 200, (3, 2))]) for i in range(6)]
    lanes = spark.createDataFrame(lines, "lane_id long, centerline array<struct<x:double,y:double>>")
    places = [(1, t, float(x), float(y)) for t, (x, y) in enumerate(rng.uniform(-1, 1, (60, 2)) * np.repeat([200, 900, 30_000], 20)[:, None])]
    points = spark.createDataFrame([*places, (2, 0, float("nan"), 0.0), (2, 1, None, 0.0)], "idx long, total_nanos long, x double, y double")

    def distance(x, y, line):
        p = np.array([x, y])
        parts = [(np.array(a), np.array(b) - np.array(a)) for a, b in itertools.pairwise(line)]
        return min(float(np.hypot(*(p - a - np.clip((p - a) @ e / (e @ e), 0, 1) * e))) for a, e in parts)

    every = {t: {i: distance(x, y, line) for i, line in lines} for _, t, x, y in places}
    for tolerance, got in ((1.0, locate.nearest(points, lanes)), (1.1, locate.ring(points, lanes))):
        want = {(t, i) for t, ds in every.items() for i, d in ds.items() if d <= tolerance * min(ds.values())}
        assert {(r["total_nanos"], r["lane_id"]) for r in got.where("idx = 1").collect()} == want and got.where("idx = 2").isEmpty()
    lights = nearest_lane(points.where("idx = 1").selectExpr("total_nanos as light_id", "x", "y"), lanes)
    assert {r["light_id"]: r["lane_id"] for r in lights.collect()} == {t: min(ds, key=ds.get) for t, ds in every.items()}
    assert locate.nearest(points, lanes.limit(0)).isEmpty()


def test_far_rows_do_not_keep_an_earlier_place(spark):
    lanes = spark.createDataFrame([(1, [(0.0, 0.0), (100.0, 0.0)]), (2, [(0.0, 500.0), (100.0, 500.0)])], "lane_id long, centerline array<struct<x:double,y:double>>")
    one = [(1, 1, 10.0, 0.0), (1, 2, 20.0, 400.0), (1, 3, 20.0, 400.0)]
    other = [("b", i, t, x, 500.0 - y) for i, t, x, y in one]
    tracks = spark.createDataFrame([("a", *r) for r in one] + other, "recording_id string, idx long, total_nanos long, x double, y double")
    edges = spark.createDataFrame([], "src long, dst long, label string")
    got = {(r["recording_id"], r["total_nanos"]): (r["lane_id"], round(r["s"], 6), round(r["t"], 6)) for r in locate.locate(tracks, lanes, edges).collect()}
    assert got == {("a", 1): (1, 10.0, 0.0), ("a", 2): (2, 20.0, 100.0), ("a", 3): (2, 20.0, 100.0), ("b", 1): (2, 10.0, 0.0), ("b", 2): (1, 20.0, -100.0), ("b", 3): (1, 20.0, -100.0)}


def test_polygons_and_neighbours(spark):
    """Three lanes of 6 m beside each other from y = 0, the last without polygon; a fourth whose polygon is notched."""
    point = "array<struct<x:double,y:double>>"
    line = lambda y: [(0.0, y), (100.0, y)]
    ring = lambda y: [(0.0, y), (100.0, y), (100.0, y + 6), (0.0, y + 6), (0.0, y)]
    notched = [(0.0, -6.0), (100.0, -6.0), (100.0, 0.0), (60.0, 0.0), (50.0, -3.0), (40.0, 0.0), (0.0, 0.0), (0.0, -6.0)]
    rows = [(i, line(6.0 * i + 3), line(6.0 * i + 6), line(6.0 * i), ring(6.0 * i) if i < 2 else None, [], []) for i in range(3)] + [(3, line(-3.0), line(0.0), line(-6.0), notched, [], [])]
    lanes = spark.createDataFrame(rows, f"lane_id long, centerline {point}, left_line {point}, right_line {point}, polygon {point}, successor_ids array<long>, predecessor_ids array<long>")
    edges = lane_edges(lanes)
    # the notch leaves a part of lane 0's right line uncovered
    assert {tuple(r) for r in edges.collect()} == {(0, 1, "left neighbour"), (1, 0, "right neighbour"), (2, 1, "right neighbour"), (3, 0, "left neighbour")}
    points = spark.createDataFrame([(1, 1, 10.0, 0.5), (1, 2, 20.0, 6.0), (1, 3, 30.0, 11.5), (1, 4, 40.0, 14.0), (1, 5, 50.0, 17.5), (1, 6, 50.0, -1.0)], "idx long, total_nanos long, x double, y double")
    held = {(r["total_nanos"], r["lane_id"]) for r in locate.candidates(points, lanes).collect()}
    assert held == {(1, 0), (2, 0), (2, 1), (3, 1), (4, 2)}
    got = {r["total_nanos"]: (r["lane_id"], round(r["s"], 6), round(r["t"], 6)) for r in locate.locate(points, lanes, edges).collect()}
    # 17.5 is 2.5 from lane 2's line; -1 lies in the notch, 1 from lane 0 and farther from lane 3
    assert {t: v[0] for t, v in got.items()} == {1: 0, 2: 0, 3: 1, 4: 2, 5: 2, 6: 0} and got[1] == (0, 10.0, 2.5)
