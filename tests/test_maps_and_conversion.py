"""Split lanes, segments by kind of map, metrics that depend on each other, conversion of folders, and commands."""

import csv
import graphlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadweft.cli import main
from roadweft.functions import geometry
from roadweft.operators import convert, hulls, locate, maps
from roadweft.operators.interaction import Metric, MetricManager, metric
from roadweft.plans import catalogue, segmentation, staging
from roadweft.schema import DOUBLES, LONGS
from roadweft.sources import lxd
from roadweft.sources.events import tracks_from_events

DATA = "/root/testdata/sf0.001"
LINE = "array<struct<x:double,y:double>>"


def test_parts_lie_on_the_line(spark):
    rows = [(1, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)]), (2, [(0.0, 0.0), (3.0, 4.0)])]
    lanes = spark.createDataFrame(rows, f"lane_id long, centerline {LINE}")
    got = {(r["lane_id"], r["part"]): [tuple(p) for p in r["centerline"]] for r in maps.split_lanes(lanes, 6.0).collect()}
    assert got == {(1, 0): [(0, 0), (5, 0)], (1, 1): [(5, 0), (10, 0)], (1, 2): [(10, 0), (10, 5)], (1, 3): [(10, 5), (10, 10)], (2, 0): [(0, 0), (3, 4)]}


def test_nearest_lane_however_far(spark):
    """Against the distance of every point to every edge, on bent lanes and far points."""
    rng = np.random.default_rng(6)
    lines = [np.cumsum(rng.normal(0, 15, (6, 2)), axis=0) + rng.uniform(-300, 300, 2) for _ in range(12)]
    lanes = spark.createDataFrame([(i, [tuple(map(float, p)) for p in line]) for i, line in enumerate(lines)], f"lane_id long, centerline {LINE}")
    places = rng.uniform(-900, 900, (80, 2))
    points = spark.createDataFrame([(i, 0, float(x), float(y)) for i, (x, y) in enumerate(places)], "idx long, total_nanos long, x double, y double")

    def far(p, line):
        a, step = line[:-1], np.diff(line, axis=0)
        u = np.clip(((p - a) * step).sum(axis=1) / (step * step).sum(axis=1), 0, 1)
        return np.hypot(*(p - a - u[:, None] * step).T).min()

    want = {i: min((far(p, line), n) for n, line in enumerate(lines)) for i, p in enumerate(places)}
    got = {r["idx"]: (r["d"], r["lane_id"]) for r in locate.nearest(points, lanes).collect()}
    assert got.keys() == want.keys() and all(got[i][1] == want[i][1] and got[i][0] == pytest.approx(want[i][0]) for i in want)


def test_border_of_a_ring(spark):
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))))
    rows = spark.createDataFrame([(0.0, 2.0), (2.0, 2.0), (4.0, 4.0), (5.0, 1.0)], "x double, y double")
    got = rows.select(geometry.point_in_ring(F.col("x"), F.col("y"), ring), geometry.point_in_ring(F.col("x"), F.col("y"), ring, border=False)).collect()
    assert [tuple(r) for r in got] == [(True, False), (True, True), (True, False), (False, False)]


def test_simplified_lines(spark):
    line = [(0.0, 0.0), (1.0, 0.05), (2.0, -0.05), (3.0, 2.0), (4.0, 0.0), (4.0, 0.0)]
    rows = spark.createDataFrame([(line,), (line[:2],), (None,), ([],)], f"line {LINE}")
    got = [r[0] if r[0] is None else [tuple(p) for p in r[0]] for r in rows.select(hulls.simplify(F.col("line"), 0.1)).collect()]
    assert got == [[(0, 0), (2, -0.05), (3, 2), (4, 0)], line[:2], None, []]
    assert hulls.simplified(np.array(line), 10.0).tolist() == [[0, 0], [4, 0]]


def test_lanes_without_a_segment_are_named(spark):
    grid = catalogue.lanes(spark)
    assert segmentation.segments_of("odr", grid).count() == 10 and segmentation.segments_of("plain", grid) is None
    lost = grid.withColumn("road_id", F.when(F.col("lane_id") != 7, F.col("road_id")))
    with pytest.raises(RuntimeError, match="7"):
        segmentation.segments_of("odr", lost)
    numbers = {r["segment_idx"] for r in segmentation.segments_of("centerline", grid).collect()}
    assert numbers == set(range(len(numbers)))


def test_segments_become_roads(spark):
    kind = "struct<road_id:string,lane_id:long>"
    rows = [(("9", 1), [("9", 2)], []), (("9", 2), [("5", 3)], [("9", 1)]), (("5", 3), [], [("9", 2), ("5", 8)])]
    lanes = spark.createDataFrame(rows, f"lane_id {kind}, successor_ids array<{kind}>, predecessor_ids array<{kind}>")
    where = spark.createDataFrame([(("9", 1), 0), (("9", 2), 1), (("5", 3), None)], f"lane_id {kind}, segment_idx long")
    got = sorted((tuple(r["lane_id"]), [tuple(x) for x in r["successor_ids"]], [tuple(x) for x in r["predecessor_ids"]]) for r in maps.with_segment_roads(lanes, where).collect())
    assert got == [(("0", 1), [("1", 2)], []), (("1", 2), [("5", 3)], [("0", 1)]), (("5", 3), [], [("1", 2), ("5", 8)])]


def test_metrics_that_need_each_other(spark):
    df = spark.createDataFrame([(1, 2.0)], "idx long, x double")

    @metric(computes_intermediate_columns=["half"], computes_columns=["double"])
    def first(df, factor=2):
        return df.withColumns({"half": F.col("x") / 2, "double": F.col("x") * factor}), {}

    @metric(requires_columns=["half"], computes_properties=["table"])
    def second(df, offset):
        return df, {"table": df.select((F.col("half") + offset).alias("v"))}

    out, tables = MetricManager([second, first]).compute(df, offset=1, factor=3, unknown=5)
    assert out.columns == ["idx", "x", "double"] and out.first()["double"] == 6.0 and tables["table"].first()["v"] == 2.0
    assert MetricManager([first, second], exclude_columns=["double"], exclude_properties=["table"]).compute(df, offset=1)[1] == {}
    with pytest.raises(TypeError, match="second"):
        MetricManager([first, second]).compute(df)
    with pytest.raises(RuntimeError, match="half"):
        MetricManager([second])
    a, b = Metric(lambda df: (df, {}), computes_columns=("p",), requires_columns=("q",)), Metric(second.compute, computes_columns=("q",), requires_columns=("p",))
    with pytest.raises(graphlib.CycleError):
        MetricManager([a, b])
    lying = Metric(lambda df: (df, {}), computes_columns=("never",))
    with pytest.raises(AssertionError, match="never"):
        lying(df)


class Halves(convert.DatasetConverter):
    def __init__(self, paths):
        self.paths = paths

    def sources(self):
        return self.paths

    def recordings(self, path):
        if path == "bad":
            raise OSError("no such thing")
        yield f"{path}-1", pd.DataFrame({"idx": [1]})
        yield f"{path}-2", object() if path == "half" else pd.DataFrame({"idx": [2]})


def test_each_recording_has_its_own_outcome(spark, tmp_path):
    out, log = f"{tmp_path}/deep/out", f"{tmp_path}/log.csv"
    rows = Halves(["good", "half", "bad"]).convert(spark, out, log_file=log).collect()
    found = sorted((r["file_path_input"], r["file_path_output"].rsplit("/", 1)[-1], r["status"]) for r in rows)
    assert found == [("bad", "", "error"), ("good", "good-1.parquet", "success"), ("good", "good-2.parquet", "success"), ("half", "half-1.parquet", "success"), ("half", "half-2.parquet", "error")]
    assert len(list(csv.DictReader(open(log)))) == 5
    again = Halves(["good"]).convert(spark, out, skip_existing=True).collect()
    assert [r["status"] for r in again] == ["skip", "skip"]


def test_folders_of_recordings(spark, tmp_path, capsys):
    for n in (3, 12):
        pd.DataFrame({"trackId": [1, 1], "frame": [0, 1], "xCenter": [0.0, 1.0], "yCenter": 0.0, "xVelocity": 25.0, "yVelocity": 0.0, "xAcceleration": 0.0, "yAcceleration": 0.0, "heading": 90.0, "length": 4.0, "width": 2.0}).to_csv(tmp_path / f"{n:02d}_tracks.csv", index=False)
        pd.DataFrame({"trackId": [1], "class": ["car"]}).to_csv(tmp_path / f"{n:02d}_tracksMeta.csv", index=False)
        pd.DataFrame({"frameRate": [25.0]}).to_csv(tmp_path / f"{n:02d}_recordingMeta.csv", index=False)
    (tmp_path / "12_recordingMeta.csv").unlink()
    assert lxd.recording_ids(str(tmp_path)) == [3, 12]
    main(["from-lxd", str(tmp_path), f"{tmp_path}/out"], spark)
    shown = capsys.readouterr().out
    assert "success" in shown and "error" in shown
    rows = spark.read.parquet(f"{tmp_path}/out/03_tracks.parquet").orderBy("total_nanos").collect()
    assert [r["total_nanos"] for r in rows] == [0, 40_000_000] and rows[0]["yaw"] == pytest.approx(np.pi / 2) and rows[0]["type"] == 2
    main(["from-lxd", str(tmp_path), f"{tmp_path}/out", "--skip-existing"], spark)
    assert "skip" in capsys.readouterr().out


def test_tables_as_text_are_recordings(spark, tmp_path, capsys):
    rows = tracks_from_events(spark, DATA).where("idx < 3").select(*LONGS, *DOUBLES)
    rows.toPandas().to_csv(tmp_path / "a.csv", index=False)
    main(["from-csv", f"{tmp_path}/a.csv", f"{tmp_path}/a.parquet", "--no-validate"], spark)
    assert spark.read.parquet(f"{tmp_path}/a.parquet").count() == rows.count()
    pd.DataFrame({**dict.fromkeys(LONGS, [0, 0]), **dict.fromkeys(DOUBLES, [1.0, 1.0]), "total_nanos": [0, 1], "idx": [1, 1], "type": [2, 2], "role": [2, 2], "subtype": [4, 4]}).to_csv(tmp_path / "b.csv", index=False)
    main(["validate", f"{tmp_path}/b.csv"], spark)
    assert "is valid" in capsys.readouterr().out


def test_staged_tables_go(spark):
    staging.clear()
    kept, gone = staging.stage(spark.range(3).toDF("a"), "t"), staging.stage(spark.range(4).toDF("a"), "t")
    staging.remove(gone)
    assert kept.count() == 3 and list(staging._written) == [kept.staged_path]
    staging.clear()
    assert not staging._written and spark.conf.get(staging.CLEANUP, "false") == "false"
