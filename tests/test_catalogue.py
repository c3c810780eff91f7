"""Every query with SQL gives what DuckDB gives on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from roadweft.operators import interaction, resample, validate
from roadweft.operators import tracks as T
from roadweft.plans import catalogue
from roadweft.schema import recording
from roadweft.sources.events import tracks_from_events

DATA = "/root/testdata/sf0.001"


def plain(rows, columns):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    tidy = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    return order, sorted(([tidy(r[i]) for i in at] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    want = con.execute(catalogue.ORACLE_SQL[name])
    expected = plain(want.fetchall(), [d[0] for d in want.description])
    df = catalogue.QUERIES[name](spark, DATA)
    assert plain(df.collect(), df.columns) == expected


def test_every_query_gives_rows(spark):
    assert catalogue.QUERIES["locate_tracks"](spark, DATA).count() > 0


def test_recordings_are_kept_apart(spark):
    """What each operator gives for a table of two recordings is what it gives for each of them."""
    events = tracks_from_events(spark, DATA).where("event_id % 10 < 4").drop("frame")
    both = events.withColumn("recording_id", (F.col("event_id") % 2).cast("string"))
    offsets = both.where("event_id % 4 = 0").selectExpr("recording_id", "total_nanos", "1.0D ox", "2.0D oy", "3.0D oz", "0.1D oyaw").unionByName(both.where("event_id % 4 = 0").selectExpr("'1' recording_id", "total_nanos", "9.0D ox", "2.0D oy", "3.0D oz", "0.1D oyaw"))
    shapes = {
        "frames": T.with_frames,
        "default": lambda t: resample.interpolate_times(t, resample.default_times(t, T.frame_dim(t)).where("t % 16 = 0")),
        "skips": T.no_frame_skip,
        "moving": T.moving,
        "box": T.view_box,
        "faults": lambda t: validate.frame_skips(t).select(*recording(t), "idx", "total_nanos", "step"),
        "keys": lambda t: validate.duplicate_keys(t.unionByName(t)),
        "offsets": lambda t: resample.apply_offsets(t, offsets if recording(t) else offsets.where(F.col("recording_id") == t.first()["part"]).drop("recording_id")).drop("part"),
        "p": lambda t: interaction.MetricManager().compute(t, ego_id=8, time_buffer=10**14)[1]["p_timegaps"],
        "runs": lambda t: T.runs(t, "idx", "total_nanos", "type"),
    }
    for name, f in shapes.items():
        got = f(both)
        if name in ("frames", "moving"):
            got = got.select("recording_id", "event_id", "frame" if name == "frames" else "moved")
        columns = [c for c in got.columns if c != "recording_id"]
        for part in "01":
            alone = f(both.where(F.col("recording_id") == part).drop("recording_id").withColumn("part", F.lit(part)))
            want = plain(alone.select(*columns).collect(), columns)
            shown = plain(got.where(F.col("recording_id") == part).select(*columns).collect(), columns)
            # as text, since NaN differs from itself
            assert repr(shown) == repr(want), (name, part)
        assert not got.isEmpty(), name


def test_every_event_is_a_light(spark):
    events = {r["event_id"] for r in spark.read.parquet(f"{DATA}/events.parquet").select("event_id").collect()}
    assert {r["light_id"] for r in catalogue.QUERIES["light_nearest"](spark, DATA).collect()} == events


def test_whole_grids_and_tables(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).collect()
    times = sorted({r["us"] * 1000 for r in events})
    shown = lambda name: {r["total_nanos"] for r in catalogue.QUERIES[name](spark, DATA).select("total_nanos").distinct().collect()}
    # the time after the last event lies behind every object
    assert shown("interpolate_list") == {t + 1_000_000_007 for t in times[:-1]}
    tracks = tracks_from_events(spark, DATA)
    grid = {r["t"] for r in resample.default_times(tracks, T.frame_dim(tracks)).collect()}
    # the first point is a double and may lie before the first row
    assert len(grid) == len(times) - 1 and shown("interpolate_default") == {t for t in grid if times[0] <= t <= times[-1]}
    assert sorted(tuple(r) for r in catalogue.QUERIES["union_tracks"](spark, DATA).collect()) == sorted(2 * [(r["event_id"], r["user_id"]) for r in events])


def test_long_segments_are_dealt_a_few_times(spark):
    """Shuffled bytes do not follow the number of times that a segment holds, and far times change nothing."""
    tracks = tracks_from_events(spark, DATA).limit(1).drop("idx", "total_nanos", "x").crossJoin(spark.range(400).selectExpr("id div 2 as idx", "id % 2 * 3000 + id div 2 as total_nanos", "double(id % 2) * 3000 as x"))
    far = [-(10**15), 10**18]
    times = spark.range(3000).selectExpr("id as t").unionByName(spark.createDataFrame([(t,) for t in far], "t long"))
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        got = resample.interpolate_times(tracks, times).where("abs(x - (total_nanos - idx)) < 1e-6").groupBy("idx").count().collect()
        assert {r["idx"]: r["count"] for r in got} == {i: 3000 - i for i in range(200)}
        assert written() - before < 500_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    small = {tuple(r) for r in resample.interpolate_times(tracks.where("idx < 3"), times, chunk=7).select("idx", "total_nanos").collect()}
    assert small == {(i, t) for i in range(3) for t in range(i, 3000)}
