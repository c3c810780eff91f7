"""Traces come back as they were written; damaged ones raise."""

import struct

import pytest
from pyspark.sql import functions as F

from roadweft.schema import DOUBLES, LONGS
from roadweft.sources import containers, traces, wire
from roadweft.sources.events import tracks_from_events

DATA = "/root/testdata/sf0.001"


def test_wire_round_trip_and_unknown_fields():
    m = {"timestamp": {"seconds": 3, "nanos": 5}, "moving_object": [{"id": {"value": 2**40}, "type": 2, "vehicle_classification": {"type": -1, "role": -1}}], "proj_string": "ü"}
    data = wire.encode("GroundTruth", m) + wire.varint(99 << 3 | 2) + b"\x02ab" + wire.varint(98 << 3 | 5) + b"1234"
    back = wire.decode("GroundTruth", data)
    assert back["moving_object"][0]["id"]["value"] == 2**40 and back["moving_object"][0]["vehicle_classification"]["role"] == -1
    assert back["proj_string"] == "ü" and back["host_vehicle_id"] is None and back["lane"] == [] and traces.nanos(back) == 3_000_000_005
    with pytest.raises(ValueError):
        wire.decode("GroundTruth", data[:-1])


def test_containers():
    messages = [(i % 2, i, bytes([i]) * 50) for i in range(40)]
    data = b"".join(containers.mcap_pieces([("/a", "A"), ("/b", "B")], wire.descriptor(), messages, chunk=500))
    assert list(containers.read_mcap(data)) == [(("/a", "/b")[c], t, d) for c, t, d in messages]
    spoiled = b"x" + data
    with pytest.raises(ValueError):
        list(containers.read_mcap(spoiled))
    assert list(containers.read_trace(struct.pack("<I", 2) + b"ab" + struct.pack("<I", 0))) == [b"ab", b""]
    with pytest.raises(ValueError):
        list(containers.read_trace(struct.pack("<I", 9) + b"ab"))


def test_tracks_lights_offsets_and_map_survive(spark, tmp_path):
    tracks = tracks_from_events(spark, DATA).select(*LONGS, *DOUBLES).where("idx < 5")
    times = tracks.select("total_nanos").distinct()
    facts = times.where("total_nanos % 2 = 0").select("total_nanos", F.lit(1.0).alias("ox"), F.lit(2.0).alias("oy"), F.lit(0.0).alias("oz"), F.lit(0.5).alias("oyaw"))
    lights = times.select("total_nanos", F.lit(7).cast("long").alias("light_id"), *(F.lit(float(i)).alias(c) for i, c in enumerate("xyz")), *(F.lit(i).alias(c) for i, c in enumerate(("color", "icon", "mode"))), F.lit(4.0).alias("counter"))
    path = f"{tmp_path}/r.mcap"
    traces.write_mcap(traces.to_messages(tracks, facts, lights, host=3, proj_string="+proj=utm +zone=32", map_name="m"), path, "<OpenDRIVE/>", "m")
    messages = traces.read_messages(spark, path)
    assert sorted(map(tuple, traces.moving_objects(messages).select(tracks.columns).collect())) == sorted(map(tuple, tracks.collect()))
    assert sorted(map(tuple, traces.traffic_lights(messages).collect())) == sorted(map(tuple, lights.collect()))
    back = traces.frame_facts(messages)
    assert traces.projection_text(back) == "+proj=utm +zone=32" and {r["host_vehicle_idx"] for r in back.collect()} == {3}
    assert back.where("ox = 1 and oyaw = 0.5").count() == facts.count() and tuple(traces.map_texts(messages).first()) == ("m", "<OpenDRIVE/>")
    with pytest.raises(ValueError):
        traces.read_messages(spark, "x.txt")


def test_lanes_of_a_trace(spark, tmp_path):
    ids = lambda *v: [{"value": i} for i in v]
    line = [{"x": 0.0, "y": 0.0, "z": 0.0}, {"x": 5.0, "y": 1.0, "z": 0.0}]
    c = {"type": 1, "subtype": 2, "centerline": line, "centerline_is_driving_direction": False, "lane_pairing": [{"successor_lane_id": {"value": 9}}], "right_lane_boundary_id": ids(4, 5)}
    m = {"lane": [{"id": {"value": 8}, "classification": c}], "lane_boundary": [{"id": {"value": 4}, "boundary_line": [{"position": p} for p in line], "classification": {"type": 3}}]}
    data = wire.encode("GroundTruth", m)
    (tmp_path / "t.osi").write_bytes(struct.pack("<I", len(data)) + data)
    messages = traces.read_messages(spark, f"{tmp_path}/t.osi")
    lane = traces.map_lanes(messages).first()
    assert [p.x for p in lane["centerline"]] == [5.0, 0.0] and lane["successor_ids"] == [9] and lane["predecessor_ids"] == [] and lane["right_boundary_id"] == 4 and lane["left_boundary_id"] is None
    assert [p.y for p in traces.map_boundaries(messages).first()["polyline"]] == [0.0, 1.0]


def test_one_file_is_written_and_decoded_by_many_tasks(spark, tmp_path):
    tracks = spark.range(6000).selectExpr("id div 3 * 1000 as total_nanos", "id % 3 as idx", "2L as type", "id % 5 as role", "id % 7 - 1 as subtype", *(f"rand({i}) * 100 as {c}" for i, c in enumerate(DOUBLES)))
    tracks = tracks.withColumn("z", F.when((F.col("idx") != 1) | (F.col("total_nanos") > 1_000_000), F.col("z"))).localCheckpoint()
    path = f"{tmp_path}/r.mcap"
    traces.write_mcap(traces.to_messages(tracks, host=1, map_name="m"), path, "<OpenDRIVE/>", "m")
    with open(path, "rb") as f:
        held = list(containers.read_mcap(f.read()))
    # a whole file in the order of times, the map first
    assert [t for topic, t, _ in held if topic == "/ground_truth"] == list(range(0, 2_000_000, 1000)) and held[0][:2] == ("/ground_truth_map", 0)
    for _, t, data in held[1:]:
        # from 1 ms on no number is missing
        assert t <= 1_000_000 or wire.encode("GroundTruth", wire.decode("GroundTruth", data) | {"proj_string": None}) == data
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        messages = traces.read_messages(spark, path)
        assert messages.select(F.spark_partition_id()).distinct().count() > 1
        back = traces.moving_objects(messages)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, tracks.fillna({"z": 0.0}).select(back.columns).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
