"""Ground-truth traces (.mcap, .osi) as tables, and recordings as MCAP files.

A file is decoded in one task (Spark reads files of up to 2 GB whole); files are independent. Decoded messages can be
spread again before they are flattened.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from roadweft.plans import staging
from roadweft.schema import DOUBLES, LONGS, TRACKS, UNSET, VEHICLE
from roadweft.sources import containers, wire

TRUTH, MAP = "ground_truth", "ground_truth_map"
#: Released version of the message interface that is written.
VERSION = {"version_major": 3, "version_minor": 7, "version_patch": 9}
LIGHTS = "total_nanos long, light_id long, x double, y double, z double, color int, icon int, mode int, counter double"
OFFSETS = "total_nanos long, proj_string string, ox double, oy double, oz double, oyaw double, host_vehicle_idx long, map_reference string"
_P = "array<struct<x:double,y:double>>"
LANES = f"lane_id long, type int, subtype int, centerline {_P}, predecessor_ids array<long>, successor_ids array<long>, left_boundary_id long, right_boundary_id long"
BOUNDARIES = f"boundary_id long, type int, polyline {_P}"


def _batches(rows, names: list[str], types: list[pa.DataType], size: int = 8192):
    """Rows as record batches of bounded size."""
    for some in itertools.batched(rows, size):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names=names)


def _divided(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """The MCAP files of a path: those that were written in pieces, and the others."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    found = ([], [])
    for top in fs.globStatus(target) or []:
        for status in fs.listStatus(top.getPath()) if top.isDirectory() else [top]:
            if status.isDirectory() or status.getPath().getName()[0] in "._":
                continue
            content = fs.open(status.getPath())
            start = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(content, min(status.getLen(), len(containers.DIVIDED))))
            content.close()
            found[start != containers.DIVIDED].append(status.getPath().toString())
    return found


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """(topic, log_time, data) of .mcap and .osi files; ValueError for other suffixes. Files that write_mcap wrote are decoded in pieces."""
    if not path.endswith((".mcap", ".osi")):
        raise ValueError(f"no reader for {path}")
    names, types = ["topic", "log_time", "data"], [pa.string(), pa.int64(), pa.binary()]

    def whole(batches):
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                found = containers.read_mcap(content) if name.endswith(".mcap") else ((TRUTH, None, m) for m in containers.read_trace(content))
                yield from _batches(((topic.strip("/"), time, data) for topic, time, data in found), names, types, 256)

    def pieces(batches):
        for batch in batches:
            for piece in batch["value"]:
                found = containers.read_piece(piece.as_py().removeprefix(containers.MAGIC))
                yield from _batches(((topic.strip("/"), time, data) for topic, time, data in found), names, types, 1024)

    divided, others = _divided(spark, path) if path.endswith(".mcap") else ([], [])
    schema = "topic string, log_time long, data binary"
    parts = []
    if divided:
        lines = spark.read.text(divided, lineSep=containers.MARK).select(F.col("value").cast("binary").alias("value"))
        parts.append(lines.mapInArrow(pieces, schema))
    if others or not divided:
        parts.append(spark.read.format("binaryFile").load(others or path).select("path", "content").mapInArrow(whole, schema))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def nanos(message: dict) -> int:
    t = message["timestamp"] or {"seconds": 0, "nanos": 0}
    return t["seconds"] * 1_000_000_000 + t["nanos"]


def _flatten(messages: DataFrame, rows, schema: str) -> DataFrame:
    known = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            found = (row for data in batch["data"] for row in rows(wire.decode("GroundTruth", data.as_py())))
            yield from _batches(found, known.names, known.types)

    return messages.where(F.col("topic") == TRUTH).select("data").mapInArrow(run, schema)


def _xyz(v: dict | None, names: str) -> list[float]:
    return [(v or {}).get(n, 0.0) for n in names.split()]


def moving_objects(messages: DataFrame) -> DataFrame:
    """The trajectory table. role and subtype are -1 for what is no vehicle; absent parts of a message count as 0."""

    def rows(m: dict):
        for o in m["moving_object"]:
            base, kind = o["base"] or {}, o["vehicle_classification"] or {"type": 0, "role": 0}
            vehicle = o["type"] == VEHICLE
            codes = [o["type"], kind["role"] if vehicle else UNSET, kind["type"] if vehicle else UNSET]
            places = _xyz(base.get("position"), "x y z") + _xyz(base.get("velocity"), "x y z") + _xyz(base.get("acceleration"), "x y z")
            yield nanos(m), (o["id"] or {"value": 0})["value"], *codes, *places, *_xyz(base.get("dimension"), "length width height"), *_xyz(base.get("orientation"), "roll pitch yaw")

    return _flatten(messages, rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TRACKS.fields))


def traffic_lights(messages: DataFrame) -> DataFrame:
    def rows(m: dict):
        for o in m["traffic_light"]:
            c = o["classification"] or {}
            yield nanos(m), (o["id"] or {"value": 0})["value"], *_xyz((o["base"] or {}).get("position"), "x y z"), *(c.get(k, 0) for k in ("color", "icon", "mode")), c.get("counter", 0.0)

    return _flatten(messages, rows, LIGHTS)


def frame_facts(messages: DataFrame) -> DataFrame:
    """A row a message: projection text and offset, host and map. An offset without a position raises ValueError."""

    def rows(m: dict):
        o = m["proj_frame_offset"]
        if o and o["position"] is None:
            raise ValueError(f"the offset at {nanos(m)} has no position")
        offset = [*_xyz(o["position"], "x y z"), o["yaw"]] if o else [None] * 4
        yield nanos(m), m["proj_string"].strip() or None, *offset, (m["host_vehicle_id"] or {"value": None})["value"], m["map_reference"] or None

    return _flatten(messages, rows, OFFSETS)


def projection_text(facts: DataFrame) -> str | None:
    """The one projection text of a trace; ValueError if there are several."""
    found = [r[0] for r in facts.where("proj_string is not null").select("proj_string").distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"conflicting projection texts: {found}")
    return found[0] if found else None


def _points(vectors: list) -> list[tuple[float, float]]:
    return [(v["x"], v["y"]) for v in vectors if v]


def map_lanes(messages: DataFrame) -> DataFrame:
    """Lanes of messages that carry them, one row a lane. Centre lines run in driving direction."""

    def rows(m: dict):
        for lane in m["lane"]:
            c = lane["classification"] or wire.decode("LaneClassification", b"")
            line = _points(c["centerline"])
            first = lambda ids: ids[0]["value"] if ids else None
            pairs = lambda k: [p[k]["value"] for p in c["lane_pairing"] if p[k]]  # noqa: B023, E731
            yield (
                lane["id"]["value"], c["type"], c["subtype"], line if c["centerline_is_driving_direction"] else line[::-1], pairs("antecessor_lane_id"), pairs("successor_lane_id"),
                first(c["left_lane_boundary_id"]), first(c["right_lane_boundary_id"]),
            )

    return _flatten(messages, rows, LANES).dropDuplicates(["lane_id"])


def map_boundaries(messages: DataFrame) -> DataFrame:
    def rows(m: dict):
        for b in m["lane_boundary"]:
            yield b["id"]["value"], (b["classification"] or {"type": 0})["type"], _points([p["position"] for p in b["boundary_line"]])

    return _flatten(messages, rows, BOUNDARIES).dropDuplicates(["boundary_id"])


def map_texts(messages: DataFrame) -> DataFrame:
    """(map_name, text) of OpenDRIVE maps in the trace."""

    def run(batches):
        for pdf in batches:
            found = [wire.decode("MapAsamOpenDrive", d) for d in pdf["data"]]
            yield pd.DataFrame([(m["map_reference"], m["open_drive_xml_content"]) for m in found], columns=["map_name", "text"])

    return messages.where(F.col("topic") == MAP).select("data").mapInPandas(run, "map_name string, text string")


def to_messages(tracks: DataFrame, facts: DataFrame | None = None, lights: DataFrame | None = None, host: int | None = None, proj_string: str | None = None, map_name: str | None = None) -> DataFrame:
    """(total_nanos, data): a GroundTruth message for each time, its objects by idx. A time's objects are one message, so they meet in one task."""
    names = [*LONGS[1:], *DOUBLES]
    frames = tracks.groupBy("total_nanos").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("objects"))
    offset = ["ox", "oy", "oz", "oyaw"]
    frames = frames.join(facts.select("total_nanos", *offset), "total_nanos", "left") if facts is not None else frames.withColumns({c: F.lit(None).cast("double") for c in offset})
    if lights is not None:
        states = lights.groupBy("total_nanos").agg(F.collect_list(F.struct(*(c for c in lights.columns if c != "total_nanos"))).alias("lights"))
        frames = frames.join(states, "total_nanos", "left")
    else:
        frames = frames.withColumn("lights", F.lit(None).cast("array<struct<light_id:long>>"))

    def vector(o: dict, *keys: str) -> dict:
        return dict(zip("xyz", (o[k] for k in keys), strict=True))

    def moving(o: dict) -> dict:
        base = {
            "dimension": {k: o[k] for k in ("length", "width", "height")}, "orientation": {k: o[k] for k in ("roll", "pitch", "yaw")},
            "position": vector(o, "x", "y", "z"), "velocity": vector(o, "vel_x", "vel_y", "vel_z"), "acceleration": vector(o, "acc_x", "acc_y", "acc_z"),
        }
        return {"id": {"value": o["idx"]}, "base": base, "type": o["type"], "vehicle_classification": {"type": o["subtype"], "role": o["role"]}}

    def light(o: dict) -> dict:
        return {"id": {"value": o["light_id"]}, "base": {"position": vector(o, "x", "y", "z")}, "classification": {k: o[k] for k in ("color", "icon", "mode", "counter")}}

    texts = {"proj_string": proj_string, "map_reference": map_name}
    last = wire.encode("GroundTruth", texts)
    start, host_part = (wire.encode("GroundTruth", m) for m in ({"version": VERSION}, {"host_vehicle_id": None if host is None else {"value": host}}))

    def run(batches):
        for batch in batches:
            out = []
            objects = batch["objects"]
            held, ends = _objects(objects.flatten(), moving), np.r_[0, np.cumsum(objects.value_lengths().to_numpy())].tolist()
            columns = (batch[c].to_pylist() for c in ("total_nanos", "lights", *offset))
            for a, b, t, lit, *place in zip(ends, ends[1:], *columns, strict=False):
                seconds, rest = wire.varint(t // 1_000_000_000), wire.varint(t % 1_000_000_000)
                time = b"".join((b"\x12", bytes((len(seconds) + len(rest) + 2,)), b"\x08", seconds, b"\x10", rest))
                end = last
                if lit or place[0] is not None:
                    m = texts | {"traffic_light": [light(o) for o in lit or []]}
                    if place[0] is not None:
                        row = dict(zip(offset, place, strict=True))
                        m["proj_frame_offset"] = {"position": vector(row, "ox", "oy", "oz"), "yaw": row["oyaw"]}
                    end = wire.encode("GroundTruth", m)
                # fields in the order of their numbers: objects come after the host and before lights
                out.append((t, b"".join((start, time, host_part, *held[a:b], end))))
            yield pa.RecordBatch.from_pydict({"total_nanos": pa.array([t for t, _ in out], pa.int64()), "data": pa.array([d for _, d in out], pa.binary())})

    return frames.mapInArrow(run, "total_nanos long, data binary")


def _objects(objects: pa.StructArray, moving) -> list[bytes]:
    """Each object's field of a message. Where no number is missing, the fixed part of all objects is laid out at once."""
    columns = dict(zip((f.name for f in objects.type), objects.flatten(), strict=True))
    if any(c.null_count for c in columns.values()):
        return [wire.encode("GroundTruth", {"moving_object": [moving(o)]}) for o in objects.to_pylist()]
    n, template = len(objects), wire.BASE[0]
    base = np.tile(np.frombuffer(template, np.uint8), (n, 1))
    names = ("length", "width", "height", "x", "y", "z", "roll", "pitch", "yaw", "vel_x", "vel_y", "vel_z", "acc_x", "acc_y", "acc_z")
    for i, c in enumerate(names):
        at = 29 * (i // 3) + 9 * (i % 3) + 3
        base[:, at : at + 8] = columns[c].to_numpy().astype("<f8").view(np.uint8).reshape(n, 8)
    whole, size, codes, out = base.tobytes(), len(template), {}, []
    head = b"\x12" + wire.varint(size)
    for i, (idx, *code) in enumerate(zip(*(columns[c].to_pylist() for c in ("idx", "type", "subtype", "role")), strict=True)):
        code = tuple(code)
        if code not in codes:
            codes[code] = wire.encode("MovingObject", {"type": code[0], "vehicle_classification": {"type": code[1], "role": code[2]}})
        number = wire.varint(idx)
        body = b"".join((b"\x0a", bytes((len(number) + 1,)), b"\x08", number, head, whole[i * size : (i + 1) * size], codes[code]))
        out.append(b"\x2a" + wire.varint(len(body)) + body)
    return out


def write_mcap(messages: DataFrame, path: str, map_text: str | None = None, map_name: str = "") -> None:
    """One file of messages (total_nanos, data) in time order, and of a map.

    Tasks pack ranges of times into chunks and write them as parts; the file system's streams put the parts together,
    so that no message goes through the driver's Python.
    """
    if not path.endswith(".mcap"):
        raise ValueError(f"no MCAP path: {path}")
    spark = messages.sparkSession
    channels = [(f"/{TRUTH}", "osi3.GroundTruth"), (f"/{MAP}", "osi3.MapAsamOpenDrive")]

    def pack(batches):
        rows = ((0, t.as_py(), d.as_py()) for batch in batches for t, d in zip(batch["total_nanos"], batch["data"], strict=True))
        for piece in containers.divided_pieces(channels, rows):
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.binary())], names=["value"])

    parts = staging.fresh_path(spark, "mcap-parts")
    ordered = messages.select("total_nanos", "data").repartitionByRange("total_nanos").sortWithinPartitions("total_nanos")
    # Spark writes a string's bytes as they are
    ordered.mapInArrow(pack, "value binary").select(F.col("value").cast("string")).write.text(parts, compression="none", lineSep=containers.MARK)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, folder = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(parts)
    source = folder.getFileSystem(conf)
    written = [s for s in source.listStatus(folder) if s.getPath().getName().startswith("part-") and s.getLen()]
    written.sort(key=lambda s: (int(s.getPath().getName().split("-")[1]), s.getPath().getName()))
    out = target.getFileSystem(conf).create(target, True)
    try:
        out.write(bytearray(containers.divided_start(channels, wire.descriptor())))
        if map_text is not None:
            first = 0
            if written:
                content = source.open(written[0].getPath())
                # a chunk's record begins with its first time
                first = int.from_bytes(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(content, 17))[9:], "little", signed=True)
                content.close()
            text = wire.encode("MapAsamOpenDrive", {"map_reference": map_name, "open_drive_xml_content": map_text})
            for piece in containers.divided_pieces(channels, [(1, first, text)]):
                out.write(bytearray(piece + containers.MARK.encode()))
        for s in written:
            content = source.open(s.getPath())
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(content, out, 1 << 20, False)
            finally:
                content.close()
        out.write(bytearray(containers.divided_end()))
    finally:
        out.close()
        staging.discard(spark, parts)
