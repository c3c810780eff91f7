"""Reading and writing recordings: a trajectory table with a side file of what belongs to it."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweft.operators import tracks as T
from roadweft.operators.resample import apply_offsets, restore_places
from roadweft.operators.validate import check
from roadweft.plans.staging import stage
from roadweft.schema import TRACKS, as_tracks
from roadweft.sources import opendrive, traces

SIDE = "_recording.json"


def encode_projections(projections: dict) -> str:
    """JSON of {"proj_string": str, None: default offset, nanos: offset}; offsets are dicts of x, y, z, yaw."""
    check_projections(projections)
    offsets = [{"total_nanos": k, "offset": {c: float(v.get(c, 0.0)) for c in ("x", "y", "z", "yaw")}} for k, v in projections.items() if k != "proj_string"]
    return json.dumps({"proj_string": projections.get("proj_string"), "offsets": offsets})


def decode_projections(text: str | None) -> dict:
    if not text:
        return {}
    raw = json.loads(text)
    out = {x["total_nanos"]: x["offset"] for x in raw.get("offsets", [])}
    return out | ({"proj_string": raw["proj_string"]} if raw.get("proj_string") else {})


def check_projections(projections) -> dict:
    """projections, {} for None; TypeError for anything that is no such dict."""
    if projections is None:
        return {}
    if not isinstance(projections, dict):
        raise TypeError("projections are a dict")
    for k, v in projections.items():
        if k == "proj_string":
            if v is not None and not isinstance(v, str):
                raise TypeError("proj_string is text")
        elif (k is not None and not isinstance(k, int)) or not isinstance(v, dict):
            raise TypeError(f"projection {k!r} is no offset at a time")
    return projections


def projection_at(projections: dict, total_nanos: int):
    """The offset of a time, else the default, else None."""
    return projections.get(total_nanos, projections.get(None))


@dataclass
class Recording:
    """Trajectories with frames and norms, and what belongs to them. Nothing is gathered."""

    df: DataFrame
    projections: dict = field(default_factory=dict)
    host_vehicle_idx: int | None = None
    map_text: str | None = None
    map_name: str | None = None
    #: Offsets by time (total_nanos, ox, oy, oz, oyaw) and states of lights, for recordings that hold them as tables.
    offsets: DataFrame | None = None
    lights: DataFrame | None = None

    @classmethod
    def of(cls, df: DataFrame, validate: bool = False, **kw) -> Recording:
        df = as_tracks(df)
        df = check(df) if validate else df
        return cls(T.with_norms(T.with_frames(df)), **(kw | {"projections": check_projections(kw.get("projections"))}))

    def object(self, idx: int) -> DataFrame:
        return self.df.where(F.col("idx") == idx)

    def host_vehicle(self) -> DataFrame | None:
        return self.object(self.host_vehicle_idx) if self.host_vehicle_idx is not None else None

    def objects(self) -> DataFrame:
        return T.object_summary(self.df)

    def maps(self) -> DataFrame:
        """(map_name, text): a row if there is a map."""
        rows = [(self.map_name or "", self.map_text)] if self.map_text else []
        return self.df.sparkSession.createDataFrame(rows, "map_name string, text string")

    def lanes(self, step: float = 0.1) -> DataFrame:
        return opendrive.parse_maps(self.maps(), step)

    def with_map(self, text: str, name: str) -> Recording:
        return replace(self, map_text=text, map_name=name)

    def offset_table(self) -> DataFrame:
        if self.offsets is not None:
            return self.offsets.select("total_nanos", "ox", "oy", "oz", "oyaw").where("ox is not null")
        rows = [(k, *(float(v.get(c, 0.0)) for c in ("x", "y", "z", "yaw"))) for k, v in self.projections.items() if isinstance(k, int)]
        return self.df.sparkSession.createDataFrame(rows, "total_nanos long, ox double, oy double, oz double, oyaw double")

    def projected(self) -> Recording:
        """Places in the map's coordinates; ValueError without a projection of the recording or of the map."""
        header = opendrive.headers(self.maps()).first()
        source, dest = self.projections.get("proj_string"), header["proj_string"] if header else None
        if not source or not dest:
            raise ValueError("the recording or its map names no projection")
        default = self.projections.get(None) or {}
        moved = apply_offsets(self.df, self.offset_table(), tuple(float(default.get(c, 0.0)) for c in ("x", "y", "z", "yaw")), tuple(header[c] for c in ("x", "y", "z", "yaw")), source, dest)
        return replace(self, df=moved)

    def write(self, path: str) -> None:
        """.parquet or .mcap; ValueError for other suffixes."""
        if path.endswith(".parquet"):
            self.write_parquet(path)
        elif path.endswith(".mcap"):
            self.write_mcap(path)
        else:
            raise ValueError(f"no writer for {path}")

    def write_mcap(self, path: str) -> None:
        messages = traces.to_messages(restore_places(self.df), self.offset_table(), self.lights, self.host_vehicle_idx, self.projections.get("proj_string"), self.map_name)
        traces.write_mcap(messages, path, self.map_text, self.map_name or "")

    def write_map(self, path: str) -> str:
        """The map's text as a file; in a folder under the map's name. ValueError without a map."""
        if not self.map_text:
            raise ValueError("the recording has no OpenDRIVE map")
        if not path.endswith((".xodr", ".odr")):
            path = f"{path.rstrip('/')}/{self.map_name or 'map'}.xodr" if is_folder(self.df.sparkSession, path) else f"{path}.xodr"
        write_text(self.df.sparkSession, path, self.map_text)
        return path

    def write_parquet(self, path: str) -> None:
        """The table without frames, in its original places, with the side file, offsets and lights beside its parts."""
        spark = self.df.sparkSession
        restore_places(self.df).drop("frame").write.parquet(path)
        side = {"host_vehicle_idx": self.host_vehicle_idx, "projections": encode_projections(self.projections), "map_text": self.map_text, "map_name": self.map_name}
        write_text(spark, f"{path}/{SIDE}", json.dumps(side))
        for name, table in (("_offsets", self.offsets), ("_lights", self.lights)):
            if table is not None:
                table.write.parquet(f"{path}/{name}")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def is_folder(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def read_trace(spark: SparkSession, path: str, validate: bool = False) -> Recording:
    """A recording from .mcap or .osi. Messages are written to the shared folder once; host and map are the first ones named."""
    messages = stage(traces.read_messages(spark, path), "trace")
    facts = traces.frame_facts(messages)
    text = traces.projection_text(facts)
    host = facts.orderBy("total_nanos").select("host_vehicle_idx").first()
    found = traces.map_texts(messages).first()
    return Recording.of(
        traces.moving_objects(messages), validate, projections={"proj_string": text} if text else {}, host_vehicle_idx=host[0] if host else None,
        map_text=found["text"] if found else None, map_name=found["map_name"] if found else None, offsets=facts, lights=traces.traffic_lights(messages),
    )


def read_recording(spark: SparkSession, path: str, validate: bool = False, map_path: str | None = None, project: bool = False) -> Recording:
    """A recording from .parquet, .csv, .mcap or .osi, with the map of another file if one is named; ValueError for other suffixes."""
    if path.endswith((".mcap", ".osi")):
        out = read_trace(spark, path, validate)
    elif path.endswith(".csv"):
        out = Recording.of(spark.read.schema(TRACKS).csv(path, header=True, enforceSchema=False), validate)
    elif path.endswith(".parquet"):
        side = json.loads((read_side(spark, path) if is_folder(spark, path) else None) or "{}")
        side["projections"] = decode_projections(side.get("projections"))
        for name in ("offsets", "lights"):
            if is_folder(spark, f"{path}/_{name}"):
                side[name] = spark.read.parquet(f"{path}/_{name}")
        out = Recording.of(spark.read.parquet(path), validate, **side)
    else:
        raise ValueError(f"no reader for {path}")
    if map_path:
        row = opendrive.read_maps(spark, map_path).first()
        out = out.with_map(row["text"], row["map_name"])
    return out.projected() if project else out


def read_side(spark: SparkSession, path: str) -> str | None:
    p, fs = _path(spark, f"{path}/{SIDE}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
