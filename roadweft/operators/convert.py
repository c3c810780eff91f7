"""Conversion of track datasets into trajectories, and batches of files."""

from __future__ import annotations

import os
from abc import ABC, abstractmethod
from collections.abc import Iterable
from importlib.metadata import entry_points

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweft.functions.geometry import wrap
from roadweft.plans.staging import stage
from roadweft.schema import PEDESTRIAN, UNSET, VEHICLE

# Vehicle classes of the source datasets and their subtype codes, the civil role, and sizes.
VEHICLES = {"Car": 4, "car": 4, "Truck": 7, "truck": 7, "truck_bus": 12, "bicycle": 11, "van": 6, "ad_shuttle": 1}
CIVIL = 2
BICYCLE_SIZE, PEDESTRIAN_SIZE, HEIGHT = (2.0, 0.8, 1.9), (0.5, 0.5, 1.8), 2.0


def with_codes(df: DataFrame) -> DataFrame:
    """type, role, subtype from class; a class that is no vehicle becomes a pedestrian."""
    code = F.create_map(*(F.lit(x) for k, v in VEHICLES.items() for x in (k, v)))
    vehicle = F.coalesce(F.col("class").isin(*VEHICLES), F.lit(False))
    pick = lambda a, b: F.when(vehicle, a).otherwise(b).cast("long")
    return df.withColumns({"type": pick(VEHICLE, PEDESTRIAN), "role": pick(CIVIL, UNSET), "subtype": pick(code[F.col("class")], F.lit(UNSET))})


def highd(df: DataFrame) -> DataFrame:
    """Tracks that state size as width and height, and a driving direction: heading in degrees, length and width."""
    return df.withColumns({"heading": F.col("drivingDirection") * 180.0, "length": F.col("width"), "width": F.col("height")})


def from_tracks(tracks: DataFrame, meta: DataFrame, rate: float) -> DataFrame:
    """Trajectories of source tracks and their classes; heading is in degrees, time counts from frame 0."""
    names = {"trackId": "idx", "id": "idx", "xCenter": "x", "yCenter": "y", "xVelocity": "vel_x", "yVelocity": "vel_y", "xAcceleration": "acc_x", "yAcceleration": "acc_y"}
    if "drivingDirection" in tracks.columns:
        tracks = highd(tracks)
    renamed = tracks.withColumnsRenamed({k: v for k, v in names.items() if k in tracks.columns})
    kinds = meta.withColumnsRenamed({k: "idx" for k in ("trackId", "id") if k in meta.columns}).select("idx", "class")
    df = with_codes(renamed.join(kinds, "idx", "left"))

    def size(i: int, own):
        bicycle = (F.col("type") == VEHICLE) & (F.col("subtype") == VEHICLES["bicycle"])
        return F.when(bicycle, BICYCLE_SIZE[i]).when(F.col("type") == PEDESTRIAN, PEDESTRIAN_SIZE[i]).otherwise(own)

    zero = F.lit(0.0)
    return df.withColumns({
        "length": size(0, F.col("length")), "width": size(1, F.col("width")), "height": size(2, F.lit(HEIGHT)), "yaw": wrap(F.radians("heading")),
        "total_nanos": (F.col("frame") * (1e9 / rate)).cast("long"), **{c: zero for c in ("z", "vel_z", "acc_z", "roll", "pitch")},
    }).drop("class", "heading", "drivingDirection")


STATUS = ("file_path_input", "file_path_output", "status", "error_message")


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URL, and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))


class DatasetConverter(ABC):
    """Converts source files in Spark tasks; each recording has its own outcome."""

    @abstractmethod
    def sources(self) -> Iterable[str]:
        """Paths of source files."""

    @abstractmethod
    def recordings(self, path: str) -> Iterable[tuple[str, pd.DataFrame]]:
        """(name, trajectories) of one source file."""

    def convert_source(self, path: str, out_dir: str, skip_existing: bool = False) -> list[tuple[str, str, str, str]]:
        """A row of STATUS for each recording of one source; a source that can't be read to its end gives one error more."""
        files, folder = file_system(out_dir)
        files.create_dir(folder)
        rows = []
        try:
            for name, df in self.recordings(path):
                out = f"{folder}/{name}.parquet"
                try:
                    if skip_existing and files.get_file_info(out).type != fs.FileType.NotFound:
                        rows.append((path, out, "skip", ""))
                        continue
                    with files.open_output_stream(out) as sink:
                        df.to_parquet(sink)
                    rows.append((path, out, "success", ""))
                except Exception as error:  # the outcome is reported in the row
                    rows.append((path, out, "error", f"{type(error).__name__}: {error}"))
        except Exception as error:  # as above
            rows.append((path, "", "error", f"{type(error).__name__}: {error}"))
        return rows

    def convert(self, spark: SparkSession, out_dir: str, skip_existing: bool = False, workers: int = -1, log_file: str | None = None) -> DataFrame:
        """STATUS for every recording: success, error or skip; written to log_file as CSV as well, if one is named.

        out_dir is a folder that all executors share. The conversion runs once, not each time the result is read.
        """
        paths = list(self.sources())
        n = spark.sparkContext.defaultParallelism if workers < 1 else workers

        def run(batches):
            for pdf in batches:
                yield pd.DataFrame([r for path in pdf["path"] for r in self.convert_source(path, out_dir, skip_existing)], columns=STATUS)

        files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(n, len(paths) or 1)))
        done = stage(files.mapInPandas(run, ", ".join(f"{c} string" for c in STATUS)), "conversion")
        if log_file:
            # a row a recording
            system, place = file_system(log_file)
            with system.open_output_stream(place) as sink:
                sink.write(done.orderBy(*STATUS[:2]).toPandas()[["file_path_input", "status", "file_path_output", "error_message"]].to_csv(index=False).encode())
        return done


def plug_ins(group: str = "roadweft.converters") -> dict[str, type[DatasetConverter]]:
    """Converters that installed packages announce, by name; TypeError for one that is no DatasetConverter."""
    found = {e.name: e.load() for e in entry_points(group=group)}
    for name, kind in found.items():
        if not (isinstance(kind, type) and issubclass(kind, DatasetConverter)):
            raise TypeError(f"{name} is no dataset converter")
    return found
