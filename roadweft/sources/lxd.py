"""Folders of drone recordings: NN_tracks.csv, NN_tracksMeta.csv and NN_recordingMeta.csv for each recording."""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweft.operators.convert import STATUS, file_system, from_tracks
from roadweft.schema import DOUBLES, LONGS

TRACKS = re.compile(r"(\d+)_tracks\.csv")


def recording_ids(folder: str) -> list[int]:
    """Numbers of the recordings in a folder, ascending."""
    files, path = file_system(folder)
    return sorted(int(m[1]) for f in files.get_file_info(fs.FileSelector(path)) if (m := TRACKS.fullmatch(f.base_name)))


def recording_name(number: int) -> str:
    return f"{number:02d}_tracks"


def read_lxd(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """Trajectories of one recording."""
    read = lambda kind: spark.read.csv(f"{folder.rstrip('/')}/{number:02d}_{kind}.csv", header=True, inferSchema=True)
    # one row
    rate = read("recordingMeta").select(F.col("frameRate").cast("double")).first()[0]
    tracks = from_tracks(read("tracks"), read("tracksMeta"), rate)
    return tracks.select(*(F.col(c).cast("long").alias(c) for c in LONGS), *(F.col(c).cast("double").alias(c) for c in DOUBLES))


def convert_lxd(spark: SparkSession, folder: str, out_dir: str, skip_existing: bool = False) -> DataFrame:
    """Each recording as a Parquet table NN_tracks.parquet; a row of STATUS for each. One that fails does not stop the rest."""
    rows = []
    for number in recording_ids(folder):
        source, out = f"{folder.rstrip('/')}/{number:02d}_tracks.csv", f"{out_dir.rstrip('/')}/{recording_name(number)}.parquet"
        files, path = file_system(out)
        if skip_existing and files.get_file_info(path).type != fs.FileType.NotFound:
            rows.append((source, out, "skip", ""))
            continue
        try:
            read_lxd(spark, folder, number).write.mode("overwrite").parquet(out)
            rows.append((source, out, "success", ""))
        except Exception as error:  # the outcome is reported in the row
            rows.append((source, out, "error", f"{type(error).__name__}: {str(error).splitlines()[0]}"))
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in STATUS))
