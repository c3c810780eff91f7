"""The trajectory table and the codes of its enumerations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONGS = ("total_nanos", "idx", "type", "role", "subtype")
DOUBLES = ("x", "y", "z", "vel_x", "vel_y", "vel_z", "acc_x", "acc_y", "acc_z", "length", "width", "height", "roll", "pitch", "yaw")
TRACKS = T.StructType([T.StructField(c, T.LongType()) for c in LONGS] + [T.StructField(c, T.DoubleType()) for c in DOUBLES])

# The public codes of object types and the type that counts as a vehicle.
TYPE_NAMES = ["UNKNOWN", "OTHER", "VEHICLE", "PEDESTRIAN", "ANIMAL"]
# The public codes of a vehicle's role and kind, from 0.
ROLE_NAMES = ("UNKNOWN", "OTHER", "CIVIL", "AMBULANCE", "FIRE", "POLICE", "PUBLIC_TRANSPORT", "ROAD_ASSISTANCE", "GARBAGE_COLLECTION", "ROAD_CONSTRUCTION", "MILITARY")
SUBTYPE_NAMES = ("UNKNOWN", "OTHER", "SMALL_CAR", "COMPACT_CAR", "MEDIUM_CAR", "LUXURY_CAR", "DELIVERY_VAN", "HEAVY_TRUCK", "SEMITRAILER", "TRAILER", "MOTORBIKE", "BICYCLE", "BUS", "TRAM", "TRAIN", "WHEELCHAIR", "SEMITRACTOR", "STANDUP_SCOOTER")
VEHICLE, PEDESTRIAN, UNSET = 2, 3, -1
#: Largest codes.
LAST_TYPE, LAST_ROLE, LAST_SUBTYPE = 4, 10, 17


#: The column that tells the recordings of one table apart. Where a table has it, operators keep recordings apart; it is never null.
RECORDING = "recording_id"


def recording(df: DataFrame) -> list[str]:
    """The key of recordings; empty where a table holds one recording."""
    return [RECORDING] if RECORDING in df.columns else []


def as_tracks(df: DataFrame) -> DataFrame:
    """df with the known columns in their types; other columns pass through. total_nanos must be there."""
    if "total_nanos" not in df.columns:
        raise ValueError("the table has no column total_nanos")
    return df.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in TRACKS.fields if f.name in df.columns})
