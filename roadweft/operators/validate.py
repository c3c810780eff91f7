"""Rules of the trajectory table, counted in one pass."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from roadweft.operators.tracks import with_frames
from roadweft.schema import DOUBLES, LAST_ROLE, LAST_SUBTYPE, LAST_TYPE, LONGS, TRACKS, UNSET, VEHICLE, recording


def row_rules() -> dict[str, Column]:
    """Rule name to the condition that a bad row meets."""
    c = F.col
    out = {f"null_{n}": c(n).isNull() for n in (*LONGS, *DOUBLES)}
    out |= {f"{n}_positive": c(n) <= 0 for n in ("length", "width")} | {"height_not_negative": c("height") < 0}
    out |= {f"{n}_range": ~c(n).between(lo, hi) for n, lo, hi in (("type", 0, LAST_TYPE), ("role", UNSET, LAST_ROLE), ("subtype", UNSET, LAST_SUBTYPE))}
    out |= {f"{n}_range": ~c(n).between(-math.pi, math.pi) for n in ("roll", "pitch", "yaw")}
    out |= {f"{n}_not_negative": c(n) < 0 for n in ("idx", "total_nanos")}
    vehicle = c("type") == VEHICLE
    for n in ("role", "subtype"):
        out |= {f"vehicle_has_{n}": vehicle & (c(n) == UNSET), f"other_has_no_{n}": ~vehicle & (c(n) != UNSET)}
    return out


def schema_faults(df: DataFrame) -> list[str]:
    """Missing columns and wrong types."""
    have = {f.name: f.dataType for f in df.schema.fields}
    return [f"{f.name}: missing" if f.name not in have else f"{f.name}: {have[f.name].simpleString()}" for f in TRACKS.fields if have.get(f.name) != f.dataType]


def duplicate_keys(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy(*recording(tracks), "idx", "total_nanos").agg(F.count("*").alias("n")).where("n > 1")


def frame_skips(tracks: DataFrame) -> DataFrame:
    """Rows whose frame does not follow the object's row before."""
    step = F.col("frame") - F.lag("frame").over(W.partitionBy(*recording(tracks), "idx").orderBy("frame"))
    return with_frames(tracks).withColumn("step", F.coalesce(step, F.lit(1))).where("step <> 1")


def report(tracks: DataFrame) -> DataFrame:
    """(rule, violations) for every rule, zero included."""
    rules = row_rules() | {f"null_{c}": F.col(c).isNull() for c in recording(tracks)}
    sums = tracks.agg(*(F.sum(F.when(v, 1).otherwise(0)).alias(k) for k, v in rules.items()))
    pairs = F.array(*(F.struct(F.lit(k).alias("rule"), F.coalesce(F.col(k), F.lit(0)).alias("violations")) for k in rules))
    out = sums.select(F.explode(pairs).alias("p")).select("p.rule", "p.violations")
    keys = duplicate_keys(tracks).agg(F.lit("unique_key").alias("rule"), F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))
    skips = frame_skips(tracks).agg(F.lit("no_frame_skip").alias("rule"), F.count("*").alias("violations"))
    return out.union(keys).union(skips)


def check(tracks: DataFrame) -> DataFrame:
    """tracks, or ValueError that names every rule that is broken."""
    faults = schema_faults(tracks) or [f"{r['rule']}: {r['violations']}" for r in report(tracks).where("violations > 0").collect()]
    if faults:
        raise ValueError("invalid trajectories: " + "; ".join(faults))
    return tracks
