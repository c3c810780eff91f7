"""Columns and summaries of the trajectory table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from roadweft.functions import geometry
from roadweft.schema import ROLE_NAMES, SUBTYPE_NAMES, TYPE_NAMES, recording


def frame_dim(tracks: DataFrame) -> DataFrame:
    """(total_nanos, frame): distinct times numbered from 0, in each recording by itself.

    Numbers are row numbers within ranges of times plus the size of the ranges before, so no task orders all times.
    """
    spark, key = tracks.sparkSession, recording(tracks)
    times = tracks.select(*key, "total_nanos").distinct()
    if key:
        return _frames_of_recordings(times, key)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the range number is written out of the plan's physical order: one number for each range of times
    low, high = times.agg(F.min("total_nanos"), F.max("total_nanos")).first()
    if low is None:
        return times.withColumn("frame", F.lit(0).cast("long"))
    width = max(1, (high - low) // n + 1)
    times = times.withColumn("part", F.floor((F.col("total_nanos") - low) / width))
    sizes = times.groupBy("part").agg(F.count("*").alias("n"))
    base = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.row_number().over(W.partitionBy("part").orderBy("total_nanos")) - 1
    return times.withColumn("inside", inside).join(F.broadcast(base), "part").select("total_nanos", (F.col("base") + F.col("inside")).alias("frame"))


def _frames_of_recordings(times: DataFrame, key: list[str]) -> DataFrame:
    """Frames of many recordings: each has ranges of its own, over its own span."""
    n = int(times.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = times.groupBy(*key).agg(F.min("total_nanos").alias("low"), F.max("total_nanos").alias("high"))
    width = F.floor((F.col("high") - F.col("low")) / n) + 1
    times = times.join(ends, key).select(*key, "total_nanos", F.floor((F.col("total_nanos") - F.col("low")) / width).alias("part"))
    sizes = times.groupBy(*key, "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy(*key).orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    base = sizes.select(*key, "part", F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.row_number().over(W.partitionBy(*key, "part").orderBy("total_nanos")) - 1
    return times.withColumn("inside", inside).join(base, [*key, "part"]).select(*key, "total_nanos", (F.col("base") + F.col("inside")).alias("frame"))


def with_frames(tracks: DataFrame) -> DataFrame:
    return tracks.drop("frame").join(frame_dim(tracks), [*recording(tracks), "total_nanos"], "left")


def with_norms(tracks: DataFrame) -> DataFrame:
    """vel and acc in the plane, where the columns are not there yet."""
    add = {c: geometry.norm(F.col(f"{c}_x"), F.col(f"{c}_y")) for c in ("vel", "acc") if c not in tracks.columns}
    return tracks.withColumns(add) if add else tracks


def with_ring(tracks: DataFrame) -> DataFrame:
    return tracks.withColumn("ring", geometry.box_ring(*(F.col(c) for c in ("x", "y", "length", "width", "yaw"))))


def object_summary(tracks: DataFrame) -> DataFrame:
    """Per object: mean sizes, smallest mode of the codes, first and last frame and time."""
    framed = tracks if "frame" in tracks.columns else with_frames(tracks)
    return framed.groupBy(*recording(framed), "idx").agg(
        *(F.avg(c).alias(c) for c in ("length", "width", "height")), *(F.mode(c, True).alias(c) for c in ("type", "role", "subtype")),
        F.min("frame").alias("birth"), F.max("frame").alias("end"), F.min("total_nanos").alias("t_birth"), F.max("total_nanos").alias("t_end"),
    )


def _name(code: Column, names: tuple[str, ...]) -> Column:
    return F.get(F.array(*map(F.lit, names)), F.when(code >= 0, code.cast("int")))


def type_name(code: Column) -> Column:
    return _name(code, TYPE_NAMES)


def role_name(code: Column) -> Column:
    """Null for no vehicle (-1)."""
    return _name(code, ROLE_NAMES)


def subtype_name(code: Column) -> Column:
    """Null for no vehicle (-1)."""
    return _name(code, SUBTYPE_NAMES)


def steps(tracks: DataFrame) -> DataFrame:
    """dx, dy from the object's row before; null for its first."""
    order = W.partitionBy(*recording(tracks), "idx").orderBy("total_nanos")
    return tracks.withColumns({f"d{c}": F.col(c) - F.lag(c).over(order) for c in ("x", "y")})


def distance_traveled(tracks: DataFrame) -> DataFrame:
    """Length of each object's path up to each row."""
    order = W.partitionBy(*recording(tracks), "idx").orderBy("total_nanos")
    step = F.coalesce(geometry.norm(F.col("dx"), F.col("dy")), F.lit(0.0))
    return steps(tracks).withColumn("_step", step).withColumn("distance_traveled", F.sum("_step").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("dx", "dy", "_step")


def moving(tracks: DataFrame) -> DataFrame:
    """moved: whether a row differs in place from the one before; true for an object's first."""
    return steps(tracks).withColumn("moved", F.coalesce((F.col("dx") != 0) | (F.col("dy") != 0), F.lit(True))).drop("dx", "dy")


def fill_stationary(tracks: DataFrame, column: str) -> DataFrame:
    """column taken from the last row that moved."""
    order = W.partitionBy(*recording(tracks), "idx").orderBy("total_nanos").rowsBetween(W.unboundedPreceding, 0)
    return tracks.withColumn(column, F.last(F.when(F.col("moved"), F.col(column)), ignorenulls=True).over(order))


def runs(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Gaps and islands: (key, run, value, first, last, n) for each stretch of equal values."""
    keys = [*recording(df), key]
    w = W.partitionBy(*keys).orderBy(order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1)
    return numbered.groupBy(*keys, "run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def no_frame_skip(tracks: DataFrame) -> DataFrame:
    """(idx, complete): whether an object has a row at each frame from its first to its last."""
    framed = tracks if "frame" in tracks.columns else with_frames(tracks)
    return framed.groupBy(*recording(framed), "idx").agg((F.max("frame") - F.min("frame") + 1 == F.countDistinct("frame")).alias("complete"))


def frame_range(tracks: DataFrame, start: int, end: int = -1) -> DataFrame:
    """Rows of frames start to end, end not included; -1 means all that follow."""
    return tracks.where(F.col("frame") >= start) if end == -1 else tracks.where((F.col("frame") >= start) & (F.col("frame") < end))


def view_box(tracks: DataFrame) -> DataFrame:
    """Bounds of all places, widened by the longest object."""
    m = F.max("length")
    return tracks.groupBy(*recording(tracks)).agg((F.min("x") - m).alias("x_min"), (F.max("x") + m).alias("x_max"), (F.min("y") - m).alias("y_min"), (F.max("y") + m).alias("y_max"))


def frame_shapes(tracks: DataFrame, start: int = 0, end: int = -1) -> DataFrame:
    """What a chart of frames draws: box corners, heading in degrees, the length of the heading's wedge and a label of the codes."""
    shown = with_ring(frame_range(tracks if "frame" in tracks.columns else with_frames(tracks), start, end))
    label = F.concat_ws("-", type_name(F.col("type")), subtype_name(F.col("subtype")))
    return shown.select(*recording(shown), "frame", "idx", "x", "y", "ring", F.degrees("yaw").alias("heading"), (F.col("length") / 4).alias("wedge"), label.alias("label"))
