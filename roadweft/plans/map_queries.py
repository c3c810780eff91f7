"""Queries over maps built from the nation table, and their SQL: OpenDRIVE texts and coordinate systems."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweft.functions import crs, geometry
from roadweft.operators import locate
from roadweft.operators import maps as lane_maps
from roadweft.operators import tracks as T
from roadweft.plans import segmentation
from roadweft.plans.staging import fresh_path
from roadweft.schema import SUBTYPE_NAMES
from roadweft.sources import opendrive, traces
from roadweft.sources.events import SQL, tracks_from_events

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return keep


#: A line of 50 m and an arc of 50 m, with an offset of 0.5, a lane of 3 m on the left and a widening one on the right.
TEXT = """<OpenDRIVE><header><geoReference>+proj=utm +zone={} +datum=WGS84</geoReference><offset x="{}" y="2.5" hdg="0.25"/></header>
<road id="{}" length="100" junction="{}"><link><successor elementType="road" elementId="{}" contactPoint="start"/></link>
<planView><geometry s="0" x="{}" y="0" hdg="0" length="50"><line/></geometry><geometry s="50" x="{}" y="0" hdg="0" length="50"><arc curvature="0.01"/></geometry></planView>
<lanes><laneOffset s="0" a="0.5" b="0" c="0" d="0"/><laneSection s="0"><left><lane id="1" type="sidewalk"><width sOffset="0" a="3" b="0" c="0" d="0"/></lane></left>
<center><lane id="0" type="none"/></center><right><lane id="-1" type="driving"><link><successor id="-1"/></link><width sOffset="0" a="3.5" b="0.01" c="0" d="0"/>
<roadMark sOffset="0" type="broken"/><roadMark sOffset="0" type="solid"/></lane></right></laneSection></lanes></road></OpenDRIVE>"""


def maps(spark, sf_dir) -> DataFrame:
    """A map for each nation."""
    k = F.col("n_nationkey")
    values = (k % 60 + 1, k, k, F.when(k % 2 == 0, -1).otherwise(k), k, k * 10, k * 10 + 50)
    text = F.format_string(TEXT.replace("{}", "%s"), *(v.cast("string") for v in values))
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(k.cast("string").alias("map_name"), text.alias("text"))


def _rounded(c, digits: int = 6):
    return F.round(c, digits) + F.lit(0.0)


@query("""SELECT n_nationkey::VARCHAR AS map_name, lane, 101 AS n, CASE WHEN n_nationkey % 2 <> 0 THEN 'INTERSECTION' WHEN lane = 1 THEN 'NONDRIVING' ELSE 'DRIVING' END AS type, CASE lane WHEN 1 THEN 'SIDEWALK' ELSE 'NORMAL' END AS subtype,
round(n_nationkey * 10 + 50 + sin(0.5e0) / 0.01e0 - t * sin(0.5e0), 6) AS x_end, round((1 - cos(0.5e0)) / 0.01e0 + t * cos(0.5e0), 6) AS y_end, CASE lane WHEN 1 THEN 0 ELSE 1 END AS successors
FROM nation, (SELECT 1::BIGINT AS lane, 2.0e0 AS t UNION ALL SELECT -1, -1.75e0)""")
def opendrive_lanes(spark, sf_dir):
    end = F.element_at("centerline", -1)
    return opendrive.parse_maps(maps(spark, sf_dir), 1.0).select("map_name", F.col("lane_id.lane_id").alias("lane"), F.size("centerline").alias("n"), "type", "subtype", _rounded(end["x"]).alias("x_end"), _rounded(end["y"]).alias("y_end"), F.size("successor_ids").alias("successors"))


@query("""SELECT n_nationkey::VARCHAR AS map_name, lane, side, CASE WHEN lane = 1 THEN 'UNKNOWN' WHEN side = 'left' THEN 'SOLID_LINE' ELSE 'DASHED_LINE' END AS type, n_nationkey * 10.0e0 AS x, CASE WHEN side = 'right' THEN 0.5e0 WHEN lane = 1 THEN 3.5e0 ELSE -3.0e0 END AS y
FROM nation, (SELECT 1::BIGINT AS lane UNION ALL SELECT -1), (SELECT 'left' AS side UNION ALL SELECT 'right')""")
def opendrive_boundaries(spark, sf_dir):
    start = F.element_at("polyline", 1)
    return opendrive.boundaries(opendrive.parse_maps(maps(spark, sf_dir), 1.0)).select("map_name", F.col("lane_id.lane_id").alias("lane"), "side", "type", _rounded(start["x"]).alias("x"), _rounded(start["y"]).alias("y"))


@query("SELECT n_nationkey::VARCHAR AS map_name, '+proj=utm +zone=' || (n_nationkey % 60 + 1) || ' +datum=WGS84' AS proj_string, n_nationkey::DOUBLE AS x, 2.5e0 AS y, 0.0e0 AS z, 0.25e0 AS yaw FROM nation")
def opendrive_headers(spark, sf_dir):
    return opendrive.headers(maps(spark, sf_dir))


def _projection_sql() -> str:
    """Places in UTM zone 32 from degrees, written out for SQL."""
    zone = crs.Crs.utm(32)
    radius, e, _, forward, _ = zone.shape()
    scale = zone.k * radius
    north = "xi + " + " + ".join(f"({c!r}) * sin({2 * j + 2} * xi) * cosh({2 * j + 2} * eta)" for j, c in enumerate(forward))
    east = "eta + " + " + ".join(f"({c!r}) * cos({2 * j + 2} * xi) * sinh({2 * j + 2} * eta)" for j, c in enumerate(forward))
    return f"""WITH d AS (SELECT event_id, 6 + event_id % 600 / 100.0e0 AS lon, 30 + event_id % 4000 / 100.0e0 AS lat FROM events),
t AS (SELECT *, tan(radians(lat)) AS tau, sinh({e!r} * atanh({e!r} * sin(radians(lat)))) AS sigma, radians(lon - 9) AS turn FROM d),
c AS (SELECT *, tau * sqrt(1 + sigma * sigma) - sigma * sqrt(1 + tau * tau) AS tc FROM t),
s AS (SELECT *, atan2(tc, cos(turn)) AS xi, asinh(sin(turn) / sqrt(tc * tc + cos(turn) * cos(turn))) AS eta FROM c)
SELECT event_id, round(500000 + {scale!r} * ({east}), 4) AS x, round({scale!r} * ({north}), 4) AS y, round(lon, 8) AS lon, round(lat, 8) AS lat FROM s"""


@query(_projection_sql())
def utm_round_trip(spark, sf_dir):
    """Degrees to metres, and back again."""
    e, zone, degrees = F.col("event_id"), crs.Crs.utm(32), crs.Crs("longlat")
    places = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (6 + e % 600 / 100.0).alias("lon"), (30 + e % 4000 / 100.0).alias("lat"))
    moved = places.select("event_id", crs.transform(F.col("lon"), F.col("lat"), degrees, zone).alias("m"))
    back = moved.withColumn("b", crs.transform(F.col("m.x"), F.col("m.y"), zone, degrees))
    return back.select("event_id", F.round("m.x", 4).alias("x"), F.round("m.y", 4).alias("y"), F.round("b.x", 8).alias("lon"), F.round("b.y", 8).alias("lat"))


@query(f"WITH {SQL} SELECT idx, total_nanos, round(x, 6) AS x, round(yaw, 6) AS yaw, type, role FROM tracks")
def trace_round_trip(spark, sf_dir):
    """Trajectories written as one MCAP file and read again."""
    path = fresh_path(spark, "trace") + ".mcap"
    traces.write_mcap(traces.to_messages(tracks_from_events(spark, sf_dir)), path)
    back = traces.moving_objects(traces.read_messages(spark, path))
    return back.select("idx", "total_nanos", F.round("x", 6).alias("x"), F.round("yaw", 6).alias("yaw"), "type", "role")


#: Lanes of a crossroad: number, points, successors, predecessors. 1 and 2 cross, 8 and 9 cross close by, 7 lies inside, 6 leaves and returns.
CROSSROAD = (
    (1, ((0, 0), (20, 0)), (4,), (3,)), (2, ((10, -10), (10, 10)), (), (5,)), (3, ((-50, 0), (0, 0)), (1,), ()), (4, ((20, 0), (70, 0)), (), (1,)), (5, ((10, -60), (10, -10)), (2,), ()),
    (6, ((25, -5), (15, -20)), (2,), (1,)), (7, ((2, 0.5), (6, 0.6)), (), ()), (8, ((10, 11), (10, 30)), (), ()), (9, ((5, 20), (15, 20)), (), ()),
)


def crossroads(spark, sf_dir) -> DataFrame:
    """A crossroad for each nation, a kilometre apart."""
    k = F.col("n_nationkey").cast("long")
    ids = lambda v: F.array(*(k * 10 + i for i in v)).cast("array<bigint>")
    point = lambda x, y: F.struct((k * 1000 + float(x)).alias("x"), F.lit(float(y)).alias("y"))
    lanes = F.array(*(F.struct((k * 10 + n).alias("lane_id"), F.array(*(point(*p) for p in line)).alias("centerline"), ids(after).alias("successor_ids"), ids(before).alias("predecessor_ids")) for n, line, after, before in CROSSROAD))
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.inline(lanes))


@query("SELECT (n_nationkey * 10 + n)::BIGINT AS lane_id, (n_nationkey * 10 + CASE WHEN n IN (3, 4, 5) THEN n ELSE 1 END)::BIGINT AS segment, CASE WHEN n IN (3, 4, 5) THEN 'no_junction' ELSE 'junction' END AS kind FROM nation, range(1, 10) r(n)")
def centerline_segments(spark, sf_dir):
    return segmentation.centerline_segments(crossroads(spark, sf_dir))


@query("""WITH s AS (SELECT n_nationkey AS k, n FROM nation, (VALUES (1), (3), (4), (5)) v(n)) SELECT (k * 10 + n)::BIGINT AS segment, CASE n WHEN 1 THEN 6 ELSE 1 END AS lanes,
CASE n WHEN 1 THEN k * 1000 + 0.0e0 WHEN 3 THEN k * 1000 - 50.0e0 WHEN 4 THEN k * 1000 + 20.0e0 ELSE k * 1000 + 10.0e0 END AS x_min, CASE n WHEN 1 THEN 30.0e0 WHEN 5 THEN -10.0e0 ELSE 0.0e0 END AS y_max FROM s""")
def segment_hulls(spark, sf_dir):
    lanes = crossroads(spark, sf_dir)
    table = segmentation.segment_table(segmentation.centerline_segments(lanes), lanes)
    return table.select("segment", F.size("lane_ids").alias("lanes"), F.array_min("ring.x").alias("x_min"), F.array_max("ring.y").alias("y_max"))


@query(f"WITH {SQL} SELECT event_id, round(x - 30, 6) AS s, round(3.0e0 * (idx % 10) - y, 6) + 0.0e0 AS t FROM tracks")
def frenet_extended(spark, sf_dir):
    """Along and across a line of 10 m that places lie before, beside and after."""
    y = (F.col("idx") % 10) * 3.0
    line = F.array(*(F.struct(F.lit(x).alias("x"), y.alias("y")) for x in (30.0, 40.0)))
    out = tracks_from_events(spark, sf_dir).withColumn("p", locate.along(F.col("x"), F.col("y"), geometry.extended(line, locate.EXTENT)))
    return out.select("event_id", _rounded(F.col("p.s")).alias("s"), _rounded(F.col("p.t")).alias("t"))


@query("SELECT n_nationkey AS k, i, round(u * 10, 6) AS x, round(1 + n_nationkey * (CASE WHEN u <= 0.5e0 THEN u ELSE 0.5e0 END), 6) AS y FROM nation, (VALUES (0, 0.0e0), (1, 0.25e0), (2, 0.5e0), (3, 1.0e0)) v(i, u)")
def middle_lines(spark, sf_dir):
    """Between a border along y = 2 with a point at a quarter, and one of two steps of equal length that rises and goes level."""
    k = F.col("n_nationkey").cast("double")
    point = lambda x, y: F.struct(F.lit(x).alias("x"), (y if not isinstance(y, float) else F.lit(y)).alias("y"))
    left = F.array(point(0.0, 2.0), point(2.5, 2.0), point(10.0, 2.0))
    # the second step is as long as the first
    step = F.sqrt(25 + k * k)
    right = F.array(point(0.0, F.lit(0.0)), point(5.0, k), F.struct((5 + step).alias("x"), k.alias("y")))
    lines = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("k"), step.alias("step"), F.posexplode(geometry.middle_line(left, right)).alias("i", "p"))
    # the level part is stretched back to a length of 5
    x = F.when(F.col("i") == 3, F.col("p.x") - (F.col("step") - 5) / 2).otherwise(F.col("p.x"))
    return lines.select("k", "i", F.round(x, 6).alias("x"), F.round(F.col("p.y") + 0.0, 6).alias("y"))


_SUBTYPES = "CASE subtype " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(SUBTYPE_NAMES)) + " END"


@query("""SELECT n_nationkey AS k, n_nationkey::DOUBLE AS x_left, 2.0e0 AS y_left, n_nationkey::DOUBLE AS x_right, -2.0e0 AS y_right, n_nationkey + 10.0e0 AS x_end FROM nation""")
def border_orientation(spark, sf_dir):
    """Borders drawn against the lane on every second map, the right one on every third."""
    k = F.col("n_nationkey")
    point = lambda x, y: F.struct((k + x).alias("x"), F.lit(y).alias("y"))
    line = lambda y: F.array(point(0.0, y), point(3.0, y), point(10.0, y))
    lanes = spark.read.parquet(f"{sf_dir}/nation.parquet").select(k.alias("k"), line(0.0).alias("centerline"), F.when(k % 2 == 1, F.reverse(line(2.0))).otherwise(line(2.0)).alias("left_line"), F.when(k % 3 == 0, F.reverse(line(-2.0))).otherwise(line(-2.0)).alias("right_line"))
    found = lane_maps.border_points(lanes)
    start = [F.col("start_points")[i] for i in (0, 1)]
    return found.select("k", start[0]["x"].alias("x_left"), start[0]["y"].alias("y_left"), start[1]["x"].alias("x_right"), start[1]["y"].alias("y_right"), F.col("end_points")[0]["x"].alias("x_end"))


@query(f"""WITH {SQL}, f AS (SELECT total_nanos, row_number() OVER (ORDER BY total_nanos) - 1 AS frame FROM (SELECT DISTINCT total_nanos FROM tracks))
SELECT frame, idx, round(degrees(yaw), 6) AS heading, round(length / 4, 6) AS wedge, concat_ws('-', CASE type WHEN 2 THEN 'VEHICLE' WHEN 3 THEN 'PEDESTRIAN' END, {_SUBTYPES}) AS label
FROM tracks JOIN f USING (total_nanos) WHERE frame >= 10 AND frame < 500""")
def frame_shapes(spark, sf_dir):
    return T.frame_shapes(tracks_from_events(spark, sf_dir), 10, 500).select("frame", "idx", F.round("heading", 6).alias("heading"), F.round("wedge", 6).alias("wedge"), "label")
