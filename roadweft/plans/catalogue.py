"""The register of queries over trajectories and lanes, and of their SQL.

Trajectories come from the events table; lanes are a grid of ten straight ones, lane i along y = 3 i from x = 0 to
x = 100. Results are rounded, as sines may differ in the last place between engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweft.functions import geometry
from roadweft.operators import convert, graph, interaction, joins, locate, maps, resample, validate
from roadweft.operators import tracks as T
from roadweft.schema import ROLE_NAMES, SUBTYPE_NAMES, TYPE_NAMES
from roadweft.sources.events import SQL, tracks_from_events

EGO, BUFFER = 8, 21_600_000_000_000
LANES, ROADS = 10, 4
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    # adding 0.0 turns a negative zero into zero
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def lanes(spark) -> DataFrame:
    i = F.col("id")
    point = lambda x: F.struct(F.lit(float(x)).alias("x"), (i * 3.0).alias("y"))
    return spark.range(LANES).select(
        i.alias("lane_id"), F.floor(i / 3).cast("string").alias("road_id"), F.when(i % 5 == 4, "7").otherwise("-1").alias("junction_id"), F.array(point(0), point(50), point(100)).alias("centerline"),
        F.when(i < LANES - 1, F.array(i + 1)).otherwise(F.array().cast("array<bigint>")).alias("successor_ids"), F.when(i % 2 == 1, F.array(i - 1)).otherwise(F.array().cast("array<bigint>")).alias("predecessor_ids"),
    )


LANES_SQL = """lanes AS (SELECT range AS lane_id, (range // 3)::VARCHAR AS road_id, CASE WHEN range % 5 = 4 THEN '7' ELSE '-1' END AS junction_id, range * 3.0e0 AS ly FROM range(10)),
given AS (SELECT lane_id AS src, lane_id + 1 AS dst, 'successor' AS label FROM lanes WHERE lane_id < 9 UNION ALL SELECT lane_id, lane_id - 1, 'predecessor' FROM lanes WHERE lane_id % 2 = 1)"""
DISTANCE = """moved AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM tracks WINDOW w AS (PARTITION BY idx ORDER BY total_nanos)),
dist AS (SELECT *, sqrt(vel_x*vel_x + vel_y*vel_y) AS vel, sum(coalesce(sqrt((x-px)*(x-px) + (y-py)*(y-py)), 0)) OVER (PARTITION BY idx ORDER BY total_nanos ROWS UNBOUNDED PRECEDING) AS distance_traveled FROM moved)"""
CROSSED = f"""{DISTANCE},
crossed AS (SELECT a.*, e.idx AS idx_ego, e.total_nanos AS total_nanos_ego, e.x AS xe, e.y AS ye, e.length AS le, e.width AS we, e.yaw AS ae, e.vel AS vel_ego, e.distance_traveled AS distance_traveled_ego
  FROM dist a JOIN dist e ON e.idx = {EGO} AND a.idx <> {EGO} AND a.total_nanos >= e.total_nanos - {BUFFER} AND a.total_nanos <= e.total_nanos + {BUFFER})"""
_AXES = " AND ".join(
    f"abs((xe-x)*({c}) + (ye-y)*({s})) <= length/2*abs(cos(yaw)*({c})+sin(yaw)*({s})) + width/2*abs(-sin(yaw)*({c})+cos(yaw)*({s})) + le/2*abs(cos(ae)*({c})+sin(ae)*({s})) + we/2*abs(-sin(ae)*({c})+cos(ae)*({s}))"
    for c, s in (("cos(yaw)", "sin(yaw)"), ("-sin(yaw)", "cos(yaw)"), ("cos(ae)", "sin(ae)"), ("-sin(ae)", "cos(ae)"))
)
GAPS = f"""{CROSSED},
met AS (SELECT *, (total_nanos - total_nanos_ego) / 1e9 AS timegap FROM crossed WHERE {_AXES}),
timegaps AS (SELECT idx_ego, idx, total_nanos_ego, timegap, total_nanos, distance_traveled, distance_traveled_ego FROM met
  QUALIFY row_number() OVER (PARTITION BY idx_ego, idx, total_nanos_ego ORDER BY abs(timegap), total_nanos) = 1)"""


def _div(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN CASE WHEN {a} > 0 THEN 'inf'::DOUBLE WHEN {a} < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END ELSE {a} / {b} END"


PGAPS = f"""{GAPS},
pj AS (SELECT c.*, g.total_nanos AS t_ov, g.total_nanos_ego AS te_ov, g.distance_traveled AS d_ov, g.distance_traveled_ego AS de_ov FROM crossed c JOIN timegaps g ON c.idx = g.idx AND c.idx_ego = g.idx_ego),
pt AS (SELECT *, CASE WHEN total_nanos >= t_ov THEN (t_ov - total_nanos) / 1e9 ELSE {_div("(d_ov - distance_traveled)", "vel")} END AS tto,
  CASE WHEN total_nanos_ego >= te_ov THEN (te_ov - total_nanos_ego) / 1e9 ELSE {_div("(de_ov - distance_traveled_ego)", "vel_ego")} END AS tte FROM pj),
pg AS (SELECT *, -(tte - tto + (total_nanos_ego - total_nanos) / 1e9) AS p_timegap FROM pt),
p AS (SELECT idx_ego, idx, total_nanos_ego, p_timegap, total_nanos FROM pg QUALIFY row_number() OVER (PARTITION BY idx_ego, idx, total_nanos_ego ORDER BY abs(p_timegap), total_nanos) = 1)"""
W_ = f"WITH {SQL}"
FRAMED = "framed AS (SELECT t.*, f.frame FROM tracks t JOIN (SELECT total_nanos, row_number() OVER (ORDER BY total_nanos) - 1 AS frame FROM (SELECT DISTINCT total_nanos FROM tracks)) f USING (total_nanos))"


@query(f"{W_} SELECT total_nanos, row_number() OVER (ORDER BY total_nanos) - 1 AS frame FROM (SELECT DISTINCT total_nanos FROM tracks)")
def frame_dim(spark, sf_dir):
    return T.frame_dim(tracks_from_events(spark, sf_dir))


@query(f"{W_} SELECT event_id, round(sqrt(vel_x*vel_x + vel_y*vel_y), 6) AS vel, round(sqrt(acc_x*acc_x + acc_y*acc_y), 6) AS acc FROM tracks")
def planar_norms(spark, sf_dir):
    return rounded(T.with_norms(tracks_from_events(spark, sf_dir)).select("event_id", "vel", "acc"), "vel", "acc")


@query(f"""{W_}, {FRAMED},
m AS (SELECT idx, min(type) AS type, min(role) AS role, min(subtype) AS subtype FROM framed GROUP BY idx)
SELECT idx, round(avg(length), 6) AS length, round(avg(width), 6) AS width, round(avg(height), 6) AS height, any_value(m.type) AS type, any_value(m.role) AS role, any_value(m.subtype) AS subtype,
  min(frame) AS birth, max(frame) AS "end", min(total_nanos) AS t_birth, max(total_nanos) AS t_end FROM framed JOIN m USING (idx) GROUP BY idx""")
def object_summary(spark, sf_dir):
    return rounded(T.object_summary(tracks_from_events(spark, sf_dir)), "length", "width", "height")


@query(f"""{W_}, c AS (SELECT event_id, x, y, length, width, yaw, unnest([1, 2, 3, 4, 5]) AS corner, unnest([0.5e0, 0.5e0, -0.5e0, -0.5e0, 0.5e0]) AS u, unnest([0.5e0, -0.5e0, -0.5e0, 0.5e0, 0.5e0]) AS v FROM tracks)
SELECT event_id, corner, round(x + u*length*cos(yaw) - v*width*sin(yaw), 6) + 0.0e0 AS px, round(y + u*length*sin(yaw) + v*width*cos(yaw), 6) + 0.0e0 AS py FROM c""")
def box_ring(spark, sf_dir):
    ring = T.with_ring(tracks_from_events(spark, sf_dir)).select("event_id", F.posexplode("ring").alias("i", "p"))
    return rounded(ring.select("event_id", (F.col("i") + 1).alias("corner"), F.col("p.x").alias("px"), F.col("p.y").alias("py")), "px", "py")


@query("SELECT event_id, round((a + pi()) - 2*pi() * floor((a + pi()) / (2*pi())) - pi(), 6) + 0.0e0 AS wrapped FROM (SELECT event_id, (event_id % 2000 - 1000) / 50.0e0 AS a FROM events)")
def angle_wrap(spark, sf_dir):
    a = (F.col("event_id") % 2000 - 1000) / 50.0
    return rounded(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", geometry.wrap(a).alias("wrapped")), "wrapped")


@query(f"{W_}, {DISTANCE} SELECT event_id, idx, total_nanos, round(distance_traveled, 6) AS distance_traveled FROM dist")
def distance_traveled(spark, sf_dir):
    return rounded(T.distance_traveled(tracks_from_events(spark, sf_dir)).select("event_id", "idx", "total_nanos", "distance_traveled"), "distance_traveled")


@query(f"{W_}, {CROSSED} SELECT idx, total_nanos, idx_ego, total_nanos_ego FROM crossed")
def band_join(spark, sf_dir):
    return joins.ego_band(tracks_from_events(spark, sf_dir), EGO, BUFFER).select("idx", "total_nanos", "idx_ego", "total_nanos_ego")


def metrics(spark, sf_dir) -> dict[str, DataFrame]:
    return interaction.MetricManager().compute(tracks_from_events(spark, sf_dir), ego_id=EGO, time_buffer=BUFFER)[1]


@query(f"{W_}, {GAPS} SELECT idx_ego, idx, total_nanos_ego, round(timegap, 6) AS timegap, total_nanos, round(distance_traveled, 6) AS distance_traveled, round(distance_traveled_ego, 6) AS distance_traveled_ego FROM timegaps")
def timegaps(spark, sf_dir):
    return rounded(metrics(spark, sf_dir)["timegaps"], "timegap", "distance_traveled", "distance_traveled_ego")


@query(f"{W_}, {GAPS} SELECT idx_ego, idx, round(timegap, 6) AS min_timegap FROM timegaps QUALIFY row_number() OVER (PARTITION BY idx_ego, idx ORDER BY abs(timegap), total_nanos_ego) = 1")
def min_timegaps(spark, sf_dir):
    return rounded(metrics(spark, sf_dir)["min_timegaps"], "min_timegap")


def finite(df: DataFrame) -> DataFrame:
    """The gap where it is finite, and whether it is."""
    ok = ~F.isnan("p_timegap") & (F.abs("p_timegap") < float("inf"))
    return df.withColumn("finite", ok).withColumn("p_timegap", F.when(ok, F.round("p_timegap", 4) + F.lit(0.0)))


_P = "CASE WHEN isfinite(p_timegap) THEN round(p_timegap, 4) + 0.0e0 END AS p_timegap, isfinite(p_timegap) AS finite"


@query(f"{W_}, {PGAPS} SELECT idx_ego, idx, total_nanos_ego, {_P} FROM p")
def p_timegaps(spark, sf_dir):
    return finite(metrics(spark, sf_dir)["p_timegaps"]).drop("total_nanos")


@query(f"{W_}, {PGAPS} SELECT idx_ego, idx, {_P} FROM p QUALIFY row_number() OVER (PARTITION BY idx_ego, idx ORDER BY abs(p_timegap), total_nanos_ego) = 1")
def min_p_timegaps(spark, sf_dir):
    return finite(metrics(spark, sf_dir)["min_p_timegaps"])


def _interpolated(grid: str) -> str:
    """Interpolation at grid (t), a common table expression."""
    w = lambda a: f"(({a}) + pi() - 2*pi()*floor((({a}) + pi())/(2*pi())) - pi())"
    return f"""{W_}, {FRAMED}, {grid},
seg AS (SELECT *, lead(total_nanos) OVER w AS t1, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(yaw) OVER w AS yaw1, lead(type) OVER w AS type1 FROM tracks WINDOW w AS (PARTITION BY idx ORDER BY total_nanos)),
placed AS (SELECT seg.*, t, CASE WHEN t1 IS NULL THEN 0 ELSE (t - total_nanos)::DOUBLE / (t1 - total_nanos)::DOUBLE END AS u FROM seg JOIN grid ON t >= total_nanos AND (t < t1 OR t1 IS NULL AND t = total_nanos))
SELECT idx, t AS total_nanos, round(x + u*(coalesce(x1, x) - x), 5) + 0.0e0 AS x, round(y + u*(coalesce(y1, y) - y), 5) + 0.0e0 AS y, round(sin({w("yaw + u*" + w("coalesce(yaw1, yaw) - yaw"))}), 5) + 0.0e0 AS sin_yaw FROM placed"""


def _shown(df: DataFrame) -> DataFrame:
    return rounded(df.select("idx", "total_nanos", "x", "y", F.sin("yaw").alias("sin_yaw")), "x", "y", "sin_yaw", digits=5)


@query(_interpolated("grid AS (SELECT a + i * 10800000000000 AS t FROM (SELECT min(total_nanos) AS a, max(total_nanos) AS b FROM tracks), range(100000) r(i) WHERE i < ceil((b + 1 - a) / 10800000000000.0e0))"))
def interpolate_hz(spark, sf_dir):
    return _shown(resample.interpolate_hz(tracks_from_events(spark, sf_dir), 1 / 10800))


@query(_interpolated("grid AS (SELECT DISTINCT total_nanos + 1000000007 AS t FROM tracks)"))
def interpolate_list(spark, sf_dir):
    """Onto the times of all events, a moment later."""
    tracks = tracks_from_events(spark, sf_dir)
    return _shown(resample.interpolate_times(tracks, tracks.select((F.col("total_nanos") + 1_000_000_007).alias("t"))))


_DEFAULT = "ends AS (SELECT min(total_nanos) AS a, max(total_nanos) AS b, max(frame)::BIGINT AS n FROM framed), grid AS (SELECT CASE WHEN i = n - 1 THEN b ELSE floor(a + i * ((b - a) / (n - 1)::DOUBLE))::BIGINT END AS t FROM ends, range(1000000) r(i) WHERE i < n)"


@query(_interpolated(_DEFAULT))
def interpolate_default(spark, sf_dir):
    """Onto the operator's default grid."""
    tracks = tracks_from_events(spark, sf_dir)
    return _shown(resample.interpolate_times(tracks, resample.default_times(tracks, T.frame_dim(tracks))))


_OFFSETS = "offsets AS (SELECT total_nanos, event_id % 10 * 1.0e0 AS ox, -2.0e0 AS oy, 0.5e0 AS oz, event_id % 3 * 0.1e0 AS oyaw FROM tracks WHERE event_id % 2 = 0)"


def offsets(tracks: DataFrame) -> DataFrame:
    e = F.col("event_id")
    return tracks.where(e % 2 == 0).select("total_nanos", (e % 10 * 1.0).alias("ox"), F.lit(-2.0).alias("oy"), F.lit(0.5).alias("oz"), (e % 3 * 0.1).alias("oyaw"))


@query(f"""{W_}, {_OFFSETS}, j AS (SELECT t.*, coalesce(ox, 1.0e0) AS ox, coalesce(oy, 2.0e0) AS oy, coalesce(oz, 0.0e0) AS oz, coalesce(oyaw, 0.2e0) AS oyaw FROM tracks t LEFT JOIN offsets o USING (total_nanos)),
m AS (SELECT event_id, x AS x_original, x*cos(oyaw) - y*sin(oyaw) + ox - 5.0e0 AS dx, x*sin(oyaw) + y*cos(oyaw) + oy - 6.0e0 AS dy, z + oz - 1.0e0 AS z FROM j)
SELECT event_id, round(dx*cos(0.3e0) + dy*sin(0.3e0), 6) + 0.0e0 AS x, round(dy*cos(0.3e0) - dx*sin(0.3e0), 6) + 0.0e0 AS y, round(z, 6) + 0.0e0 AS z, x_original FROM m""")
def projection_affine(spark, sf_dir):
    tracks = tracks_from_events(spark, sf_dir)
    out = resample.apply_offsets(tracks, offsets(tracks), (1.0, 2.0, 0.0, 0.2), (5.0, 6.0, 1.0, 0.3))
    return rounded(out.select("event_id", "x", "y", "z", "x_original"), "x", "y", "z")


@query(f"{W_}, {_OFFSETS} SELECT event_id, coalesce(ox, 1.0e0) AS ox, ox IS NULL AS is_default FROM tracks LEFT JOIN offsets USING (total_nanos)")
def projection_lookup(spark, sf_dir):
    tracks = tracks_from_events(spark, sf_dir)
    return tracks.join(offsets(tracks), "total_nanos", "left").select("event_id", F.coalesce("ox", F.lit(1.0)).alias("ox"), F.col("ox").isNull().alias("is_default"))


def recordings(spark, sf_dir) -> DataFrame:
    """Two recordings in one table, with the same objects."""
    return tracks_from_events(spark, sf_dir).withColumn("recording_id", (F.col("event_id") % 2).cast("string"))


def _kept_apart(sql: str) -> str:
    """SQL over one recording's tracks, with recordings kept apart."""
    with_id = "rec AS (SELECT *, (event_id % 2)::VARCHAR AS recording_id FROM tracks),"
    sql = sql.removeprefix(f"{W_},").replace("FROM tracks", "FROM rec").replace("PARTITION BY idx", "PARTITION BY recording_id, idx")
    for a, b in (("ON e.idx", "ON a.recording_id = e.recording_id AND e.idx"), ("JOIN grid ON", "JOIN grid ON seg.recording_id = grid.recording_id AND"), ("SELECT idx", "SELECT recording_id, idx")):
        sql = sql.replace(a, b)
    return f"{W_}, {with_id} {sql}"


_FRAMES = "framed AS (SELECT *, dense_rank() OVER (PARTITION BY recording_id ORDER BY total_nanos) - 1 AS frame FROM rec)"


@query(_kept_apart(f"{_FRAMES} SELECT DISTINCT recording_id, total_nanos, frame FROM framed"))
def recordings_frames(spark, sf_dir):
    return T.frame_dim(recordings(spark, sf_dir))


@query(_kept_apart(f"""{_FRAMES} SELECT idx, round(avg(length), 6) AS length, round(avg(width), 6) AS width, round(avg(height), 6) AS height, mode(type) AS type, mode(role) AS role, mode(subtype) AS subtype,
  min(frame) AS birth, max(frame) AS "end", min(total_nanos) AS t_birth, max(total_nanos) AS t_end FROM framed GROUP BY recording_id, idx"""))
def recordings_summary(spark, sf_dir):
    return rounded(T.object_summary(recordings(spark, sf_dir)), "length", "width", "height")


@query(_kept_apart(f"{W_}, {GAPS} SELECT idx_ego, idx, total_nanos_ego, round(timegap, 6) AS timegap, total_nanos, round(distance_traveled, 6) AS distance_traveled, round(distance_traveled_ego, 6) AS distance_traveled_ego FROM timegaps"))
def recordings_timegaps(spark, sf_dir):
    made = interaction.MetricManager().compute(recordings(spark, sf_dir), ego_id=EGO, time_buffer=BUFFER)[1]
    return rounded(made["timegaps"], "timegap", "distance_traveled", "distance_traveled_ego")


@query(_kept_apart(_interpolated("grid AS (SELECT recording_id, a + i * 10800000000000 AS t FROM (SELECT recording_id, min(total_nanos) AS a, max(total_nanos) AS b FROM rec GROUP BY recording_id), range(100000) r(i) WHERE i < ceil((b + 1 - a) / 10800000000000.0e0))").replace(f" {FRAMED},", "")))
def recordings_interpolate(spark, sf_dir):
    tracks = recordings(spark, sf_dir)
    at = resample.interpolate_hz(tracks, 1 / 10800)
    return rounded(at.select("recording_id", "idx", "total_nanos", "x", "y", F.sin("yaw").alias("sin_yaw")), "x", "y", "sin_yaw", digits=5)


def broken(spark, sf_dir) -> DataFrame:
    """Trajectories with planted faults."""
    e = F.col("event_id")
    return tracks_from_events(spark, sf_dir).withColumns({"length": F.when(e % 97 == 0, 0.0).otherwise(F.col("length")), "yaw": F.when(e % 101 == 0, 4.0).otherwise(F.col("yaw")), "role": F.when(e % 89 == 0, 0).otherwise(F.col("role")).cast("long"), "subtype": F.when(e % 83 == 0, -1).otherwise(F.col("subtype")).cast("long"), "x": F.when(e % 79 != 0, F.col("x"))})


@query(f"""{W_}, {FRAMED}, b AS (SELECT * REPLACE (CASE WHEN event_id % 97 = 0 THEN 0 ELSE length END AS length, CASE WHEN event_id % 101 = 0 THEN 4.0e0 ELSE yaw END AS yaw, CASE WHEN event_id % 89 = 0 THEN 0 ELSE role END AS role, CASE WHEN event_id % 83 = 0 THEN -1 ELSE subtype END AS subtype, CASE WHEN event_id % 79 <> 0 THEN x END AS x) FROM framed),
s AS (SELECT frame - lag(frame) OVER (PARTITION BY idx ORDER BY frame) AS step FROM framed)
SELECT 'null_x' AS rule, count(*) FILTER (x IS NULL)::BIGINT AS violations FROM b UNION ALL SELECT 'length_positive', count(*) FILTER (length <= 0) FROM b UNION ALL SELECT 'yaw_range', count(*) FILTER (abs(yaw) > pi()) FROM b
UNION ALL SELECT 'other_has_no_role', count(*) FILTER (type <> 2 AND role <> -1) FROM b UNION ALL SELECT 'vehicle_has_subtype', count(*) FILTER (type = 2 AND subtype = -1) FROM b UNION ALL SELECT 'no_frame_skip', count(*) FILTER (step <> 1) FROM s""")
def validate_report(spark, sf_dir):
    return validate.report(broken(spark, sf_dir)).where("violations > 0").select("rule", F.col("violations").cast("long").alias("violations"))


@query(f"{W_}, {FRAMED} SELECT idx, max(frame) - min(frame) + 1 = count(DISTINCT frame) AS complete FROM framed GROUP BY idx")
def frame_skip(spark, sf_dir):
    return T.no_frame_skip(tracks_from_events(spark, sf_dir))


@query(f"{W_} SELECT idx, total_nanos, count(*) AS n FROM (SELECT idx, total_nanos // 3600000000000 AS total_nanos FROM tracks) GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    hours = F.floor(F.col("total_nanos") / 3_600_000_000_000)
    return validate.duplicate_keys(tracks_from_events(spark, sf_dir).withColumn("total_nanos", hours))


@query(f"{W_} SELECT event_id, CASE type WHEN 2 THEN 'VEHICLE' WHEN 3 THEN 'PEDESTRIAN' END AS type_name FROM tracks")
def enum_lookup(spark, sf_dir):
    return tracks_from_events(spark, sf_dir).select("event_id", T.type_name(F.col("type")).alias("type_name"))


@query(f"""{W_}, c AS (SELECT *, floor(x / 25) AS cell FROM tracks), m AS (SELECT *, coalesce(cell <> lag(cell) OVER w, true) AS moved FROM c WINDOW w AS (PARTITION BY idx ORDER BY total_nanos))
SELECT event_id, moved, last_value(CASE WHEN moved THEN event_id END IGNORE NULLS) OVER (PARTITION BY idx ORDER BY total_nanos ROWS UNBOUNDED PRECEDING) AS place FROM m""")
def moving_filter_ffill(spark, sf_dir):
    coarse = tracks_from_events(spark, sf_dir).withColumns({"x": F.floor(F.col("x") / 25).cast("double"), "y": F.lit(0.0)})
    return T.fill_stationary(T.moving(coarse).withColumn("place", F.col("event_id")), "place").select("event_id", "moved", "place")


_AT = "greatest(0.0e0, least(100.0e0, x))"


@query(f"{W_}, {LANES_SQL} SELECT idx, total_nanos, lane_id, round(abs(y - ly), 6) AS d FROM tracks, lanes WHERE abs(y - ly) <= 1.75")
def lane_candidates(spark, sf_dir):
    return rounded(locate.candidates(tracks_from_events(spark, sf_dir), lanes(spark)).select("idx", "total_nanos", "lane_id", "d"), "d")


@query(f"{W_}, {LANES_SQL} SELECT idx, total_nanos, lane_id, round(abs(y - ly), 6) AS d FROM tracks, lanes QUALIFY rank() OVER (PARTITION BY idx, total_nanos ORDER BY abs(y - ly)) = 1")
def lane_nearest(spark, sf_dir):
    return rounded(locate.nearest(tracks_from_events(spark, sf_dir), lanes(spark)).select("idx", "total_nanos", "lane_id", "d"), "d")


@query(f"{W_}, {LANES_SQL} SELECT event_id, lane_id, round({_AT}, 6) AS s, round(ly - y, 6) + 0.0e0 AS t FROM tracks JOIN lanes ON lane_id = idx % 10")
def frenet_straight(spark, sf_dir):
    joined = tracks_from_events(spark, sf_dir).join(F.broadcast(lanes(spark)), F.col("idx") % LANES == F.col("lane_id"))
    p = geometry.project_on_line(F.col("x"), F.col("y"), F.col("centerline"))
    return rounded(joined.withColumn("p", p).select("event_id", "lane_id", "p.s", "p.t"), "s", "t")


@query(f"WITH {LANES_SQL} SELECT DISTINCT src, dst, label FROM given")
def lane_relation_edges(spark, sf_dir):
    return maps.relation_edges(lanes(spark))


@query(f"WITH {LANES_SQL} SELECT src, dst, label FROM given UNION SELECT dst, src, CASE label WHEN 'successor' THEN 'predecessor' ELSE 'successor' END FROM given")
def align_topology(spark, sf_dir):
    return maps.symmetric(maps.relation_edges(lanes(spark)))


@query(f"WITH {LANES_SQL} SELECT lane_id, i AS part, 4 AS parts, i * 25.0e0 AS x0, (i + 1) * 25.0e0 AS x1, ly AS y0, ly AS y1 FROM lanes, range(4) r(i)")
def split_lanes(spark, sf_dir):
    a, b = maps.ends(F.col("centerline"))
    return maps.split_lanes(lanes(spark), 30.0).select("lane_id", "part", "parts", *(p[c].alias(f"{c}{i}") for i, p in enumerate((a, b)) for c in "xy"))


_BENT = "bent AS (SELECT range AS lane_id, range * 3.0e0 + CASE WHEN range < 5 THEN 0 ELSE 1000 END AS y, 50.0e0 + 5 * range AS size, ceil((50.0e0 + 5 * range) / 52.0e0)::BIGINT AS parts FROM range(10))"


def bent_lanes(spark) -> DataFrame:
    """Lane i leads 40 m east and then 10 + 5 i m north; lanes from 5 on lie a kilometre away."""
    i = F.col("id")
    y = i * 3.0 + F.when(i < 5, 0.0).otherwise(1000.0)
    point = lambda x, dy: F.struct(F.lit(x).alias("x"), (y + dy).alias("y"))
    return spark.range(LANES).select(i.alias("lane_id"), F.array(point(0.0, F.lit(0.0)), point(40.0, F.lit(0.0)), point(40.0, 10.0 + 5.0 * i)).alias("centerline"))


@query(f"""WITH {_BENT}, p AS (SELECT *, k AS part, size * k / parts AS s0, size * (k + 1) / parts AS s1 FROM bent, range(4) r(k) WHERE k < parts)
SELECT lane_id, part, parts, CASE WHEN parts = 1 THEN 3 ELSE 2 END AS points, round(least(s0, 40.0e0), 6) AS x0, round(y + greatest(s0 - 40, 0), 6) AS y0, round(least(s1, 40.0e0), 6) AS x1, round(y + greatest(s1 - 40, 0), 6) AS y1 FROM p""")
def split_bent_lanes(spark, sf_dir):
    """Parts are cut along the line, not its chord; the first lane is short enough and keeps its bend."""
    a, b = maps.ends(F.col("centerline"))
    cut = maps.split_lanes(bent_lanes(spark), 52.0).select("lane_id", "part", "parts", F.size("centerline").alias("points"), *(p[c].alias(f"{c}{i}") for i, p in enumerate((a, b)) for c in "xy"))
    return rounded(cut, "x0", "y0", "x1", "y1")


@query(f"""WITH {LANES_SQL}, {_BENT}, n AS (SELECT lane_id, parts FROM bent)
SELECT lane_id AS src, k AS src_part, lane_id AS dst, k + 1 AS dst_part, 'successor' AS label FROM n, range(4) r(k) WHERE k + 1 < parts
UNION ALL SELECT lane_id, k + 1, lane_id, k, 'predecessor' FROM n, range(4) r(k) WHERE k + 1 < parts
UNION ALL SELECT src, a.parts - 1, dst, 0, label FROM given JOIN n a ON a.lane_id = src WHERE label = 'successor' AND src <> 4
UNION ALL SELECT src, 0, dst, b.parts - 1, label FROM given JOIN n b ON b.lane_id = dst WHERE label = 'predecessor' AND src <> 5""")
def split_topology(spark, sf_dir):
    """Parts follow each other, and the links between lanes a kilometre apart are gone."""
    parts = maps.split_lanes(bent_lanes(spark), 52.0)
    return maps.split_edges(parts, maps.relation_edges(lanes(spark)), 52.0)


@query(f"""WITH {LANES_SQL}, k AS (SELECT lane_id, road_id, CASE WHEN junction_id <> '-1' THEN 0 ELSE 1 END AS kind, CASE WHEN junction_id <> '-1' THEN junction_id ELSE road_id END AS source FROM lanes),
g AS (SELECT *, dense_rank() OVER (ORDER BY kind, source) - 1 AS segment_idx FROM k) SELECT road_id, max(segment_idx) AS segment_idx FROM g GROUP BY road_id""")
def segment_by_road(spark, sf_dir):
    grid = lanes(spark)
    return maps.segment_by_road(grid, maps.lane_segments(maps.road_segments(grid)))


def _names_sql(column: str, names) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


@query(f"{W_} SELECT event_id, {_names_sql('type', TYPE_NAMES)} AS type_name, {_names_sql('role', ROLE_NAMES)} AS role_name, {_names_sql('subtype', SUBTYPE_NAMES)} AS subtype_name FROM tracks")
def code_names(spark, sf_dir):
    return tracks_from_events(spark, sf_dir).select("event_id", T.type_name(F.col("type")).alias("type_name"), T.role_name(F.col("role")).alias("role_name"), T.subtype_name(F.col("subtype")).alias("subtype_name"))


_SHIFT = "shifted AS (SELECT * REPLACE (CASE WHEN event_id % 5 = 0 THEN 3 ELSE type END AS type, CASE WHEN event_id % 3 = 0 THEN -1 ELSE subtype END AS subtype) FROM tracks)"


@query(f"""{W_}, {_SHIFT}, t AS (SELECT idx, type, row_number() OVER (PARTITION BY idx ORDER BY count(*) DESC, type) AS n FROM shifted GROUP BY idx, type), u AS (SELECT idx, subtype, row_number() OVER (PARTITION BY idx ORDER BY count(*) DESC, subtype) AS n FROM shifted GROUP BY idx, subtype)
SELECT idx, t.type, u.subtype FROM t JOIN u USING (idx) WHERE t.n = 1 AND u.n = 1""")
def object_modes(spark, sf_dir):
    """Codes that change within an object: the one that occurs most, the smallest of equals."""
    e = F.col("event_id")
    shifted = tracks_from_events(spark, sf_dir).withColumns({"type": F.when(e % 5 == 0, F.lit(3)).otherwise(F.col("type")).cast("long"), "subtype": F.when(e % 3 == 0, F.lit(-1)).otherwise(F.col("subtype")).cast("long")})
    return T.object_summary(shifted).select("idx", "type", "subtype")


@query(f"""WITH {LANES_SQL}, k AS (SELECT lane_id, CASE WHEN junction_id <> '-1' THEN 'junction' ELSE 'no_junction' END AS kind, CASE WHEN junction_id <> '-1' THEN junction_id ELSE road_id END AS source FROM lanes),
g AS (SELECT kind, source, string_agg(lane_id::VARCHAR, ',' ORDER BY lane_id) AS lane_ids FROM k GROUP BY ALL) SELECT kind, source, lane_ids, row_number() OVER (ORDER BY kind, source) - 1 AS segment_idx FROM g""")
def odr_segments(spark, sf_dir):
    return maps.road_segments(lanes(spark)).withColumn("lane_ids", F.array_join(F.transform("lane_ids", lambda x: x.cast("string")), ","))


@query(f"WITH {LANES_SQL} SELECT a.lane_id AS a, b.lane_id AS b FROM lanes a JOIN lanes b ON a.lane_id < b.lane_id AND b.ly - a.ly <= 10")
def parallel_lanes(spark, sf_dir):
    return maps.parallel_lanes(lanes(spark))


def crossing_lanes(spark) -> DataFrame:
    """The grid, and five lanes across it at x = 20 i from y = 0 to 3 i."""
    i = F.col("id")
    point = lambda y: F.struct((i * 20.0).alias("x"), y.alias("y"))
    across = spark.range(1, 6).select((i + 100).alias("lane_id"), F.array(point(F.lit(-1.0)), point(i * 3.0 + 1.0)).alias("centerline"))
    return lanes(spark).select("lane_id", "centerline").union(across)


@query(f"WITH {LANES_SQL} SELECT lane_id AS a, 100 + i AS b FROM lanes, range(1, 6) r(i) WHERE lane_id <= i AND NOT (lane_id = 0 AND i = 3)")
def intersecting_lanes(spark, sf_dir):
    return maps.intersecting_lanes(crossing_lanes(spark), spark.createDataFrame([(103, 0)], "a long, b long"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT c_custkey AS a, 1000000 + c_nationkey * 10 + c_custkey % 3 AS b FROM customer), n AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, low) AS (SELECT a, a FROM n UNION SELECT n.b, r.low FROM r JOIN n ON n.a = r.node WHERE r.low < n.b) SELECT node, min(low) AS component FROM r GROUP BY node""")
def components(spark, sf_dir):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    edges = customer.select(F.col("c_custkey").cast("long").alias("a"), (1_000_000 + F.col("c_nationkey") * 10 + F.col("c_custkey") % 3).cast("long").alias("b"))
    roots = graph.components(edges)
    return roots.join(roots.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")


@query(f"""WITH {LANES_SQL}, s AS (SELECT src, dst FROM given WHERE label = 'successor' UNION SELECT dst, src FROM given WHERE label = 'predecessor'), i AS (SELECT lane_id FROM lanes WHERE junction_id <> '-1')
SELECT lane_id, lane_id IN (SELECT lane_id FROM i) AS on_intersection, lane_id NOT IN (SELECT lane_id FROM i) AND lane_id IN (SELECT src FROM s WHERE dst IN (SELECT lane_id FROM i)) AS is_approaching FROM lanes""")
def approaching_lanes(spark, sf_dir):
    grid = lanes(spark)
    return maps.approaching(grid, maps.relation_edges(grid), grid.where("junction_id <> '-1'"))


_LOCATED = "located AS (SELECT idx, total_nanos, (idx % 10 + event_id % 2) % 10 AS lane_id, (idx % 10 + event_id % 2) % 10 // 3 AS segment_idx FROM tracks)"
_ISLANDS = "n AS (SELECT *, CASE WHEN segment_idx IS NOT DISTINCT FROM lag(segment_idx) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM located WINDOW w AS (PARTITION BY idx ORDER BY total_nanos)), r AS (SELECT *, sum(new) OVER (PARTITION BY idx ORDER BY total_nanos ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS run FROM n)"


def located(spark, sf_dir) -> DataFrame:
    return tracks_from_events(spark, sf_dir).select("idx", "total_nanos", ((F.col("idx") % 10 + F.col("event_id") % 2) % 10).alias("lane_id"))


@query(f"{W_}, {_LOCATED}, {_ISLANDS} SELECT idx, run, segment_idx, min(total_nanos) AS first, max(total_nanos) AS last, count(*) AS n FROM r GROUP BY ALL")
def segment_chunks(spark, sf_dir):
    where = lanes(spark).select("lane_id", F.floor(F.col("lane_id") / 3).alias("segment_idx"))
    return locate.segment_chunks(located(spark, sf_dir), where)


@query(f"{W_}, {_LOCATED.replace('// 3 AS', '% 4 AS')}, {_ISLANDS} SELECT idx, run, segment_idx AS value, min(total_nanos) AS first, max(total_nanos) AS last, count(*) AS n FROM r GROUP BY ALL")
def run_length_split(spark, sf_dir):
    return T.runs(located(spark, sf_dir).withColumn("value", F.col("lane_id") % 4), "idx", "total_nanos", "value")


@query(f"{W_} SELECT s AS segment_idx, idx, min(total_nanos) AS t_in, max(total_nanos) AS t_out FROM tracks, range(4) r(s) WHERE x > s * 25 AND x < s * 25 + 20 AND y > 3 AND y < 12 GROUP BY ALL")
def time_on_segment(spark, sf_dir):
    i = F.col("id")
    corners = ((0.0, 3.0), (20.0, 3.0), (20.0, 12.0), (0.0, 12.0), (0.0, 3.0))
    areas = spark.range(4).select(i.alias("segment_idx"), F.array(*(F.struct((i * 25.0 + a).alias("x"), F.lit(b).alias("y")) for a, b in corners)).alias("ring"))
    return locate.time_on_segment(tracks_from_events(spark, sf_dir), areas)


@query(f"{W_}, {LANES_SQL} SELECT event_id AS light_id, lane_id, round(abs(y - ly), 6) AS distance FROM tracks, lanes QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(y - ly), lane_id) = 1")
def light_nearest(spark, sf_dir):
    lights = tracks_from_events(spark, sf_dir).select(F.col("event_id").alias("light_id"), "x", "y")
    return rounded(maps.nearest_lane(lights, lanes(spark)), "distance")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 2 ELSE 3 END AS type, CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 2 ELSE -1 END AS role, CASE event_type WHEN 'click' THEN {car} WHEN 'view' THEN {bike} ELSE -1 END AS subtype FROM events".format(car=convert.VEHICLES["car"], bike=convert.VEHICLES["bicycle"]))
def convert_classes(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "Car").when(F.col("event_type") == "view", "bicycle").otherwise("motorcycle")
    return convert.with_codes(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", kind.alias("class"))).select("event_id", "type", "role", "subtype")


@query("SELECT event_id, (event_id % 2 + 1) * 180.0e0 AS heading, 4.0e0 + user_id % 3 AS length, 1.0e0 + user_id % 2 AS width FROM events")
def highd_swap(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    raw = e.select("event_id", (F.col("event_id") % 2 + 1).alias("drivingDirection"), (4.0 + F.col("user_id") % 3).alias("width"), (1.0 + F.col("user_id") % 2).alias("height"))
    return convert.highd(raw).select("event_id", "heading", "length", "width")


@query(f"{W_} SELECT event_id, idx FROM tracks UNION ALL SELECT event_id, idx FROM tracks")
def union_tracks(spark, sf_dir):
    """Two whole tables, one after the other."""
    tracks = tracks_from_events(spark, sf_dir).select("event_id", "idx")
    return tracks.unionByName(tracks)


@query(f"{W_}, {FRAMED} SELECT event_id, frame FROM framed WHERE frame >= 100 AND frame < 300")
def frame_range(spark, sf_dir):
    return T.frame_range(T.with_frames(tracks_from_events(spark, sf_dir)), 100, 300).select("event_id", "frame")


@query(f"{W_} SELECT min(x) - max(length) AS x_min, max(x) + max(length) AS x_max, min(y) - max(length) AS y_min, max(y) + max(length) AS y_max FROM tracks")
def view_box(spark, sf_dir):
    return T.view_box(tracks_from_events(spark, sf_dir))


@query(f"WITH {LANES_SQL}, s AS (SELECT lane_id, CASE WHEN lane_id < 9 THEN lane_id + 1 END AS after_id, CASE WHEN lane_id % 2 = 1 THEN lane_id - 1 END AS before_id FROM lanes) SELECT lane_id AS out_id, before_id, after_id FROM s")
def centerline_export(spark, sf_dir):
    return maps.centerline_export(lanes(spark))


@query(None)
def locate_tracks(spark, sf_dir):
    """Lane, s and t of each row by the cheapest path over lanes."""
    grid = lanes(spark)
    return locate.locate(tracks_from_events(spark, sf_dir), grid, maps.lane_edges(grid))
