"""Segments of a map known by its centre lines: intersections where lanes cross, and the connections between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from roadweft.functions import geometry
from roadweft.operators import hulls, maps
from roadweft.operators.joins import cells
from roadweft.plans.staging import stage

#: Metres: a lane's half width at crossings, the rim of an intersection, half the gap that two intersections may have,
#: and the gap of connections that border on one intersection or none.
LANE, RIM, OVERLAP, GAP = 0.3, 0.1, 1.0, 5.0


def near_groups(rings: DataFrame, distance: float) -> DataFrame:
    """Pairs of groups (a, b) whose rings come within distance."""
    pairs = maps.near_pairs(rings.select(F.col("group").alias("lane_id"), F.col("ring").alias("centerline")), distance)
    return pairs.where(hulls.ring_distance(F.col("line_a"), F.col("line_b")) <= distance).select("a", "b")


def merged(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """members (lane_id, group) with paired groups joined, named by their smallest group."""
    names = maps.crossing_groups(pairs).select(F.col("lane_id").alias("group"), F.col("group").alias("into"))
    return members.join(names, "group", "left").select("lane_id", F.coalesce("into", "group").alias("group"))


def contained(lanes: DataFrame, members: DataFrame, rings: DataFrame, buffer: float, size: float = 50.0) -> DataFrame:
    """(lane_id, group) of lanes outside all groups that lie within buffer of a group's ring; the smallest such group."""
    xs, ys = F.col("ring.x"), F.col("ring.y")
    box = rings.withColumns({"x_lo": F.array_min(xs) - buffer, "x_hi": F.array_max(xs) + buffer, "y_lo": F.array_min(ys) - buffer, "y_hi": F.array_max(ys) + buffer})
    start = F.element_at("centerline", 1)
    free = lanes.select("lane_id", "centerline").join(members.select("lane_id"), "lane_id", "left_anti")
    placed = free.withColumns({"cx": F.floor(start["x"] / size), "cy": F.floor(start["y"] / size)})
    met = placed.join(cells(box, size, "x_lo", "x_hi", "y_lo", "y_hi"), ["cx", "cy"])
    within = F.forall("centerline", lambda p: hulls.point_ring_distance(p["x"], p["y"], F.col("ring")) <= buffer)
    return met.where(within).groupBy("lane_id").agg(F.min("group").alias("group"))


def connections(lanes: DataFrame, edges: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lanes outside intersections by topology: ((lane_id, group) that an intersection takes in, (lane_id, group, borders) of the rest).

    A group that leaves and meets one and the same intersection is taken in.
    """
    free = lanes.select("lane_id").join(members, "lane_id", "left_anti")
    links = edges.where("label in ('successor', 'predecessor')").select("src", "dst", "label")
    inner = links.join(free.withColumnRenamed("lane_id", "src"), "src", "left_semi").join(free.withColumnRenamed("lane_id", "dst"), "dst", "left_semi")
    named = maps.crossing_groups(inner.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    groups = free.join(named, "lane_id", "left").select("lane_id", F.coalesce("group", "lane_id").alias("group"))
    out = links.join(members.select(F.col("lane_id").alias("dst"), F.col("group").alias("border")), "dst")
    ends = groups.join(out.withColumnRenamed("src", "lane_id"), "lane_id").groupBy("group").agg(F.sort_array(F.collect_set("border")).alias("borders"), F.count_distinct("label").alias("ways"))
    whole = groups.join(ends, "group", "left").withColumns({"borders": F.coalesce("borders", F.array().cast("array<bigint>")), "ways": F.coalesce("ways", F.lit(0))})
    taken = (F.size("borders") == 1) & (F.col("ways") == 2)
    return whole.where(taken).select("lane_id", F.col("borders")[0].alias("group")), whole.where(~taken).select("lane_id", "group", "borders")


def combine(found: DataFrame, lanes: DataFrame, gap: float = GAP) -> DataFrame:
    """(lane_id, group): connections between the same two or more intersections join; those with fewer borders join if they are near."""
    several = F.size("borders") > 1
    joined = found.where(several).withColumn("group", F.min("group").over(W.partitionBy("borders"))).select("lane_id", "group")
    rest = found.where(~several)
    rings = hulls.group_hulls(rest, lanes)
    border = rest.select("group", "borders").distinct()
    pairs = near_groups(rings, gap)
    for c in ("a", "b"):
        pairs = pairs.join(border.select(F.col("group").alias(c), F.col("borders").alias(f"borders_{c}")), c)
    return joined.union(merged(rest.select("lane_id", "group"), pairs.where("borders_a = borders_b").select("a", "b")))


def centerline_segments(lanes: DataFrame, lane_buffer: float = LANE, overlap: float = OVERLAP) -> DataFrame:
    """(lane_id, segment, kind) for each lane: segment is its smallest lane, kind is junction or no_junction.

    Lanes: lane_id BIGINT, centerline, successor_ids, predecessor_ids. Hulls are convex. Loops write their tables to
    the shared folder, nothing is gathered.
    """
    edges = stage(maps.symmetric(maps.relation_edges(lanes)), "edges")
    known = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(maps.parallel_lanes(lanes))
    members = maps.crossing_groups(maps.intersecting_lanes(lanes, known, lane_buffer))
    members = stage(merged(members, near_groups(hulls.group_hulls(members, lanes), 2 * (overlap + RIM))), "crossings")
    members = stage(members.union(contained(lanes, members, hulls.group_hulls(members, lanes), lane_buffer + RIM)), "crossings")
    taken, rest = connections(lanes, edges, members)
    inside = members.union(taken).withColumn("kind", F.lit("junction"))
    every = inside.unionByName(combine(stage(rest, "connections"), lanes).withColumn("kind", F.lit("no_junction")))
    return every.select("lane_id", F.min("lane_id").over(W.partitionBy("kind", "group")).alias("segment"), "kind")


def segment_table(assigned: DataFrame, lanes: DataFrame) -> DataFrame:
    """(segment, kind, lane_ids, ring, centroid): a row a segment; hulls are convex, centroids of flat hulls are null."""
    rings = hulls.group_hulls(assigned.select("lane_id", F.col("segment").alias("group")), lanes).withColumnRenamed("group", "segment")
    rows = assigned.groupBy("segment", "kind").agg(F.sort_array(F.collect_list("lane_id")).alias("lane_ids"))
    return rows.join(rings, "segment").withColumn("centroid", geometry.ring_centroid(F.col("ring")))


def segments_of(kind: str, lanes: DataFrame) -> DataFrame | None:
    """(lane_id, segment_idx) by the kind of map: 'odr' by roads and junctions, 'centerline' by crossings; None for maps that have no segments.

    RuntimeError if a lane of an OpenDRIVE map lies on no segment.
    """
    if kind == "odr":
        found = maps.lane_segments(maps.road_segments(lanes))
        maps.check_assigned(lanes, found)
        return found
    if kind == "centerline":
        found = centerline_segments(lanes)
        # a row a segment: junctions are numbered first
        numbers = found.select("kind", "segment").distinct().withColumn("segment_idx", F.row_number().over(W.orderBy("kind", "segment")) - 1)
        return found.join(numbers, ["kind", "segment"]).select("lane_id", "segment_idx")
    return None
