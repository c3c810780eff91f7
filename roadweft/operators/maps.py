"""Lane maps as tables: topology, lengths, segments and lights.

lanes: lane_id, road_id, junction_id, centerline ARRAY<STRUCT<x, y>>, successor_ids, predecessor_ids.
edges: src, dst, label.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from roadweft.functions import geometry
from roadweft.operators.graph import components
from roadweft.operators.joins import cells, edge_join, grid_join, until_found

#: Labels of lane relations; a later one replaces an earlier one for the same pair.
LABELS = ("predecessor", "successor", "right neighbour", "left neighbour")


def relation_edges(lanes: DataFrame) -> DataFrame:
    """Distinct (src, dst, label) of the lists of successors and predecessors."""
    out = [lanes.select(F.col("lane_id").alias("src"), F.explode(f"{label}_ids").alias("dst"), F.lit(label).alias("label")) for label in ("successor", "predecessor")]
    return out[0].union(out[1]).distinct()


def neighbour_edges(lanes: DataFrame, size: float = 25.0) -> DataFrame:
    """(src, dst, label): dst is a neighbour where its polygon covers the whole left_line or right_line of src; borders count as covered."""
    sides = F.array(*(F.struct(F.lit(f"{side} neighbour").alias("label"), F.col(f"{side}_line").alias("line")) for side in ("right", "left")))
    lines = lanes.where("left_line is not null and right_line is not null").select(F.col("lane_id").alias("src"), F.inline(sides)).where("size(line) > 0")
    xs, ys = F.col("polygon.x"), F.col("polygon.y")
    areas = lanes.where("polygon is not null").select(F.col("lane_id").alias("dst"), "polygon", F.array_min(xs).alias("x_min"), F.array_max(xs).alias("x_max"), F.array_min(ys).alias("y_min"), F.array_max(ys).alias("y_max"))
    start = F.element_at("line", 1)
    met = grid_join(lines.withColumns({"x": start["x"], "y": start["y"]}), areas, size).where("src <> dst")
    return met.where(geometry.line_in_ring(F.col("line"), F.col("polygon"))).select("src", "dst", "label").distinct()


def lane_edges(lanes: DataFrame) -> DataFrame:
    """One label for each ordered pair of related lanes; neighbours only where lanes have borders and polygons."""
    edges = relation_edges(lanes)
    if {"polygon", "left_line", "right_line"} <= set(lanes.columns):
        edges = edges.union(neighbour_edges(lanes))
    return single_labels(edges)


def symmetric(edges: DataFrame) -> DataFrame:
    """Each successor also as a predecessor the other way round, and the reverse."""
    other = F.when(F.col("label") == "successor", "predecessor").otherwise("successor")
    both = edges.where(F.col("label").isin("successor", "predecessor"))
    return edges.union(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), other.alias("label"))).distinct()


def single_labels(edges: DataFrame) -> DataFrame:
    """One label for each ordered pair: the last of LABELS that it has."""
    rank = F.array_position(F.array(*map(F.lit, LABELS)), F.col("label"))
    return edges.groupBy("src", "dst").agg(F.max_by("label", rank).alias("label"))


def ends(line: Column) -> tuple[Column, Column]:
    return F.element_at(line, 1), F.element_at(line, -1)


def split_lanes(lanes: DataFrame, most: float) -> DataFrame:
    """(lane_id, part, parts, centerline): lanes longer than most cut into parts of equal length along the line.

    A part is the chord between its ends; a lane that is short enough stays as it is.
    """
    line = F.col("centerline")
    sized = lanes.select("lane_id", line, geometry.line_length(line).alias("size"))
    sized = sized.withColumn("parts", F.greatest(F.ceil(F.col("size") / most), F.lit(1))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    at = lambda i: geometry.point_at(line, F.col("size") * i / F.col("parts"))
    chord = F.array(at(F.col("part")), at(F.col("part") + 1))
    return sized.select("lane_id", "part", "parts", F.when(F.col("parts") > 1, chord).otherwise(line).alias("centerline"))


def split_edges(parts: DataFrame, edges: DataFrame, most: float) -> DataFrame:
    """(src, src_part, dst, dst_part, label): the relations of split lanes, parts as split_lanes gives them.

    Parts of a lane follow each other. A lane's last part leads to the first of its successors, its first part
    comes from the last of its predecessors; links between lines farther apart than most go, either way round.
    """
    last = F.col("part") == F.col("parts") - 1
    following = parts.where(~last).select(F.col("lane_id").alias("src"), F.col("part").alias("src_part"), F.col("lane_id").alias("dst"), (F.col("part") + 1).alias("dst_part"), F.lit("successor").alias("label"))
    before = following.select(F.col("dst").alias("src"), F.col("dst_part").alias("src_part"), F.col("src").alias("dst"), F.col("src_part").alias("dst_part"), F.lit("predecessor").alias("label"))

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(F.col("lane_id").alias(name), F.col("part").alias(f"{name}_part"), F.col("centerline").alias(f"{name}_line"))

    def linked(label: str) -> DataFrame:
        ends, starts = (last, F.col("part") == 0) if label == "successor" else (F.col("part") == 0, last)
        met = edges.where(F.col("label") == label).select("src", "dst").distinct().join(side(parts.where(ends), "src"), "src").join(side(parts.where(starts), "dst"), "dst")
        near = met.where(line_distance(F.col("src_line"), F.col("dst_line")) <= most)
        return near.select("src", "src_part", "dst", "dst_part", F.lit(label).alias("label"))

    return following.union(before).union(linked("successor")).union(linked("predecessor"))


def oriented_borders(lanes: DataFrame) -> DataFrame:
    """lanes with left_line and right_line in the direction of the centre line: a border that has the lane's start in its second half is turned round."""
    def turned(line: Column) -> Column:
        start = F.element_at("centerline", 1)
        share = geometry.let(geometry.project_on_line(start["x"], start["y"], line), lambda p: p["s"]) / geometry.line_length(line)
        return F.when(share > 0.5, F.reverse(line)).otherwise(line)

    return lanes.withColumns({c: turned(F.col(c)) for c in ("left_line", "right_line")})


def border_points(lanes: DataFrame) -> DataFrame:
    """lanes with start_points and end_points: first and last points of the oriented borders, left and then right."""
    lines = [F.col("left_line"), F.col("right_line")]
    return oriented_borders(lanes).withColumns({name: F.array(*(F.element_at(c, i) for c in lines)) for name, i in (("start_points", 1), ("end_points", -1))})


def road_segments(lanes: DataFrame) -> DataFrame:
    """(segment_idx, kind, source, lane_ids): lanes of a junction together, others by road; junctions are numbered first.

    Lanes without a road and a junction lie on no segment: check_assigned finds them.
    """
    lanes = lanes.where("road_id is not null or junction_id is not null and junction_id <> '-1'")
    junction = F.col("junction_id").isNotNull() & (F.col("junction_id") != "-1")
    keyed = lanes.withColumn("kind", F.when(junction, "junction").otherwise("no_junction")).withColumn("source", F.when(junction, F.col("junction_id")).otherwise(F.col("road_id")))
    grouped = keyed.groupBy("kind", "source").agg(F.sort_array(F.collect_list("lane_id")).alias("lane_ids"))
    # a row a segment
    return grouped.withColumn("segment_idx", F.row_number().over(W.orderBy("kind", "source")) - 1)


def lane_segments(segments: DataFrame) -> DataFrame:
    """(lane_id, segment_idx) of segments (segment_idx, lane_ids)."""
    return segments.select(F.explode("lane_ids").alias("lane_id"), "segment_idx")


def unassigned(lanes: DataFrame, lane_segment: DataFrame) -> DataFrame:
    """(lane_id) of lanes on no segment."""
    return lanes.select("lane_id").join(lane_segment.where("segment_idx is not null"), "lane_id", "left_anti")


def check_assigned(lanes: DataFrame, lane_segment: DataFrame, shown: int = 20) -> None:
    """RuntimeError that names some lanes on no segment, if there are any."""
    found = unassigned(lanes, lane_segment).orderBy("lane_id").limit(shown).collect()
    if found:
        raise RuntimeError("not all lanes are assigned to segments: " + ", ".join(str(r["lane_id"]) for r in found))


def segment_by_road(lanes: DataFrame, lane_segment: DataFrame) -> DataFrame:
    """(road_id, segment_idx): the segment that owns a road, by the road's id as text; the last segment where several do."""
    joined = lanes.select("lane_id", F.col("road_id").cast("string").alias("road_id")).join(lane_segment, "lane_id")
    return joined.groupBy("road_id").agg(F.max("segment_idx").alias("segment_idx"))


def with_segment_roads(lanes: DataFrame, lane_segment: DataFrame) -> DataFrame:
    """lanes with their segment as road in their own ids and in those of successors and predecessors.

    Ids are structs with road_id; lanes on no segment keep theirs, and so do references to them.
    """
    kind = lanes.schema["lane_id"].dataType["road_id"].dataType
    renamed = lane_segment.where("segment_idx is not null").select(F.col("lane_id").alias("old"), F.col("segment_idx").cast(kind).alias("road"))
    new = lambda c: F.when(F.col("road").isNull(), c).otherwise(c.withField("road_id", F.col("road")))
    out = lanes.join(renamed, F.col("lane_id") == F.col("old"), "left").withColumn("was", F.col("lane_id")).withColumn("lane_id", new(F.col("lane_id"))).drop("old", "road")
    for c in ("successor_ids", "predecessor_ids"):
        refs = lanes.select(F.col("lane_id").alias("was"), F.posexplode(c).alias("i", "ref")).join(renamed, F.col("ref") == F.col("old"), "left")
        lists = refs.groupBy("was").agg(F.sort_array(F.collect_list(F.struct("i", new(F.col("ref")).alias("ref")))).alias("refs")).select("was", F.col("refs.ref").alias("refs"))
        empty = F.array().cast(lanes.schema[c].dataType)
        out = out.join(lists, "was", "left").withColumn(c, F.coalesce("refs", empty)).drop("refs")
    if "road_id" in lanes.columns:
        out = out.withColumn("road_id", F.col("lane_id.road_id"))
    return out.select(*lanes.columns)


def bounds(lanes: DataFrame) -> DataFrame:
    xs, ys = F.col("centerline.x"), F.col("centerline.y")
    return lanes.withColumns({"x_min": F.array_min(xs), "x_max": F.array_max(xs), "y_min": F.array_min(ys), "y_max": F.array_max(ys)})


def near_pairs(lanes: DataFrame, buffer: float, size: float = 50.0) -> DataFrame:
    """Pairs of lanes whose bounds come within buffer of each other, by grid cells; each pair once, a < b."""
    box = bounds(lanes).withColumns({"x_lo": F.col("x_min") - buffer, "x_hi": F.col("x_max") + buffer, "y_lo": F.col("y_min") - buffer, "y_hi": F.col("y_max") + buffer})
    left = cells(box, size, "x_lo", "x_hi", "y_lo", "y_hi").alias("l")
    right = cells(box, size, "x_min", "x_max", "y_min", "y_max").alias("r")
    on = (F.col("l.cx") == F.col("r.cx")) & (F.col("l.cy") == F.col("r.cy")) & (F.col("l.lane_id") < F.col("r.lane_id"))
    touch = (F.col("l.x_lo") <= F.col("r.x_max")) & (F.col("r.x_min") <= F.col("l.x_hi")) & (F.col("l.y_lo") <= F.col("r.y_max")) & (F.col("r.y_min") <= F.col("l.y_hi"))
    return left.join(right, on).where(touch).select(F.col("l.lane_id").alias("a"), F.col("r.lane_id").alias("b"), F.col("l.centerline").alias("line_a"), F.col("r.centerline").alias("line_b")).dropDuplicates(["a", "b"])


def direction(line: Column) -> Column:
    a, b = ends(line)
    return F.struct((b["x"] - a["x"]).alias("x"), (b["y"] - a["y"]).alias("y"))


def parallel_lanes(lanes: DataFrame, buffer: float = 10.0, degrees: float = 10.0) -> DataFrame:
    """Pairs whose bounds meet within buffer and whose directions, either way, differ by less than the angle."""
    pairs = near_pairs(lanes, buffer).withColumn("u", direction(F.col("line_a"))).withColumn("v", direction(F.col("line_b")))
    dot = F.abs(F.col("u.x") * F.col("v.x") + F.col("u.y") * F.col("v.y"))
    sizes = geometry.norm(F.col("u.x"), F.col("u.y")) * geometry.norm(F.col("v.x"), F.col("v.y"))
    return pairs.where(dot > math.cos(math.radians(degrees)) * sizes).select("a", "b")


def line_distance(a: Column, b: Column) -> Column:
    """Least distance of two lines: 0 if they cross, else from an end of one to the other."""
    def crosses(e: Column, f: Column) -> Column:
        side = lambda p, q, r: (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])
        return (side(e["a"], e["b"], f["a"]) * side(e["a"], e["b"], f["b"]) < 0) & (side(f["a"], f["b"], e["a"]) * side(f["a"], f["b"], e["b"]) < 0)

    crossing = F.exists(geometry.edges(a), lambda e: F.exists(geometry.edges(b), lambda f: crosses(e, f)))
    reach = lambda line, other: F.array_min(F.transform(line, lambda p: geometry.project_on_line(p["x"], p["y"], other)["d"]))
    return F.when(crossing, 0.0).otherwise(F.least(reach(a, b), reach(b, a)))


def intersecting_lanes(lanes: DataFrame, known: DataFrame, buffer: float = 0.3) -> DataFrame:
    """Pairs within buffer of each other that known pairs (a, b: topology, parallels) do not hold."""
    pairs = near_pairs(lanes, buffer).where(line_distance(F.col("line_a"), F.col("line_b")) <= buffer).select("a", "b")
    both = known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.join(both, ["a", "b"], "left_anti")


def crossing_groups(pairs: DataFrame) -> DataFrame:
    """(lane_id, group): components of lane pairs, named by their smallest lane."""
    roots = components(pairs)
    low = roots.groupBy("root").agg(F.min("node").alias("group"))
    return roots.join(low, "root").select(F.col("node").alias("lane_id"), "group")


def approaching(lanes: DataFrame, edges: DataFrame, on_intersection: DataFrame) -> DataFrame:
    """lanes (lane_id) with on_intersection and is_approaching: not on one, but before a lane that is."""
    inside = on_intersection.select("lane_id").distinct()
    before = symmetric(edges).where("label = 'successor'").join(inside.withColumnRenamed("lane_id", "dst"), "dst", "left_semi").select(F.col("src").alias("lane_id")).distinct()
    flag = lambda df, name: df.withColumn(name, F.lit(True))
    out = lanes.select("lane_id").join(flag(inside, "on_intersection"), "lane_id", "left").join(flag(before, "before"), "lane_id", "left")
    on = F.coalesce("on_intersection", F.lit(False))
    return out.select("lane_id", on.alias("on_intersection"), (F.coalesce("before", F.lit(False)) & ~on).alias("is_approaching"))


def nearest_lane(lights: DataFrame, lanes: DataFrame, size: float = 25.0, reach: float = 25.0) -> DataFrame:
    """(light_id, lane_id, distance): each light's nearest lane, however far; the smaller lane on ties. The search begins within reach."""
    shapes = lanes.select("lane_id", F.col("centerline").alias("line"))

    def search(some: DataFrame, within: float) -> DataFrame:
        best = edge_join(some, shapes, within, max(size, within)).groupBy("light_id").agg(F.min(F.struct("d", "lane_id")).alias("b"))
        return best.select("light_id", "b.lane_id", F.col("b.d").alias("distance"))

    return until_found(lights.select("light_id", "x", "y"), bounds(lanes), ["light_id"], search, reach)


def first_states(lights: DataFrame) -> DataFrame:
    """Each light's first state over time."""
    rest = [c for c in lights.columns if c not in ("light_id", "total_nanos")]
    return lights.groupBy("light_id").agg(F.min_by(F.struct("total_nanos", *rest), "total_nanos").alias("s")).select("light_id", "s.*")


def finite_line(line: Column) -> Column:
    """Whether a line has two points at least, all of them finite."""
    ok = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return (F.size(line) >= 2) & F.forall(line, lambda p: ok(p["x"]) & ok(p["y"]))


def centerline_export(lanes: DataFrame) -> DataFrame:
    """Lanes with a finite line, renumbered from 0, with every pair of a predecessor and a successor; nulls where there is none."""
    ok = lanes.where(finite_line(F.col("centerline")))
    numbered = ok.withColumn("out_id", F.row_number().over(W.orderBy("lane_id")) - 1)
    pairs = numbered.select("out_id", F.explode_outer("predecessor_ids").alias("before"), "successor_ids").select("out_id", "before", F.explode_outer("successor_ids").alias("after"))
    ids = numbered.select("lane_id", F.col("out_id").alias("n"))
    for c in ("before", "after"):
        pairs = pairs.join(ids.withColumnRenamed("lane_id", c).withColumnRenamed("n", f"{c}_id"), c, "left").drop(c)
    return pairs


def route(edges: DataFrame, start, goal) -> list | None:
    """Lanes of a shortest way along successors, both ends included; None if there is none.

    Each step asks for the next lanes only: what is gathered are lanes reached, not the map.
    """
    before, front = {start: None}, [start]
    forward = symmetric(edges).where("label = 'successor'").select("src", "dst")
    while front and goal not in before:
        found = forward.where(F.col("src").isin(front)).groupBy("dst").agg(F.min("src").alias("src")).orderBy("dst").collect()
        front = [r["dst"] for r in found if r["dst"] not in before]
        before |= {r["dst"]: r["src"] for r in found if r["dst"] not in before}
    if goal not in before:
        return None
    out = [goal]
    while out[-1] != start:
        out.append(before[out[-1]])
    return out[::-1]
