"""Convex hulls of lanes and distances between rings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadweft.functions import geometry
from roadweft.operators.maps import line_distance

RING = T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in "xy"]))


def hull_of(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Closed convex ring, counter-clockwise from the leftmost point. One or two distinct points give a flat ring."""
    points = sorted(set(points))
    if not points:
        return []

    def half(order) -> list:
        out: list = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out

    return half(points)[:-1] + half(points[::-1])[:-1] + points[:1] if len(points) > 1 else points * 2


@F.pandas_udf(RING)
def hull(lines: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Convex hull of an array of points."""
    for batch in lines:
        yield pd.Series([[dict(x=x, y=y) for x, y in hull_of([(p["x"], p["y"]) for p in line])] if line is not None else None for line in batch])


def group_hulls(members: DataFrame, lanes: DataFrame) -> DataFrame:
    """(group, ring): hulls of the lanes of each group. Lanes give their own hulls first, so a group gathers corners only."""
    own = lanes.select("lane_id", hull("centerline").alias("ring"))
    points = members.join(own, "lane_id").groupBy("group").agg(F.flatten(F.collect_list("ring")).alias("points"))
    return points.select("group", hull("points").alias("ring"))


def ring_distance(a: Column, b: Column) -> Column:
    """Distance of two rings; 0 where one holds a point of the other."""
    holds = lambda r, q: geometry.point_in_ring(F.element_at(q, 1)["x"], F.element_at(q, 1)["y"], r)
    return F.when(holds(a, b) | holds(b, a), 0.0).otherwise(line_distance(a, b))


def point_ring_distance(x: Column, y: Column, ring: Column) -> Column:
    return F.when(geometry.point_in_ring(x, y, ring), 0.0).otherwise(geometry.project_on_line(x, y, ring)["d"])


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """The points (n, 2) that Douglas and Peucker's way keeps: those farther than tolerance from the chord of their stretch, and both ends."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    stack = [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        step, rest = points[b] - points[a], points[a + 1 : b] - points[a]
        square = float(step @ step)
        u = np.clip(rest @ step / square, 0, 1) if square else np.zeros(len(rest))
        far = np.hypot(*(rest - u[:, None] * step).T)
        i = int(far.argmax())
        if far[i] > tolerance:
            keep[a + 1 + i] = True
            stack += [(a, a + 1 + i), (a + 1 + i, b)]
    return points[keep]


def simplify(line: Column, tolerance: float = 0.1) -> Column:
    """A line of points with fewer of them; lines of two points and fewer, and null, stay as they are."""

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def run(lines: pd.Series) -> pd.Series:
        def one(line):
            if line is None or len(line) < 3:
                return line
            found = simplified(np.array([(p["x"], p["y"]) for p in line], float), tolerance)
            return [{"x": x, "y": y} for x, y in found.tolist()]

        return lines.map(one)

    return run(line)
