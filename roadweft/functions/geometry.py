"""Plane geometry as column expressions: no Python runs on executors."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def wrap(angle: Column) -> Column:
    """The angle in [-pi, pi)."""
    return F.pmod(angle + math.pi, F.lit(2 * math.pi)) - math.pi


def divide(a: Column, b: Column) -> Column:
    """IEEE division: infinities and NaN where b is 0."""
    by_zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a == 0, float("nan"))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def box_ring(x: Column, y: Column, length: Column, width: Column, yaw: Column) -> Column:
    """Closed ring of an oriented box: front left, front right, rear right, rear left, front left."""
    def corner(u: float, v: float) -> Column:
        a, b = length * u, width * v
        return F.struct((x + a * F.cos(yaw) - b * F.sin(yaw)).alias("x"), (y + a * F.sin(yaw) + b * F.cos(yaw)).alias("y"))

    return F.array(*(corner(u, v) for u, v in ((0.5, 0.5), (0.5, -0.5), (-0.5, -0.5), (-0.5, 0.5), (0.5, 0.5))))


def boxes_meet(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two oriented boxes share a point, by separating axes; a cheap circle test goes first."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    reach = norm(a["length"], a["width"]) / 2 + norm(b["length"], b["width"]) / 2
    out = dx * dx + dy * dy <= reach * reach + 1e-9
    for box in (a, b):
        for turn in (0, 1):
            c, s = (F.cos(box["yaw"]), F.sin(box["yaw"])) if not turn else (-F.sin(box["yaw"]), F.cos(box["yaw"]))
            extent = None
            for other in (a, b):
                along = F.abs(F.cos(other["yaw"]) * c + F.sin(other["yaw"]) * s) * other["length"] / 2
                across = F.abs(-F.sin(other["yaw"]) * c + F.cos(other["yaw"]) * s) * other["width"] / 2
                extent = along + across if extent is None else extent + along + across
            out = out & (F.abs(dx * c + dy * s) <= extent)
    return out


def edges(ring: Column) -> Column:
    """Edges (a, b) of a ring or line of points."""
    return F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def point_in_ring(x: Column, y: Column, ring: Column, border: bool = True) -> Column:
    """Whether a closed ring holds a point; whether points on its border count is said by border."""
    def on(e: Column) -> Column:
        cross = (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (x - e["a"]["x"])
        between = x.between(F.least(e["a"]["x"], e["b"]["x"]), F.greatest(e["a"]["x"], e["b"]["x"])) & y.between(F.least(e["a"]["y"], e["b"]["y"]), F.greatest(e["a"]["y"], e["b"]["y"]))
        return (cross == 0) & between

    def crosses(e: Column) -> Column:
        spans = (e["a"]["y"] > y) != (e["b"]["y"] > y)
        at = e["a"]["x"] + F.try_divide((y - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]), e["b"]["y"] - e["a"]["y"])
        return F.coalesce(spans & (x < at), F.lit(False))

    inside = F.size(F.filter(edges(ring), crosses)) % 2 == 1
    return F.exists(edges(ring), on) | inside if border else inside & ~F.exists(edges(ring), on)


def line_in_ring(line: Column, ring: Column) -> Column:
    """Whether a closed ring covers a whole line: its points, the middles between the places where it meets the ring's points, and no crossing."""
    cross = lambda o, a, b: (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])

    def crosses(e: Column, f: Column) -> Column:
        return (cross(e["a"], e["b"], f["a"]) * cross(e["a"], e["b"], f["b"]) < 0) & (cross(f["a"], f["b"], e["a"]) * cross(f["a"], f["b"], e["b"]) < 0)

    def share(e: Column, p: Column) -> Column:
        ex, ey = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        return F.coalesce(F.try_divide((p["x"] - e["a"]["x"]) * ex + (p["y"] - e["a"]["y"]) * ey, ex * ex + ey * ey), F.lit(0.0))

    def middles(e: Column) -> Column:
        """Middles of the pieces into which the ring's points that lie on an edge cut it."""
        on = F.filter(ring, lambda p: (cross(e["a"], e["b"], p) == 0) & share(e, p).between(0.0, 1.0))
        cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.transform(on, lambda p: share(e, p)))))
        return F.zip_with(F.slice(cuts, 1, F.size(cuts) - 1), F.slice(cuts, 2, F.size(cuts) - 1), lambda u, v: _between(e["a"], e["b"], (u + v) / 2))

    covered = lambda p: point_in_ring(p["x"], p["y"], ring)
    return F.forall(line, covered) & ~F.exists(edges(line), lambda e: F.exists(edges(ring), lambda f: crosses(e, f))) & F.forall(F.flatten(F.transform(edges(line), middles)), covered)


def ring_area(ring: Column) -> Column:
    """Signed area of a closed ring; positive if it runs counter-clockwise."""
    return F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2)


def ring_centroid(ring: Column) -> Column:
    area = ring_area(ring)
    part = lambda c: F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + (e["a"][c] + e["b"][c]) * (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))
    return F.struct(F.try_divide(part("x"), 6 * area).alias("x"), F.try_divide(part("y"), 6 * area).alias("y"))


def line_length(line: Column) -> Column:
    return F.aggregate(edges(line), F.lit(0.0), lambda s, e: s + norm(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]))


def project_on_line(x: Column, y: Column, line: Column) -> Column:
    """(distance, s, t) of a point on a line: s along it, t across it, negative on the left. The first nearest segment counts."""
    # a step for each value that is used more than once: lambdas work out what they hold anew each time
    steps = F.transform(edges(line), lambda e: F.struct((e["b"]["x"] - e["a"]["x"]).alias("ex"), (e["b"]["y"] - e["a"]["y"]).alias("ey"), (x - e["a"]["x"]).alias("px"), (y - e["a"]["y"]).alias("py")))
    steps = F.transform(steps, lambda e: F.struct(e["ex"].alias("ex"), e["ey"].alias("ey"), e["px"].alias("px"), e["py"].alias("py"), norm(e["ex"], e["ey"]).alias("size"), _share(e["px"] * e["ex"] + e["py"] * e["ey"], e["ex"] * e["ex"] + e["ey"] * e["ey"]).alias("u")))
    steps = F.transform(steps, lambda e: F.struct(norm(e["px"] - e["u"] * e["ex"], e["py"] - e["u"] * e["ey"]).alias("d"), (e["u"] * e["size"]).alias("s"), (e["ex"] * e["py"] - e["ey"] * e["px"] > 0).alias("left"), e["size"].alias("size")))
    start = F.struct(F.lit(0.0).alias("at"), *(F.lit(None).cast(k).alias(n) for n, k in (("d", "double"), ("s", "double"), ("left", "boolean"))))

    def nearer(acc: Column, e: Column) -> Column:
        best = F.when(acc["d"].isNull() | (e["d"] < acc["d"]), F.struct(e["d"].alias("d"), (acc["at"] + e["s"]).alias("s"), e["left"].alias("left"))).otherwise(F.struct(acc["d"].alias("d"), acc["s"].alias("s"), acc["left"].alias("left")))
        return F.struct((acc["at"] + e["size"]).alias("at"), best["d"].alias("d"), best["s"].alias("s"), best["left"].alias("left"))

    def place(acc: Column) -> Column:
        return F.when(acc["d"].isNotNull(), F.struct(acc["d"].alias("d"), acc["s"].alias("s"), F.when(acc["left"], -acc["d"]).otherwise(acc["d"]).alias("t")))

    return F.aggregate(steps, start, nearer, place)


def _share(dot: Column, square: Column) -> Column:
    """dot / square cut to 0 .. 1; 0 for an edge without length."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(dot, square), F.lit(0.0))))


def edge_distance(x: Column, y: Column, ax: Column, ay: Column, ex: Column, ey: Column) -> Column:
    """The distance of a point from the edge that leads by (ex, ey) from (ax, ay); no lambdas, so it is compiled."""
    u = _share((x - ax) * ex + (y - ay) * ey, ex * ex + ey * ey)
    return norm(x - ax - u * ex, y - ay - u * ey)


def _between(a: Column, b: Column, u: Column) -> Column:
    return F.struct((a["x"] + u * (b["x"] - a["x"])).alias("x"), (a["y"] + u * (b["y"] - a["y"])).alias("y"))


def extended(line: Column, by: float) -> Column:
    """The line made longer by the same length at both ends, in the direction of its first and last steps.

    A line without two different points becomes a vertical stub of 2 m around its first point; an empty one is null.
    """
    def ends(line: Column) -> Column:
        first, last = F.element_at(line, 1), F.element_at(line, -1)
        second = F.get(F.filter(line, lambda p: (p["x"] != first["x"]) | (p["y"] != first["y"])), 0)
        before = F.try_element_at(F.filter(line, lambda p: (p["x"] != last["x"]) | (p["y"] != last["y"])), F.lit(-1))
        return F.struct(first.alias("first"), second.alias("second"), before.alias("before"), last.alias("last"))

    def beyond(end: Column, inner: Column) -> Column:
        return let(-F.lit(by) / norm(inner["x"] - end["x"], inner["y"] - end["y"]), lambda u: _between(end, inner, u))

    def longer(line: Column, e: Column) -> Column:
        stub = F.array(*(F.struct(e["first"]["x"].alias("x"), (e["first"]["y"] + d).alias("y")) for d in (-1.0, 1.0)))
        return F.when(e["second"].isNull(), stub).otherwise(F.concat(F.array(beyond(e["first"], e["second"])), line, F.array(beyond(e["last"], e["before"]))))

    return let(F.when(F.size(line) > 0, line), lambda l: F.when(l.isNotNull(), let(ends(l), lambda e: longer(l, e))))


def lengths(line: Column) -> Column:
    """Lengths along a line at its points; the first is 0."""
    return F.aggregate(edges(line), F.array(F.lit(0.0)), lambda acc, e: F.concat(acc, F.array(F.element_at(acc, -1) + norm(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]))))


def point_at(line: Column, s: Column) -> Column:
    """The point at s along a line; its ends where s lies beyond them."""
    start = F.struct(F.lit(0.0).alias("s"), F.element_at(line, 1).alias("p"))

    def step(acc: Column, e: Column) -> Column:
        size = norm(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])
        u = F.least(F.lit(1.0), F.coalesce(F.try_divide(s - acc["s"], size), F.lit(1.0)))
        return F.struct((acc["s"] + size).alias("s"), F.when(s >= acc["s"], _between(e["a"], e["b"], F.greatest(F.lit(0.0), u))).otherwise(acc["p"]).alias("p"))

    return F.aggregate(edges(line), start, step, lambda acc: acc["p"])


def middle_line(left: Column, right: Column) -> Column:
    """The line halfway between two borders, with a point at every share of length where either has one."""
    shares = lambda line: F.transform(lengths(line), lambda s: F.coalesce(F.try_divide(s, line_length(line)), F.lit(0.0)))
    places = F.array_sort(F.array_distinct(F.concat(shares(left), shares(right))))
    return F.transform(places, lambda u: _between(point_at(left, u * line_length(left)), point_at(right, u * line_length(right)), F.lit(0.5)))
