"""Joins on a band of a number and on a grid of cells, as equi joins on bins and an exact test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweft.functions import geometry
from roadweft.plans.staging import stage
from roadweft.schema import recording


def band_join(left: DataFrame, right: DataFrame, column: str, buffer: int, suffix: str, keys: list[str] | None = None) -> DataFrame:
    """Pairs with right - buffer <= left <= right + buffer and equal keys; right's other columns get the suffix.

    Either side is dealt by bins of the buffer's width: left rows go to their bin, right rows to each bin they
    can reach (three at most), so rows of one time span meet without a product of all rows.
    """
    width = max(1, int(buffer))
    keys = keys or []
    other = right.select(*(F.col(c).alias(c if c in keys else f"{c}{suffix}") for c in right.columns))
    key = F.col(f"{column}{suffix}")
    bins = F.sequence(F.floor((key - buffer) / width), F.floor((key + buffer) / width))
    joined = left.withColumn("_bin", F.floor(F.col(column) / width)).join(other.withColumn("_bin", F.explode(bins)), ["_bin", *keys])
    return joined.where((F.col(column) >= key - buffer) & (F.col(column) <= key + buffer)).drop("_bin")


def ego_band(tracks: DataFrame, ego_id: int, buffer: int) -> DataFrame:
    """Rows of others met in time with rows of the ego of their recording."""
    return band_join(tracks.where(F.col("idx") != ego_id), tracks.where(F.col("idx") == ego_id), "total_nanos", buffer, "_ego", recording(tracks))


def cells(df: DataFrame, size: float, x_min, x_max, y_min, y_max) -> DataFrame:
    """A row for each grid cell that a row's bounds touch: cx, cy."""
    spans = [F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)) for a, b in ((x_min, x_max), (y_min, y_max))]
    return df.withColumn("cx", F.explode(spans[0])).withColumn("cy", F.explode(spans[1]))


def grid_join(points: DataFrame, areas: DataFrame, size: float = 25.0) -> DataFrame:
    """Points (x, y) met with areas whose bounds (x_min .. y_max) hold them."""
    dealt = cells(areas, size, "x_min", "x_max", "y_min", "y_max")
    placed = points.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)})
    inside = F.col("x").between(F.col("x_min"), F.col("x_max")) & F.col("y").between(F.col("y_min"), F.col("y_max"))
    return placed.join(dealt, ["cx", "cy"]).where(inside).drop("cx", "cy")


def edge_join(points: DataFrame, shapes: DataFrame, reach: float, size: float = 25.0) -> DataFrame:
    """Points (x, y) met with the edges of shapes within reach: the points' columns, those of shapes but its line, and distance d.

    A row for each edge of a line that is near enough; lines are taken apart once, before points meet them.
    """
    rest = [c for c in shapes.columns if c != "line"]
    e = shapes.select(*rest, F.explode(geometry.edges(F.col("line"))).alias("e"))
    e = e.select(*rest, F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), (F.col("e.b.x") - F.col("e.a.x")).alias("ex"), (F.col("e.b.y") - F.col("e.a.y")).alias("ey"))
    low = lambda c: F.col(f"a{c}") + F.least(F.lit(0.0), F.col(f"e{c}")) - reach
    high = lambda c: F.col(f"a{c}") + F.greatest(F.lit(0.0), F.col(f"e{c}")) + reach
    areas = e.withColumns({"x_min": low("x"), "x_max": high("x"), "y_min": low("y"), "y_max": high("y")})
    met = grid_join(points, areas, size).withColumn("d", geometry.edge_distance(*(F.col(c) for c in ("x", "y", "ax", "ay", "ex", "ey"))))
    return met.where(F.col("d") <= reach).select(*points.columns, *rest, "d")


def until_found(points: DataFrame, areas: DataFrame, key: list[str], search, reach: float) -> DataFrame:
    """search(points, reach), again with twice the reach for the points that it leaves out, until each is found.

    areas have bounds (x_min .. y_max). Nothing is farther than the span of points and areas together, where the
    search ends. Points without finite coordinates are found nowhere.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    todo = points.where(finite("x") & finite("y"))
    out = stage(search(todo, reach), "joins-found")
    rest, last = out, None
    while True:
        todo = stage(todo.join(rest.select(*key).distinct(), key, "left_anti"), "joins-left")
        if todo.isEmpty():
            return out
        if last is None:
            spans = [d.agg(*(f(c).cast("double") for f, c in zip((F.min, F.max, F.min, F.max), names, strict=True))).first() for d, names in ((todo, "xxyy"), (areas, ("x_min", "x_max", "y_min", "y_max")))]
            if spans[1][0] is None:
                return out
            last = 2 * sum(max(a[i + 1], b[i + 1]) - min(a[i], b[i]) for a, b in [spans] for i in (0, 2)) + reach
        if reach >= last:
            return out
        reach *= 2
        rest = stage(search(todo, reach), "joins-found")
        out = out.unionByName(rest)
