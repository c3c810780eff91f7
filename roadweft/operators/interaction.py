"""Metrics between an ego object and the others, and the manager that orders metrics by what they need."""

from __future__ import annotations

import graphlib
import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweft.functions import geometry
from roadweft.operators import tracks as T
from roadweft.operators.joins import ego_band
from roadweft.schema import recording

Result = tuple[DataFrame, dict[str, DataFrame]]


@dataclass(frozen=True)
class Metric:
    """A function of (df, ...) to (df, properties), with what it needs and makes."""

    compute: Callable[..., Result]
    computes_columns: tuple[str, ...] = ()
    computes_intermediate_columns: tuple[str, ...] = ()
    requires_columns: tuple[str, ...] = ()
    computes_properties: tuple[str, ...] = ()
    computes_intermediate_properties: tuple[str, ...] = ()
    requires_properties: tuple[str, ...] = ()
    parameters: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        names = list(inspect.signature(self.compute).parameters)
        if not names or names[0] != "df":
            raise AssertionError("a metric's first parameter is df")
        if missing := set(self.requires_properties) - set(names):
            raise AssertionError(f"needed properties are no parameters: {sorted(missing)}")
        object.__setattr__(self, "parameters", tuple(names[1:]))

    @property
    def name(self) -> str:
        return self.compute.__name__

    @property
    def makes(self) -> tuple[str, ...]:
        return (*self.computes_columns, *self.computes_intermediate_columns, *self.computes_properties, *self.computes_intermediate_properties)

    def __call__(self, df: DataFrame, **kw) -> Result:
        try:
            inspect.signature(self.compute).bind(df, **kw)
        except TypeError as error:
            raise TypeError(f"Missing parameter for metric {self.name}: {error}") from error
        df, properties = self.compute(df, **kw)
        lacking = [p for p in (*self.computes_properties, *self.computes_intermediate_properties) if p not in properties] + [c for c in (*self.computes_columns, *self.computes_intermediate_columns) if c not in df.columns]
        if lacking:
            raise AssertionError(f"metric {self.name} did not make {lacking}")
        return df, properties


def metric(**kw) -> Callable[[Callable[..., Result]], Metric]:
    """Decorator that makes a Metric of a function."""
    return lambda f: Metric(f, **{k: tuple(v) for k, v in kw.items()})


@metric(computes_columns=["distance_traveled"])
def distance_traveled(df):
    return T.distance_traveled(df), {}


@metric(computes_columns=["vel"])
def vel(df):
    return df.withColumn("vel", geometry.norm(F.col("vel_x"), F.col("vel_y"))), {}


BOX = ("x", "y", "length", "width", "yaw")


@metric(requires_columns=["distance_traveled", "vel"], computes_properties=["timegaps", "min_timegaps"], computes_intermediate_properties=["crossed"])
def observed_timegaps(df, ego_id, time_buffer=2_000_000_000):
    """Time between the ego and others at places where both have been, within time_buffer."""
    key = [*recording(df), "idx_ego", "idx"]
    crossed = ego_band(df, ego_id, int(time_buffer))
    sides = [{c: F.col(c + end) for c in BOX} for end in ("", "_ego")]
    met = crossed.where(geometry.boxes_meet(*sides)).withColumn("timegap", (F.col("total_nanos") - F.col("total_nanos_ego")) / 1e9)
    row = ("timegap", "total_nanos", "distance_traveled", "distance_traveled_ego")
    best = F.min_by(F.struct(*row), F.struct(F.abs("timegap"), "total_nanos"))
    timegaps = met.groupBy(*key, "total_nanos_ego").agg(best.alias("b")).select(*key, "total_nanos_ego", *(F.col(f"b.{c}").alias(c) for c in row))
    least = timegaps.groupBy(*key).agg(F.min_by("timegap", F.struct(F.abs("timegap"), "total_nanos_ego")).alias("min_timegap"))
    return df, {"timegaps": timegaps, "min_timegaps": least, "crossed": crossed}


@metric(requires_columns=["distance_traveled", "vel"], requires_properties=["crossed", "timegaps"], computes_properties=["p_timegaps", "min_p_timegaps"])
def predicted_timegaps(df, ego_id, crossed, timegaps, time_buffer=2_000_000_000):
    """The gap that holds if both keep their speed along the paths they will have taken.

    The least gap's column keeps the name p_timegap. Speeds of 0 give infinite or undefined gaps, which come last.
    """
    key = [*recording(df), "idx_ego", "idx"]
    over = timegaps.select(*key, *(F.col(c).alias(f"{c}_overlap") for c in ("total_nanos", "total_nanos_ego", "distance_traveled", "distance_traveled_ego")))
    both = crossed.join(over, key)

    def to_overlap(end: str):
        t, t_over = F.col(f"total_nanos{end}"), F.col(f"total_nanos{end}_overlap")
        left = F.col(f"distance_traveled{end}_overlap") - F.col(f"distance_traveled{end}")
        return F.when(t >= t_over, (t_over - t) / 1e9).otherwise(geometry.divide(left, F.col(f"vel{end}")))

    gap = -(to_overlap("_ego") - to_overlap("") + (F.col("total_nanos_ego") - F.col("total_nanos")) / 1e9)
    both = both.withColumn("p_timegap", gap)
    best = F.min_by(F.struct("p_timegap", "total_nanos"), F.struct(F.abs("p_timegap"), "total_nanos"))
    p = both.where("p_timegap is not null").groupBy(*key, "total_nanos_ego").agg(best.alias("b")).select(*key, "total_nanos_ego", "b.p_timegap", "b.total_nanos")
    least = p.groupBy(*key).agg(F.min_by("p_timegap", F.struct(F.abs("p_timegap"), "total_nanos_ego")).alias("p_timegap"))
    return df, {"p_timegaps": p, "min_p_timegaps": least}


DEFAULT = (distance_traveled, vel, observed_timegaps, predicted_timegaps)


class MetricManager:
    """Orders metrics, passes parameters and properties on, and drops what is excluded.

    Intermediate properties and columns are left out of the result. Later metrics replace earlier makers of a name. A need
    that nobody meets raises RuntimeError; a cycle raises graphlib.CycleError.
    """

    def __init__(self, metrics=DEFAULT, exclude_columns=(), exclude_properties=()):
        self.metrics = list(metrics)
        self.exclude_columns, self.exclude_properties = tuple(exclude_columns), tuple(exclude_properties)
        maker = {name: m for m in self.metrics for name in m.makes}
        needs = {m.name: {*m.requires_columns, *m.requires_properties} for m in self.metrics}
        if open_ := {n for x in needs.values() for n in x} - set(maker):
            raise RuntimeError(f"no metric makes {sorted(open_)}")
        order = graphlib.TopologicalSorter({m: {maker[n].name for n in x} for m, x in needs.items()}).static_order()
        by_name = {m.name: m for m in self.metrics}
        self.order = [by_name[n] for n in order]

    def __repr__(self) -> str:
        return f"MetricManager({' -> '.join(m.name for m in self.order)})"

    def compute(self, df: DataFrame, **kw) -> Result:
        """Lazy frames; only those that an action reads are run. Parameters that no metric names are ignored."""
        properties: dict[str, DataFrame] = {}
        for m in self.order:
            known = {k: v for k, v in {**kw, **properties}.items() if k in m.parameters}
            df, made = m(df, **known)
            properties |= made
        hidden = {*self.exclude_properties, *(p for m in self.metrics for p in m.computes_intermediate_properties)}
        between = [c for m in self.metrics for c in m.computes_intermediate_columns]
        return df.drop(*self.exclude_columns, *between), {k: v for k, v in properties.items() if k not in hidden}
