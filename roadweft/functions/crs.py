"""Transverse Mercator and geographic coordinates as column expressions, by Krueger's series to the sixth order."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (semi-major axis, inverse flattening) of ellipsoids, and the series of the projection and its inverse,
# by powers of the third flattening n, from n^j upwards for term j.
ELLIPSOIDS = {"WGS84": (6378137.0, 298.257223563), "GRS80": (6378137.0, 298.257222101), "bessel": (6377397.155, 299.1528128)}
DATUMS = {"WGS84": "WGS84", "NAD83": "GRS80"}
FORWARD = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800), (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360), (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (49561 / 161280, -179 / 168, 6601661 / 7257600), (34729 / 80640, -3418889 / 1995840), (212378941 / 319334400,),
)
INVERSE = (
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800), (1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720), (17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (4397 / 161280, -11 / 504, -830251 / 7257600), (4583 / 161280, -108847 / 3991680), (20648693 / 638668800,),
)


@dataclass(frozen=True)
class Crs:
    """kind longlat (degrees) or tmerc (metres). Ellipsoids are not shifted against each other."""

    kind: str
    ellipsoid: str = "WGS84"
    lon_0: float = 0.0
    lat_0: float = 0.0
    k: float = 1.0
    x_0: float = 0.0
    y_0: float = 0.0

    @classmethod
    def parse(cls, text: str) -> Crs:
        """A +key=value string with +proj=longlat, utm or tmerc, or EPSG:4326, 326zz, 327zz, 258zz; ValueError for others."""
        t = text.strip()
        if t.upper().startswith("EPSG:"):
            code = int(t[5:])
            if code == 4326:
                return cls("longlat")
            family, zone = divmod(code, 100)
            if family in (326, 327, 258) and 1 <= zone <= 60:
                return cls.utm(zone, family == 327, "GRS80" if family == 258 else "WGS84")
            raise ValueError(f"no such coordinate system here: {text}")
        given = dict((p.lstrip("+").split("=", 1) + [""])[:2] for p in t.split())
        name = given.get("ellps") or DATUMS.get(given.get("datum", "WGS84"), "WGS84")
        if name not in ELLIPSOIDS or given.get("units", "m") != "m" or set(given.get("towgs84", "0").split(",")) - {"0", "0.0"}:
            raise ValueError(f"ellipsoid, units or shift not supported: {text}")
        num = lambda k, d: float(given.get(k) or d)
        match given.get("proj"):
            case "longlat" | "latlong":
                return cls("longlat", name)
            case "utm":
                return cls.utm(int(given["zone"]), "south" in given, name)
            case "tmerc":
                return cls("tmerc", name, num("lon_0", 0), num("lat_0", 0), num("k", num("k_0", 1)), num("x_0", 0), num("y_0", 0))
        raise ValueError(f"no such projection here: {text}")

    @classmethod
    def utm(cls, zone: int, south: bool = False, ellipsoid: str = "WGS84") -> Crs:
        return cls("tmerc", ellipsoid, zone * 6.0 - 183.0, 0.0, 0.9996, 500_000.0, 10_000_000.0 if south else 0.0)

    def shape(self) -> tuple[float, float, float, list[float], list[float]]:
        """(rectifying radius, eccentricity, n, forward terms, inverse terms)."""
        a, inverse = ELLIPSOIDS[self.ellipsoid]
        f = 1 / inverse
        n = f / (2 - f)
        terms = lambda table: [sum(c * n ** (j + i + 1) for i, c in enumerate(row)) for j, row in enumerate(table)]
        return a / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256), math.sqrt(f * (2 - f)), n, terms(FORWARD), terms(INVERSE)

    def origin(self) -> float:
        """Rectified latitude of lat_0."""
        _, e, _, forward, _ = self.shape()
        phi = math.radians(self.lat_0)
        tau = math.tan(phi)
        sigma = math.sinh(e * math.atanh(e * math.sin(phi)))
        xi = math.atan(tau * math.sqrt(1 + sigma**2) - sigma * math.sqrt(1 + tau**2))
        return xi + sum(c * math.sin(2 * (j + 1) * xi) for j, c in enumerate(forward))


def _conformal(tau: Column, e: float) -> Column:
    sigma = F.sinh(e * F.atanh(e * tau / F.sqrt(1 + tau * tau)))
    return tau * F.sqrt(1 + sigma * sigma) - sigma * F.sqrt(1 + tau * tau)


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def from_geographic(lon: Column, lat: Column, crs: Crs) -> Column:
    """struct(x, y) of degrees."""
    radius, e, _, forward, _ = crs.shape()

    def plane(p: Column) -> Column:
        xi, eta = p["xi"], p["eta"]
        north = sum((c * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, c in enumerate(forward)), xi)
        east = sum((c * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, c in enumerate(forward)), eta)
        return F.struct((crs.x_0 + crs.k * radius * east).alias("x"), (crs.y_0 + crs.k * radius * (north - crs.origin())).alias("y"))

    def sphere(p: Column) -> Column:
        turn = p["turn"]
        return F.struct(F.atan2(p["tau"], F.cos(turn)).alias("xi"), F.asinh(F.sin(turn) / F.sqrt(p["tau"] * p["tau"] + F.cos(turn) * F.cos(turn))).alias("eta"))

    start = F.struct(_bound(F.tan(F.radians(lat)), lambda t: _conformal(t, e)).alias("tau"), F.radians(lon - crs.lon_0).alias("turn"))
    return _bound(_bound(start, sphere), plane)


def to_geographic(x: Column, y: Column, crs: Crs) -> Column:
    """struct(lon, lat) in degrees."""
    radius, e, _, _, inverse = crs.shape()
    start = F.struct(((y - crs.y_0) / (crs.k * radius) + crs.origin()).alias("xi"), ((x - crs.x_0) / (crs.k * radius)).alias("eta"))

    def sphere(p: Column) -> Column:
        xi, eta = p["xi"], p["eta"]
        north = xi - sum((c * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, c in enumerate(inverse)), F.lit(0.0))
        east = eta - sum((c * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, c in enumerate(inverse)), F.lit(0.0))
        return F.struct(north.alias("xi"), east.alias("eta"))

    def degrees(p: Column) -> Column:
        xi, eta = p["xi"], p["eta"]
        goal = F.sin(xi) / F.sqrt(F.sinh(eta) * F.sinh(eta) + F.cos(xi) * F.cos(xi))

        def newton(tau: Column, _: Column) -> Column:
            at = _conformal(tau, e)
            gain = (1 + (1 - e * e) * tau * tau) / ((1 - e * e) * F.sqrt(1 + at * at) * F.sqrt(1 + tau * tau))
            return tau + (goal - at) * gain

        tau = F.aggregate(F.array(*map(F.lit, range(4))), goal / math.sqrt(1 - e * e), newton)
        return F.struct((F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + crs.lon_0).alias("lon"), F.degrees(F.atan(tau)).alias("lat"))

    return _bound(_bound(start, sphere), degrees)


def transform(x: Column, y: Column, source: Crs, target: Crs) -> Column:
    """struct(x, y) of places between coordinate systems; longlat has longitude in x and latitude in y."""
    if source == target:
        return F.struct(x.alias("x"), y.alias("y"))
    degrees = F.struct(x.alias("lon"), y.alias("lat")) if source.kind == "longlat" else to_geographic(x, y, source)
    if target.kind == "longlat":
        return _bound(degrees, lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    return _bound(degrees, lambda p: from_geographic(p["lon"], p["lat"], target))
