"""Maps and coordinates: queries equal their SQL, known values, and plan-view elements against fine sums."""

import xml.etree.ElementTree as ET
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweft.functions import crs
from roadweft.operators.hulls import hull_of
from roadweft.plans import map_queries, segmentation
from roadweft.sources import opendrive
from tests.test_catalogue import DATA, plain


@pytest.mark.parametrize("name", sorted(map_queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    want = con.execute(map_queries.ORACLE_SQL[name])
    expected = plain(want.fetchall(), [d[0] for d in want.description])
    df = map_queries.QUERIES[name](spark, DATA)
    assert plain(df.collect(), df.columns) == expected


def test_meridian_arc(spark):
    x, y = spark.range(1).select(crs.transform(F.lit(9.0), F.lit(45.0), crs.Crs.parse("EPSG:4326"), crs.Crs.parse("+proj=utm +zone=32 +datum=WGS84")).alias("p")).first()["p"]
    assert abs(x - 500_000) < 1e-6 and abs(y - 0.9996 * 4984944.378) < 1e-3
    for text in ("+proj=lcc", "EPSG:3857", "+proj=utm +zone=32 +ellps=clrk66"):
        with pytest.raises(ValueError):
            crs.Crs.parse(text)


@pytest.mark.parametrize("shape", ['<spiral curvStart="0" curvEnd="0.05"/>', '<arc curvature="-0.02"/>', '<poly3 a="0" b="0" c="0.002" d="0.00001"/>',
                                   '<paramPoly3 pRange="arcLength" aU="0" bU="1" cU="0" dU="0" aV="0" bV="0" cV="0.001" dV="0"/>'])
def test_heading_follows_the_line(shape):
    g = ET.fromstring(f'<geometry s="0" x="0" y="0" hdg="0" length="40">{shape}</geometry>')
    ds = np.linspace(0, 40, 4001)
    u, v, turn = opendrive.local_places(g, ds)
    assert np.allclose(np.arctan2(np.diff(v), np.diff(u)), (turn[1:] + turn[:-1]) / 2, atol=1e-4)
    if "param" not in shape:
        assert np.allclose(np.hypot(np.diff(u), np.diff(v)), 0.01, atol=1e-4)


MAP = """<OpenDRIVE><road id="a" length="2" junction="-1"><link><successor elementType="junction" elementId="7"/></link><planView><geometry s="0" x="0" y="0" hdg="0" length="2"><line/></geometry></planView>
<lanes><laneSection s="0"><right><lane id="-1" type="bus"><link><successor id="-1"/></link><width sOffset="0" a="2" b="0" c="0" d="0"/></lane><lane id="-2" type="odd"/></right></laneSection>
<laneSection s="1.5"><right><lane id="-1" type="odd"><link><predecessor id="-1"/></link><width sOffset="0" a="2" b="0" c="0" d="0"/></lane></right></laneSection></lanes></road>
<road id="b" length="1" junction="7"><planView><geometry s="0" x="2" y="0" hdg="0" length="1"><line/></geometry></planView>
<lanes><laneSection s="0"><left><lane id="1"><border sOffset="0" a="3" b="0" c="0" d="0"/></lane></left></laneSection></lanes></road>
<junction id="7"><connection id="0" incomingRoad="a" connectingRoad="b" contactPoint="start"><laneLink from="-1" to="1"/></connection></junction></OpenDRIVE>"""


def test_links_sections_and_odd_maps(spark):
    maps = spark.createDataFrame([("m", MAP), ("empty", ""), ("null", None)], "map_name string, text string")
    lanes = opendrive.with_polygon(opendrive.in_driving_direction(opendrive.parse_maps(maps, 1.0)))
    got = {tuple(r["lane_id"]): r for r in lanes.collect()}
    assert set(got) == {("a", -1, 0), ("a", -1, 1), ("b", 1, 0)}
    assert [p.x for p in got["a", -1, 0]["centerline"]] == [0.0, 1.0, 1.5] and got["a", -1, 0]["type"] == "DRIVING" and got["a", -1, 1]["type"] == "UNKNOWN"
    assert [tuple(i) for i in got["a", -1, 0]["successor_ids"]] == [("a", -1, 1)] and [tuple(i) for i in got["a", -1, 1]["successor_ids"]] == [("b", 1, 0)]
    assert [p.x for p in got["b", 1, 0]["left_line"]] == [3.0, 2.0] and got["b", 1, 0]["left_line"][0].y == 3.0 and len(got["b", 1, 0]["polygon"]) == 5


def test_hull():
    rng = np.random.default_rng(1)
    points = list(map(tuple, rng.integers(0, 9, (40, 2)).astype(float).tolist()))
    ring = hull_of(points)
    assert ring[0] == ring[-1] and set(ring) <= set(points)
    for (ax, ay), (bx, by) in zip(ring[:-1], ring[1:], strict=True):
        assert all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0 for x, y in points)
    assert hull_of([]) == [] and hull_of([(1.0, 2.0)] * 3) == [(1.0, 2.0)] * 2 and hull_of([(0.0, 0.0), (2.0, 2.0), (1.0, 1.0)]) == [(0.0, 0.0), (2.0, 2.0), (0.0, 0.0)]


def test_near_connections_join(spark):
    line = lambda y: [(0.0, y), (10.0, y)]
    schema = "lane_id long, centerline array<struct<x:double,y:double>>, successor_ids array<long>, predecessor_ids array<long>"
    lanes = spark.createDataFrame([(1, line(0.0), [], []), (2, line(4.0), [], []), (3, line(30.0), [4], []), (4, [(10.0, 30.0), (20.0, 30.0)], [], [3])], schema)
    assert {tuple(r) for r in segmentation.centerline_segments(lanes).collect()} == {(1, 1, "no_junction"), (2, 1, "no_junction"), (3, 3, "no_junction"), (4, 3, "no_junction")}
    assert segmentation.centerline_segments(lanes.limit(0)).count() == 0
