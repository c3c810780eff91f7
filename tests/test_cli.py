"""Commands change containers without changing what they hold; projection needs both sides' coordinates."""

import pytest

from roadweft.cli import main
from roadweft.schema import DOUBLES, LONGS
from roadweft.sources.events import tracks_from_events
from roadweft.sources.recordings import Recording, read_recording

DATA = "/root/testdata/sf0.001"
MAP = '<OpenDRIVE><header><geoReference>+proj=utm +zone=32 +datum=WGS84</geoReference><offset x="5" y="6" hdg="0"/></header></OpenDRIVE>'


def rows(r):
    return sorted(map(tuple, r.df.select(*LONGS, *DOUBLES).collect()))


def test_commands(spark, tmp_path):
    (tmp_path / "map.xodr").write_text(MAP)
    r = Recording.of(tracks_from_events(spark, DATA).where("idx < 4").select(*LONGS, *DOUBLES), host_vehicle_idx=2, projections={"proj_string": "+proj=utm +zone=32", None: {"x": 5.0, "y": 6.0}})
    first, second = f"{tmp_path}/a.parquet", f"{tmp_path}/a_with_odr.parquet"
    r.write(first)
    main(["attach-odr", first, f"{tmp_path}/map.xodr"], spark)
    main(["from-osi", second, f"{tmp_path}/b.mcap", "--no-validate"], spark)
    main(["to-parquet", f"{tmp_path}/b.mcap"], spark)
    main(["to-odr", f"{tmp_path}/b.mcap", f"{tmp_path}/out.xodr"], spark)
    back = read_recording(spark, f"{tmp_path}/b.parquet")
    assert back.offsets.count() == back.df.select("total_nanos").distinct().count() and back.lights.count() == 0
    assert rows(back) == rows(r) and back.host_vehicle_idx == 2 and back.map_text == MAP and (tmp_path / "out.xodr").read_text() == MAP
    with pytest.raises(ValueError):
        r.write(f"{tmp_path}/x.txt")


def test_projection(spark, tmp_path):
    r = Recording.of(tracks_from_events(spark, DATA).where("idx < 4").select(*LONGS, *DOUBLES), projections={"proj_string": "+proj=utm +zone=32", None: {"x": 5.0, "y": 6.0}})
    with pytest.raises(ValueError):
        r.projected()
    moved = r.with_map(MAP, "m").projected()
    for a, b in zip(rows(moved), rows(r), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-4)
    assert rows(Recording(moved.df.drop("x", "y").withColumnsRenamed({"x_original": "x", "y_original": "y"}))) == rows(r)
