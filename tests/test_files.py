"""Files in and out."""

import pytest

from fathomline.operators import sinks
from fathomline.sources import files, options


def test_points(spark, tmp_path):
    (tmp_path / "p.csv").write_text("stamp,longitude,lat,ok\n2,109.0,34.0,1\n1,nan,34.0,1\n3, 109.5 ,34.5,0\n4,,34,1\n")
    cols = {"t": ("fix_stamp_sec", "stamp"), "lon": ("lon", "longitude"), "lat": ("lat",)}
    assert sorted(r["t"] for r in files.csv_points(spark, str(tmp_path / "p.csv"), cols).collect()) == [2.0, 3.0]
    assert [r["t"] for r in files.csv_points(spark, str(tmp_path / "p.csv"), cols, available="ok").collect()] == [2.0]
    with pytest.raises(Exception, match="missing or infinite"):
        files.csv_points(spark, str(tmp_path / "p.csv"), cols, strict=True).collect()
    with pytest.raises(ValueError):
        files.csv_points(spark, str(tmp_path / "p.csv"), {"x": ("none",)})


def test_report_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, None)], "frame int, total_count double, other double")
    sinks.report(df, "frame").select("value").coalesce(1).write.text(str(tmp_path / "r"))
    (tmp_path / "x.txt").write_text("a = 1\nb=x=y\nno mark\na=2\ninlier_count=3\ntotal_count=4\n")
    got = files.reports(spark, str(tmp_path / "x.txt"))
    assert got.first()["values"] == {"a": "2", "b": "x=y", "inlier_count": "3", "total_count": "4"}
    assert files.report_numbers(got, ["a", "inlier_rate", "none"]).first()[1:] == (2.0, 0.75, None)
    assert files.reports(spark, str(tmp_path / "r")).first()["values"]["other"] == "nan"


def test_world_file_and_lists(spark, tmp_path):
    (tmp_path / "w.tfw").write_text("0.5\n0\n0\n-0.5\n100.25\n200.75\n")
    assert files.world_file(spark, str(tmp_path / "w.tfw")) == (100.0, 0.5, 0.0, 201.0, 0.0, -0.5)
    assert files.thresholds("10, 3,10") == [3.0, 10.0]


def test_options(tmp_path):
    (tmp_path / "o.yaml").write_text("%YAML:1.0\ntuning:\n  min_speed_mps: 0.5  # slow\n  kf_visual_adaptive_enable: 0\ninput:\n  map_path: 'maps/a.tif'\n  fusion_anchor_min_used_points: 20\n")
    got = options.load(str(tmp_path / "o.yaml"))
    assert (got.min_speed_mps, got.kf_visual_adaptive_enable, got.fusion_anchor_min_used_points) == (0.5, False, 20)
    assert got.map_path == str(tmp_path / "maps/a.tif") and options.load(str(tmp_path / "none")) == options.Options()


def test_sinks(spark):
    df = spark.createDataFrame([(1, 1.23456, float("nan")), (2, None, 2.0)], "i int, x double, y double")
    assert [tuple(r) for r in sinks.csv_table(df, {"x": 3, "y": 1}).orderBy("i").collect()] == [(1, "1.235", "nan"), (2, "nan", "2.0")]
    assert sinks.json_rows(df).orderBy("value").first()["value"] == '{"i":1,"x":1.23456,"y":null}'
    assert sinks.summary(df, ["x", "y"]).first()[:] == (2, 1.23456, 2.0)
