"""Camera and run files as rows."""

import pytest

from fathomline.sources import calibration

MATRIX = """Transformation (cam0):
T_ci:  (imu0 to cam0):
[[1 0 0 9]
 [0 1 0 9]
 [0 0 1 9]
 [0 0 0 1]]

T_ic:  (cam0 to imu0):
[[-0.5 0.25   1e-3  0.125]
 [ 0.  1, 0, -2.5]

 no bracket 1 2 3 4
 [ short 1 ]
 [ 3 4 5 6 ]
 [ 0 0 0 1 ]]

timeshift cam0 to imu0:

0.0007 s
"""
YAML = "cam1:\n  intrinsics: [9, 9, 9, 9]\ncam0:\n  intrinsics: [400.5, 401,\n    320, 240.25]\n  distortion_coeffs:\n  - 0.1\n  - -0.2\n  - 3e-3\n  - 0\n  resolution: [640, 480]\n"
RUN = "input:\n  image0: a.png   # one\n  image1: 'b.png'\nmodel:\n  superpoint: s\n  lightglue: l\noutput:\n  matches: out/m.png\n  warp: w.png\n  sp1_kpts: out.d/k\nruntime:\n  H: 512\n  max_draw: -3\n  homography_max_pairs: 4\nmatching:\n  ratio: 1.0\n  max_keep: some\n"


def rows(spark, tmp_path, read, *files, **more):
    for k, text in enumerate(files):
        (tmp_path / f"f{k}.txt").write_bytes(text.encode())
    return [r.asDict() for r in sorted(read(spark, str(tmp_path), **more).collect(), key=lambda r: r["file"])]


def test_extrinsics(spark, tmp_path):
    got = rows(spark, tmp_path, calibration.read_extrinsics, MATRIX, MATRIX.replace("\n", "\r\n"), "\n", MATRIX.replace("[ 3 4 5 6 ]", ""), MATRIX.split("timeshift")[0], MATRIX.replace("0.0007 s", "none"), MATRIX.replace("cam0", "cam1"))
    assert got[0]["rotation"] == [-0.5, 0.25, 1e-3, 0.0, 1.0, 0.0, 3.0, 4.0, 5.0] and got[0]["translation"] == [0.125, -2.5, 6.0] and got[0]["shift"] == 0.0007
    assert {k: v for k, v in got[1].items() if k != "file"} == {k: v for k, v in got[0].items() if k != "file"}
    assert [r["reason"] for r in got] == [None, None, "T_ic_missing", "T_ic_incomplete", "timeshift_missing", "timeshift_incomplete", "T_ic_missing"]
    assert all(r["rotation"] is None and r["shift"] is None for r in got if r["reason"])


def test_intrinsics(spark, tmp_path):
    flat = "intrinsics: [1, 2, 3, 4]\ndistortion_coeffs: [5, 6, 7, 8, 9]\n"
    got = rows(spark, tmp_path, calibration.read_intrinsics, YAML, flat, "\n", "intrinsics: [1, 2, 3, 4]\n", "cam0:\n  intrinsics: [1]\n" + flat.replace("intrinsics", "  intrinsics", 1))
    assert (got[0]["fx"], got[0]["cy"], got[0]["distortion"], got[0]["width"], got[0]["height"]) == (400.5, 240.25, [0.1, -0.2, 0.003, 0.0], 640, 480)
    assert (got[1]["fx"], got[1]["distortion"], got[1]["width"], got[1]["reason"]) == (1.0, [5.0, 6.0, 7.0, 8.0], 0, None)
    assert [r["reason"] for r in got[2:4]] == ["intrinsics_missing", "distortion_coeffs_missing"]


def test_runs(spark, tmp_path):
    bad = [RUN.replace("model:", "models:"), RUN.replace("image1: 'b.png'", ""), RUN.replace("H: 512", "H: 0"), RUN + "feature:\n  method: orb\n", RUN + "  method: bf\n  distance: hamming\n", "\n"]
    got = rows(spark, tmp_path, calibration.read_runs, RUN, *bad)
    values = got[0]["values"]
    want = {
        "input.image1": "b.png", "input.dem_tif": "a.png", "output.warp": "w.png", "output.matches_inlier": "out/m_inliers.png", "output.map2d_csv": "out/m_map2d.csv",
        "output.pnp_report": "out/m_pnp.txt", "output.undistort": "out.d/k_undistort", "runtime.max_draw": "200", "runtime.homography_max_pairs": "4", "matching.ratio": "0.8",
        "matching.max_keep": "3000", "feature.max_features": "4000", "runtime.H": "512",
    }
    assert {k: values.get(k) for k in want} == want and got[0]["reason"] is None
    assert [r["reason"] for r in got[1:]] == ["section_missing", "input.image1_missing", "size_not_positive", "lightglue_needs_superpoint", "float_needs_l2", "section_missing"]


@pytest.mark.parametrize(("names", "want"), [(("sift", "bf", "auto"), None), (("orb", "bf", "l2"), "binary_needs_hamming"), (("fast", "bf", "auto"), None), ((None, None, None), None)])
def test_combinations(spark, names, want):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([names], "a string, b string, c string")
    assert df.select(calibration.combination_reason(F.col("a"), F.col("b"), F.col("c")).alias("r")).first()["r"] == want
