"""Composite evaluation queries against plain Python."""

import pytest

from fathomline.operators import evaluate
from fathomline.plans.registry import QUERIES
from fathomline.plans.q_tracks import samples
from fathomline.operators.clean import _sphere_metres

SF = "/root/testdata/sf0.001"


def test_cleaning_as_plain_python(spark):
    tracks = {}
    for r in samples(spark, SF, "view").collect():
        tracks.setdefault(r["vehicle_id"], []).append((r["t"], r["seq"], r["lon"], r["lat"], r["alt"]))
    want = {}
    for v, rows in tracks.items():
        rows.sort()
        good = []
        for r in rows:
            if not good or _sphere_metres(r[2], r[3], good[-1][2], good[-1][3]) <= 500.0:
                good.append(r)
        for r in rows:
            before, after = [g for g in good if g <= r], [g for g in good if g >= r]
            at = r[2:]
            if r not in good:
                a, b = (before or after)[-1 if before else 0], (after or before)[0 if after else -1]
                part = (r[0] - a[0]) / (b[0] - a[0]) if b[0] > a[0] else 0.0
                at = [x + part * (y - x) for x, y in zip(a[2:], b[2:], strict=True)]
            want[v, r[1]] = (r in good, *at)
    got = {(r["vehicle_id"], r["seq"]): r for r in QUERIES["e12_gnss_cleaning"](spark, SF).collect()}
    assert got.keys() == want.keys()
    for k, (accepted, *at) in want.items():
        assert got[k]["accepted"] == accepted
        assert [float(got[k][f]) for f in ("lon", "lat", "alt")] == pytest.approx(at, abs=2e-6)
        assert len(got[k]["lon"].split(".")[1]) == 10


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([], (0, 0, 0, None, "no_visual_update")),
        ([("visual_reject_nis", 3), ("imu_predict", 2)], (5, 0, 3, 100.0, "all_gates_failed")),
        ([("visual_update", 1), ("visual_reject_nis", 3), (None, 4)], (8, 1, 3, 75.0, "usable")),
    ],
)
def test_verdict(spark, rows, want):
    assert tuple(evaluate.verdict(spark.createDataFrame(rows, "source string, n bigint")).first()) == want
