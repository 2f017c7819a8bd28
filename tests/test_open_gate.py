"""The opening gate: ties at its height, rows in any order, rows without a vehicle or time; numbers rounded as the SQL rounds them."""

import functools
import itertools
import math
import operator
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from fathomline.functions.decimals import rounded_to
from fathomline.operators import clean
from fathomline.plans.registry import ORACLES, QUERIES

NAN, INF = float("nan"), float("inf")
SCHEMA = "vehicle_id bigint, seq bigint, t double, alt double"


def test_baseline_does_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(3)
    alts = [round(400 + rng.uniform(0, 90), 2) for _ in range(6)]
    tie = round(math.fsum(alts) / 6 + 20, 2)
    orders = rng.sample(list(itertools.permutations(alts)), 150)
    rows = [(v, k, float(k) / 10, a) for v, order in enumerate(orders) for k, a in enumerate(order)] + [(v, 9, 60.0, tie) for v in range(150)]
    got = clean.open_gate(spark.createDataFrame(rows, SCHEMA).repartition(7, "seq"), 20.0).where("seq = 9").collect()
    assert len({functools.reduce(operator.add, order) for order in orders}) > 1 and len(got) == 150
    assert {r["baseline"] for r in got} == {math.fsum(alts) / 6}
    assert {r["is_open"] for r in got} == {tie - math.fsum(alts) / 6 > 20}


def test_baselines_of_odd_altitudes(spark):
    groups = [[0.1] * 10, [-0.1, 0.3, -1e-3], [1e300, 1e300], [2.0**30, 1.0], [5e-324, 0.0], [INF, 1.0], [NAN, 1.0], [None, 3.0], [None], [1e9, 0.01, -1e9]]
    rows = [(v, k, 0.0, a) for v, g in enumerate(groups) for k, a in enumerate(g)]
    got = {r["vehicle_id"]: r["baseline"] for r in clean.open_gate(spark.createDataFrame(rows, SCHEMA), 20.0).collect()}
    assert (got[0], got[2], got[3], got[5], got[7], got[8]) == (0.1, 1e300, 2.0**29 + 0.5, INF, 3.0, None)
    assert math.isnan(got[6]) and math.isclose(got[1], 0.199 / 3) and got[4] == 0.0 and math.isclose(got[9], 0.01 / 3, rel_tol=1e-6)


def test_gate_as_its_sql(spark, tmp_path):
    """Rows without a vehicle, a time or a value stay; baselines of 32 rows have seven decimals that end in 5."""
    start = 1704067200000000
    rng = random.Random(8)
    rows = [(v, start + k * 1000, round(rng.uniform(0, 90), 2)) for v in range(60) for k in range(32)] + [(v, start + 6 * 86400 * 10**6 + k, 25.0 * k) for v in range(60) for k in range(5)]
    rows += [(None, start + k * 86400 * 10**6, 30.0 * k) for k in range(9)] + [(70, None, 1.0), (71, None, 1.0), (71, start, 5.0), (72, start, None), (72, start + 10**12, 3.0)]
    users, stamps, values = zip(*rows, strict=True)
    schema = pa.schema({"event_id": pa.int64(), "ts": pa.timestamp("us"), "user_id": pa.int64(), "event_type": pa.string(), "value": pa.float64(), "props": pa.string()})
    events = pa.table([list(range(len(rows))), list(stamps), list(users), ["view"] * len(rows), list(values), ['{"k": 1}'] * len(rows)], schema=schema)
    pq.write_table(events, f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    key = lambda r: r[1]
    columns = "vehicle_id, seq, baseline, is_open, edge"
    want = sorted(con.execute(f"SELECT {columns} FROM ({ORACLES['f7_open_gate']})").fetchall(), key=key)
    got = sorted((tuple(r) for r in QUERIES["f7_open_gate"](spark, str(tmp_path)).select(*columns.split(", ")).collect()), key=key)
    assert len(got) == len(rows)
    # A plain sum of 32 values may end in another last digit; where it is the sum rounded once, all agrees.
    exact = {v: math.fsum(400.0 + x for u, s, x in rows if u == v and s < start + 10**6) / 32 for v in range(60)}
    plain = {v: con.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0] for v, x in exact.items()}
    same = [k for k, w in enumerate(want) if w[0] not in plain or w[2] == plain[w[0]]]
    assert [got[k] for k in same] == [want[k] for k in same] and len({got[k][0] for k in same}) > 30
    assert all(g[2] == plain[g[0]] for g in got if g[0] in plain)


def test_rounded_as_in_the_sql(spark):
    rng = random.Random(4)
    given = [517.1203125, 530.0628125, -517.1203125, 0.5, -0.5, 1e-7, 5e-7, 1e300, 1.7e308, INF, -INF, None]
    given += [x for _ in range(2000) for y in [rng.randrange(40000 * 64, 90000 * 64) / 6400] for x in (y, math.nextafter(y, 0), math.nextafter(y, INF))]
    df = spark.createDataFrame([(x,) for x in given], "x double")
    for digits in (2, 6, 9):
        got = [r[0] for r in df.select(rounded_to(F.col("x"), digits)).collect()]
        numbers = pa.table({"x": given})
        assert got == [r[0] for r in duckdb.sql(f"SELECT round(x, {digits}) FROM numbers").fetchall()]
    assert math.isnan(spark.createDataFrame([(NAN,)], "x double").select(rounded_to(F.col("x"), 6)).first()[0])
