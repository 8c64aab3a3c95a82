"""Every registered plan against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from voxelframe.operators import points
from voxelframe.plans import ORACLE, QUERIES, views

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = got.collect()
    if name not in ORACLE:
        assert len(set(got.columns)) == len(got.columns)
        return
    want = duck.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda r: tuple((x is None, str(type(x)), x) for x in r)
    a = sorted((tuple(plain(r[c]) for c in names) for r in rows), key=key)
    b = sorted((tuple(plain(x) for x in r) for r in want.fetchall()), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (isinstance(p, float) and q is not None and math.isclose(p, q, rel_tol=1e-9, abs_tol=1.1e-6)) for p, q in zip(x, y, strict=True)), (x, y)


def cells_of(spark, *columns):
    return {tuple(r) for r in views.cells(spark, SF).select(*columns).distinct().collect()}


def apart(p, q):
    return sum((a - b) ** 2 for a, b in zip(p, q, strict=True))


def test_touching_removal_of_all_points(spark):
    at = sorted(cells_of(spark, "y", "x", "z"))  # in the order of the plan's ids
    gone, found = set(), set(at)
    for y, x, z in at:
        ball = [q for b in range(-2, 3) for a in range(-2, 3) for c in range(-2, 3) if a * a + b * b + c * c <= 4 and (q := (y + a, x + b, z + c)) in found]
        gone |= set(ball) - {min(ball)}
    got = {tuple(r) for r in QUERIES["touching_removal"](spark, SF).collect()}
    assert gone and got == found - gone


def test_nearest_neighbour_of_all_points(spark):
    asks, others = ({p[1:] for p in cells_of(spark, "class", "y", "x", "z") if p[0] == c} for c in (1, 2))
    number = lambda p: p[0] + (p[1] - 1) * 50 + (p[2] - 1) * 550
    got = {r["id"]: (r["other"], r["distance"]) for r in QUERIES["nearest_neighbour"](spark, SF).collect()}
    assert set(got) == {number(p) for p in asks}
    for p in asks:
        d2, other = min((apart(p, q), number(q)) for q in others)
        assert got[number(p)] == (other, round(math.sqrt(d2), 6))


def test_nearest_any_reaches_far_points(spark):
    at = spark.createDataFrame([(1, 0, 0, 0), (2, 900, 0, 0)], "id bigint, y int, x int, z int")
    there = spark.createDataFrame([(7, 1, 0, 0), (8, 500, 0, 0)], "id bigint, y int, x int, z int")
    assert {tuple(r) for r in points.nearest_any(at, there, 2.0).collect()} == {(1, 7, 1.0), (2, 8, 400.0)}
    assert points.nearest_any(at, there.limit(0), 2.0).count() == 0


def test_patches_of_all_points(spark):
    asked = {p for p in cells_of(spark, "class", "y", "x", "z") if 3 <= p[1] <= 48 and 3 <= p[2] <= 9}
    assert QUERIES["patch_features"](spark, SF).count() == len(asked)


def test_asof_nearest_of_all_slices(spark):
    sf = SF.replace("0.001", "0.01")  # tiles of more than 400 slices
    known: dict[str, list] = {}
    asked = [tuple(r) for r in views.series(spark, sf).select("tile", "z", "value").collect()]
    for tile, z, value in asked:
        if value is not None:
            known.setdefault(tile, []).append((z, value))
    got = {(r["tile"], r["z"]): r["filled"] for r in QUERIES["asof_nearest"](spark, sf).collect()}
    assert max(z for _, z in got) > 400 and len(got) == len(asked)
    for tile, z, _ in asked:
        assert got[tile, z] == min(known[tile], key=lambda k: (abs(k[0] - z), k[0]))[1]


def test_steady_translation(spark):
    from statistics import median

    rows = [tuple(r) for r in views.series(spark, SF).select("tile", "z", "value").collect()]
    want = {}
    for tile in {r[0] for r in rows}:
        accepted = []
        for _, z, v in sorted((r for r in rows if r[0] == tile), key=lambda r: r[1]):
            if v is not None and (not accepted or abs(float(v) - median(accepted)) <= 60):
                accepted.append(float(v))
            want[tile, z] = accepted[-1] if accepted else None
    got = {(r["tile"], r["z"]): plain(r["steady"]) for r in QUERIES["steady_translation"](spark, SF).collect()}
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_reach_the_scan(spark):
    plan = QUERIES["box_query"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "l_extendedprice" not in plan
