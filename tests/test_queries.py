"""Each query of the library against its SQL on the smallest tables; those without SQL against plain Python."""

import compare
import numpy as np
import pytest

from kawara import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    assert compare.difference(spark, compare.duck(SF), queries.QUERIES[name], queries.SQL[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_components_by_brute_force(spark):
    got = {r.id: r.comp for r in queries.QUERIES["components_radius"](spark, SF).collect()}
    p = {r.c_custkey: (r.c_custkey * 37 % 20011, r.c_nationkey * 4) for r in spark.read.parquet(f"{SF}/customer.parquet").collect()}
    top = {i: i for i in p}
    changed = True
    while changed:
        changed = False
        for a in p:
            for b in p:
                if np.hypot(p[a][0] - p[b][0], p[a][1] - p[b][1]) <= 4 and top[a] != top[b]:
                    top[a] = top[b] = min(top[a], top[b])
                    changed = True
    assert got == top


def test_geodetic_inverse(spark):
    rows = queries.QUERIES["geodetic_round_trip"](spark, SF).collect()
    assert max(max(abs(r.dlat), abs(r.dlon)) for r in rows) < 1e-8
    # the zone's origin is at 36 N: a degree of latitude is some 110.9 km there
    assert all(-112_000 < r.x < 1_000 for r in rows if r.event_id % 1000 == 833)


def test_spatial_join_plan_has_no_nested_loop(spark):
    from kawara.operators import spatial

    t = queries.Tables(spark, SF)
    found = spatial.points_in_polygons(t.points, t.rings.select("building_id", "ring"), 16.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
