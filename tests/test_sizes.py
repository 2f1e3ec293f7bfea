"""Operators on shapes of tables that broke them: by brute force, and by their plans."""

import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kawara import queries
from kawara.operators import graph, grouped, kernels, mesh, modeling, spatial, texture

SF = "/root/testdata/sf0.001"
RING = "array<struct<x:double,y:double,z:double>>"


def labels_by_hand(p, eps, least):
    near = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2)) <= eps
    core = near.sum(1) >= least
    label = -np.ones(len(p), int)
    for i in range(len(p)):
        if core[i] and label[i] < 0:
            todo, label[i] = [i], i
            while todo:
                for v in np.flatnonzero(near[todo.pop()] & core):
                    if label[v] < 0:
                        label[v] = i
                        todo.append(v)
    for i in np.flatnonzero(~core):
        own = label[near[i] & core]
        label[i] = own.min() if len(own) else -1
    return {i: int(c) for i, c in enumerate(label) if c >= 0}


def plan_of(rows):
    return rows._jdf.queryExecution().toString()


@pytest.mark.parametrize("axes, least", [("xy", 4), ("xyz", 5), ("xy", 1)])
def test_dbscan_over_tiles(spark, monkeypatch, axes, least):
    monkeypatch.setattr(graph, "TILE", 3)
    rng = np.random.default_rng(7)
    thick = [rng.normal(c, 0.35, (150, len(axes))) for c in (-3.0, 0.0, 1.6)]
    p = np.round(np.concatenate([rng.uniform(-5, 5, (500, len(axes))), *thick]), 2)
    points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, " + ", ".join(f"{k} double" for k in axes))
    points = points.unionByName(points.limit(1).select(F.lit(10**6).alias("id"), *(F.lit(None).cast("double").alias(k) for k in axes)))
    got = {r.id: r.cluster for r in graph.dbscan(points, 0.5, least, 1, axes).collect()}
    assert got == labels_by_hand(p, 0.5, least)


def test_blocks_keep_groups_whole(monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 40)
    keys = np.sort(np.concatenate([np.arange(30), np.full(150, 12), np.random.default_rng(0).integers(0, 30, 90)]))
    rows = pa.Table.from_pydict({"a": keys // 7, "b": keys % 7})
    blocks = [b.to_pandas() for b in graph._blocks(iter(rows.to_batches(max_chunksize=9)), ["a", "b"])]
    assert (np.concatenate([b.a * 7 + b.b for b in blocks]) == keys).all() and len(blocks) > 2
    assert sum(len(b[["a", "b"]].drop_duplicates()) for b in blocks) == 30


def test_dbscan_copies_few_points(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(graph, "_cut", lambda rows: seen.append(plan_of(rows)) or rows.localCheckpoint())
    rows = spark.range(1000).select("id", *((F.col("id") * k % 97 / 3).alias(a) for k, a in ((7, "x"), (11, "y"), (13, "z"))))
    graph.dbscan(rows, 0.5, 5, 20, "xyz").count()
    # points were exploded over the 125 cells around each before
    assert not any("o_cx" in plan for plan in seen)


def test_full_cells_make_no_pairs():
    n = 30_000
    p = np.random.default_rng(1).uniform(0, 0.3, (n, 2))
    p[n // 2 :, 0] += 0.75
    ids, label, core, own, _ = kernels.tiles_clustered(np.arange(n), p, np.zeros((n, 2), np.int64), 32.0, 1.001, 0.5, 5)
    assert core.all() and own.all() and len(ids) == n
    assert set(label) == {0} or set(label) == {0, n // 2}
    close = np.sqrt(((p[: n // 2, None][::50] - p[None, n // 2 :]) ** 2).sum(2)).min() <= 0.5
    assert not close or set(label) == {0}


def box_faces(spark, n):
    return queries.Tables(spark, SF).boxes.where(f"mesh_id < {n}")


def test_open_edges_join_nothing(spark):
    faces = box_faces(spark, 60).withColumn("mesh_id", F.col("mesh_id") % 7)
    found = mesh.open_edges(faces)
    # its sides are exploded, and so larger than what Spark expects before it broadcasts one
    assert "Join" not in plan_of(found)
    left = Counter()
    edges = mesh.face_edges(faces).collect()
    for e in sorted(edges, key=lambda e: (e.mesh_id, e.face_id, e.idx)):
        left[e.mesh_id, e.p, e.q] += 1
    want = Counter({(m, *(tuple(round(x * 1000) for x in v) for v in (p, q))): n - left[m, q, p] for (m, p, q), n in left.items() if n > left[m, q, p]})
    assert Counter((r.mesh_id, *(tuple(map(int, v.split("_"))) for v in (r.a, r.b))) for r in found.collect()) == want


def test_closing_broadcasts_nothing(spark):
    plan = mesh.closed(box_faces(spark, 60))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_split_edges_broadcasts_nothing(spark):
    plan = queries.QUERIES["split_edges"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_rings_clipped_together():
    rng = np.random.default_rng(5)
    for n in (3, 4, 6, 9):
        rings = np.concatenate([np.round(rng.uniform(0, 4, (60, n, 3))), rng.uniform(0, 4, (60, n, 3))])
        turns = np.sort(rng.uniform(0, 2 * np.pi, (60, n)), 1)
        stars = np.stack([np.cos(turns), np.sin(turns), turns * 0], 2) * rng.uniform(0.3, 2, (60, n, 1))
        rings = np.concatenate([rings, stars, stars[:, ::-1]])
        assert (kernels.triangles_of_all(rings) == np.array([kernels.triangles(r) for r in rings])).all()


def test_crossing_faces_broadcast_nothing(spark, monkeypatch):
    # each face was clipped alone before
    monkeypatch.setattr(kernels, "ear_clipped", None)
    found = queries.QUERIES["crossing_faces"](spark, SF)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_nearest_of_crowded_places(spark):
    rng = np.random.default_rng(4)
    # thousands of rows in few places, a crowd in one cell, and rows far from all of it
    right = np.concatenate([np.repeat(rng.integers(0, 4, (8, 2)) * 30.0, 400, 0), np.round(rng.uniform(0, 2, (500, 2)), 3)])
    left = np.concatenate([rng.uniform(0, 100, (200, 2)), rng.uniform(0, 2, (100, 2)), [(5000.0, -900.0)]])
    frame = lambda p, i: spark.createDataFrame([(k % 2, k, *map(float, v)) for k, v in enumerate(p)], f"k long, {i} long, x double, y double")
    l, r = frame(left, "l"), frame(right, "r")  # noqa: E741
    lost = l.limit(1).select("k", F.lit(-1).cast("long").alias("l"), F.lit(None).cast("double").alias("x"), "y")
    lost = lost.unionByName(lost.select("k", F.lit(-2).cast("long").alias("l"), F.lit(float("nan")).alias("x"), "y"))
    got = {x.l: (x.r, x.distance) for x in spatial.nearest(l.unionByName(lost), r, "l", "r", 160.0, ("k",)).collect()}
    for k, v in enumerate(left):
        own = np.arange(k % 2, len(right), 2)
        gap = np.sqrt(((right[own] - v) ** 2).sum(1))
        assert got[k] == (own[gap.argmin()], pytest.approx(gap.min(), rel=1e-12))
    assert len(got) == len(left)
    assert spatial.nearest(l, r.limit(0), "l", "r", 1.0, ("k",)).count() == 0


def test_nearest_meets_few_rows_of_a_place(spark, monkeypatch):
    seen = []
    own = spatial.within_radius
    monkeypatch.setattr(spatial, "within_radius", lambda *a: seen.append(own(*a)) or seen[-1])
    rows = spark.range(3000).select(F.col("id").alias("r"), (F.col("id") % 5).cast("double").alias("x"), F.lit(0.0).alias("y"))
    spatial.nearest(rows.select(F.col("r").alias("l"), "x", "y"), rows, "l", "r", 160.0).count()
    assert seen[0].count() == 3000 * 5


def test_packing_on_rows_of_bits():
    rng = np.random.default_rng(8)
    for most in (8, 16, 32):
        for _ in range(40):
            n = int(rng.integers(1, 60))
            rects = [(str(b), int(w), int(h)) for b, w, h in zip(rng.integers(0, n // 3 + 1, n), rng.integers(1, most // 2 + 2, n), rng.integers(1, most // 3 + 2, n), strict=True)]
            # a rectangle without area, last and alone, has all of them packed by plain comparisons
            assert kernels.bottom_left_packed(rects, most) == kernels.bottom_left_packed([*rects, ("none", 1, 0)], most)[:-1]


def test_packing_of_many():
    k = np.arange(0, 120_000, 20)
    rects = list(zip((k % 97).astype(str), (k * 7 % 50 + 1).tolist(), (k * 7 % 17 + 1).tolist(), strict=True))
    start = time.process_time()
    places = kernels.bottom_left_packed(rects, 256)
    # an atlas of 6,000 such took 34 s before
    assert time.process_time() - start < 20
    taken = np.zeros((max(p[0] for p in places) + 1, 256, 256), int)
    for (_, w, h), (page, x, y) in zip(rects, places, strict=True):
        taken[page, y : y + h, x : x + w] += 1
    assert taken.max() == 1 and taken.sum() == sum(w * h for _, w, h in rects)


def test_components_of_crowded_places(spark, monkeypatch):
    rng = np.random.default_rng(6)
    p = np.concatenate([np.round(rng.uniform(0, 6, (150, 2)), 2), np.repeat(np.round(rng.uniform(0, 6, (4, 2)), 2), 500, 0)])
    rng.shuffle(p)
    points = spark.createDataFrame([*((i, *map(float, v)) for i, v in enumerate(p)), (-1, None, 0.0), (-2, None, 0.0)], "id long, x double, y double")
    # pairs of points in one place were all made before
    monkeypatch.setattr(spatial, "within_radius", None)
    got = {r.id: r.comp for r in graph.radius_components(points, 0.3).collect()}
    assert got == labels_by_hand(p, 0.3, 1) | {-1: -1, -2: -2}
    monkeypatch.setattr(spatial, "MOST", 3)
    assert {r.id: r.comp for r in graph.radius_components(points, 0.3).collect()} == got


def test_crowded_corners_are_welded(spark):
    rows = [(i, i % 3 * 0.05 + i % 2 * 9.0, 0.0, float(i % 4 * (i % 4))) for i in range(1200)]
    got = {r.id: (r.x, r.z) for r in modeling.welded_corners(spark.createDataFrame(rows, "id long, x double, y double, z double"), 0.1, 1.0).collect()}
    # heights of a stack: 0 and 4 on even ones, 1 and 9 on odd ones
    assert got == {i: (rows[i % 2][1], z) for i, _, _, z in rows}


@pytest.mark.parametrize("most", [10_000, 3])
def test_welding_looks_at_places_and_heights(spark, monkeypatch, most):
    monkeypatch.setattr(spatial, "MOST", most)
    rng = np.random.default_rng(10)
    p = np.column_stack([np.round(rng.uniform(-4, 4, (60, 2)), 2), rng.integers(0, 12, 60) * 0.75])
    p = p[rng.integers(0, 60, 900)]
    z = [None if i % 50 == 0 else float(v) for i, v in enumerate(p[:, 2])]
    rows = [(i, *map(float, p[i, :2]), z[i]) for i in range(900)] + [(-1, None, 0.0, 7.0), (-2, 0.0, float("nan"), None)]
    corners = spark.createDataFrame(rows, "id long, x double, y double, z double").repartition(3)
    seen, gap_clusters = [], graph.gap_clusters
    monkeypatch.setattr(graph, "gap_clusters", lambda r, *a: seen.append(r.count()) or gap_clusters(r, *a))
    got = {r.id: (r.x, r.y, r.z) for r in modeling.welded_corners(corners, 0.5, 1.0).collect()}
    stack, want, heights = labels_by_hand(p[:, :2], 0.5, 1), {-1: rows[-2][1:]}, 0
    for s in set(stack.values()):
        mine = sorted((-1.0 if z[i] is None else z[i], i) for i in stack if stack[i] == s)
        heights += len({h for h, _ in mine})
        levels = [[]]
        for (h, i), (before, _) in zip(mine, [mine[0], *mine], strict=False):
            # a corner without a height is on the lowest level
            levels += [[]] if h - before > 1 and before >= 0 else []
            levels[-1].append((h, i))
        for level in levels:
            want |= {i: (*rows[s][1:3], max(h for h, _ in level) if max(level)[0] >= 0 else None) for _, i in level}
    (x, y, h), ids = got.pop(-2), set(got)
    assert x == 0.0 and np.isnan(y) and h is None
    # each of the rows went through the windows before
    assert got == want and len(ids) == 901 and seen == [heights] and heights < 500


def test_few_places_need_no_rounds(spark, monkeypatch):
    rng = np.random.default_rng(11)
    p = np.round(rng.uniform(-40, 40, (400, 2)), 1)
    points = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "id long, x double, y double")
    far = points.unionByName(spark.createDataFrame([(10**6, 1e15, 0.0)], points.schema))
    want = labels_by_hand(p, 3.0, 1)
    assert {r.id: r.comp for r in graph.radius_components(far, 3.0).collect()} == want | {10**6: 10**6}
    assert graph.radius_components(points.limit(0), 3.0).count() == 0
    # labels went round by round through tables before, however few
    monkeypatch.setattr(graph, "connected", None)
    assert {r.id: r.comp for r in graph.radius_components(points, 3.0).collect()} == want


def test_roof_of_wall_of_equal_faces(spark):
    rng = np.random.default_rng(9)
    faces = [(i, "ROOF" if i % 3 == 0 else "WALL", [tuple(map(float, v)) for v in rng.integers(0, 2 + i % 2, (3 + i % 2, 3))]) for i in range(60)]
    faces += [(i + 100, e, ring[::-1]) for i, e, ring in faces]
    rows = [(i, e, *p) for i, e, ring in faces for p in ring]
    got = {r.wall: r.roof for r in texture.roof_of_wall(spark.createDataFrame(rows, "face_id long, element string, x double, y double, z double")).collect()}
    want = {}
    for i, e, ring in faces:
        found = [(max(p[2] for p in r), -j) for j, f, r in faces if f == "ROOF" and sum(p == q for p in ring for q in r) > 1]
        if e == "WALL" and found:
            want[i] = -max(found)[1]
    assert got == want and len(got) > 40


def test_equal_walls_are_compared_once(spark, monkeypatch):
    seen = []
    cut = texture._cut
    monkeypatch.setattr(texture, "_cut", lambda rows: seen.append(cut(rows)) or seen[-1])
    rows = spark.range(400).select("id", F.when(F.col("id") % 2 == 0, "ROOF").otherwise("WALL").alias("element"), F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("x"))
    found = texture.roof_of_wall(rows.select(F.col("id").alias("face_id"), "element", "x", F.lit(0.0).alias("y"), F.lit(0.0).alias("z")))
    assert {r.roof for r in found.collect()} == {0} and found.count() == 200 and [s.count() for s in seen] == [1, 1]


def test_roofs_are_cut_together(spark):
    rng = np.random.default_rng(2)
    for n in (3, 4, 6, 7):
        turns = np.sort(rng.uniform(0, 2 * np.pi, (40, n)), 1)
        rings = np.stack([np.cos(turns), np.sin(turns), rng.uniform(0, 2, turns.shape)], 2) * rng.uniform(0.3, 2, (40, n, 1))
        rings = np.concatenate([rings, rng.integers(0, 4, (40, n, 3)).astype(float)])
        found = kernels.triangulated_3d_all(rings)
        assert [tuple(map(int, t)) for t in found] == [(k, *t) for k, r in enumerate(rings) for t in kernels.triangulated_3d(r)]
    plan = queries.QUERIES["roof_triangles"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_roof_triangles_one_at_a_time_no_more(spark, monkeypatch):
    rows = queries.Tables(spark, SF).quads.unionByName(queries.Tables(spark, SF).dents)
    want = Counter((r.mesh_id, r.face_id, len(r.ring)) for r in rows.collect() for _ in range(len(r.ring) - 2))
    left = rows.withColumn("ring", F.when(F.col("face_id") % 5 == 0, F.slice("ring", 1, 2)).otherwise(F.col("ring")))
    got = grouped.roofs_triangulated(left.withColumn("mesh_id", F.col("mesh_id") + F.size("ring") * 1000))
    got = Counter((r.mesh_id % 1000, r.face_id, r.mesh_id // 1000) for r in got.collect())
    assert got == Counter({k: n for k, n in want.items() if k[1] % 5})


def test_nearest_vectors_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(11)
    v = rng.normal(0, 1, (900, 5)).astype(np.float32)
    v[100:500] = v[7]  # one very common vector
    v[600:700] = v[3] + np.float32(1e-7) * rng.integers(0, 2, (100, 5)).astype(np.float32)
    rows = [(int(i), list(map(float, x))) for i, x in zip(rng.permutation(900), v, strict=True)]
    frame = spark.createDataFrame([*rows, (5000, None), (5001, [1.0, None, 0.0, 0.0, 0.0]), (5002, [0.0])], "vec_id long, embedding array<float>")
    asked = frame.where("vec_id % 20 = 0 AND vec_id < 900").select(F.col("vec_id").alias("query_id"), "embedding")
    monkeypatch.setattr(spatial, "BLOCKS", 1)
    found = spatial.nearest_vectors(asked, frame.repartition(3), 5)
    # each pair's distance was summed by Spark before
    assert "lambdafunction" not in plan_of(found)
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in found.collect())
    want = []
    at = {i: np.array(x) for i, x in rows}
    for q in range(0, 900, 20):
        order = sorted((float(np.sqrt(sum((at[q] - x) ** 2))), i) for i, x in at.items())
        want += [(q, n + 1, i) for n, (_, i) in enumerate(order[:5])]
    assert got == want


def test_relations_of_boxes_and_others(spark, monkeypatch):
    rng = np.random.default_rng(13)
    at, size = rng.integers(0, 25, (80, 2)), rng.integers(1, 9, (80, 2))
    rings = []
    for i, ((x, y), (w, h)) in enumerate(zip(at.tolist(), size.tolist(), strict=True)):
        r = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
        # as it is, another way round, and with a corner more; a bow tie is no box
        r = (r, r[::-1], [*r[:1], (x + w / 2, y), *r[1:]])[i % 3]
        rings.append((i % 2, i, [{"x": float(a), "y": float(b)} for a, b in r[1:] + r[:1]]))
    frame = spark.createDataFrame(rings, "k long, id long, ring array<struct<x:double,y:double>>")
    kernel = kernels.overlap_area
    mixed = sorted(map(tuple, modeling.polygon_relations(frame, 8.0, ("k",)).collect()))
    monkeypatch.setattr(modeling, "_is_box", lambda ring: F.lit(False))
    assert mixed == sorted(map(tuple, modeling.polygon_relations(frame, 8.0, ("k",)).collect())) and len(mixed) > 300
    assert kernel([(0, 0), (2, 0), (2, 2), (0, 2)], [(1, 1), (3, 1), (3, 3), (1, 3)]) == pytest.approx(1)
    monkeypatch.undo()
    shapes = [([(0, 0), (1, 0), (1, 1), (0, 1)], True), ([(0, 0), (1, 1), (1, 0), (0, 1)], False), ([(0, 0), (1, 0), (1, 1), (1, 1)], False), ([(0, 0), (1, 0), (1, 1)], False), ([(0, 0), (2, 0), (2, 0), (0, 0)], False)]
    rows = spark.createDataFrame([(i, [{"x": float(a), "y": float(b)} for a, b in r]) for i, (r, _) in enumerate(shapes)], "i long, ring array<struct<x:double,y:double>>")
    assert [bool(r[0]) for r in rows.orderBy("i").select(modeling._is_box(F.col("ring"))).collect()] == [w for _, w in shapes]


@pytest.mark.parametrize("share", [0.5, 0.9])
def test_boxes_held(spark, monkeypatch, share):
    rng = np.random.default_rng(17)
    at, size = rng.integers(-20, 20, (300, 2)) * 0.5, rng.integers(1, 20, (300, 2)) * 0.5
    rows = [(i % 2, i, *map(float, p), *map(float, p + s)) for i, (p, s) in enumerate(zip(at, size, strict=True))]
    boxes = spark.createDataFrame([*rows, (0, 900, 1.0, 1.0, 1.0, 4.0)], "k long, id long, x0 double, y0 double, x1 double, y1 double")
    pairs = spatial.box_relations(boxes.where("id < 900"), 8.0, ("k",), share).where("relation = 'CONTAINING'")
    want = {(r.k, r.b) for r in pairs.collect()}
    assert {tuple(r) for r in spatial.boxes_held(boxes, 8.0, ("k",), share).collect()} == want and 50 < len(want) < 300
    # all related pairs were made before
    monkeypatch.setattr(spatial, "box_relations", None)
    assert queries.QUERIES["ground_clusters"](spark, SF).count() == 200


def test_box_pairs_meet_once(spark):
    rng = np.random.default_rng(19)
    at, size = rng.integers(-40, 40, (300, 2)) * 0.5, rng.integers(1, 30, (300, 2)) * 0.5
    rows = [(i % 2, i, *map(float, p), *map(float, p + s)) for i, (p, s) in enumerate(zip(at, size, strict=True))]
    found = spatial.box_pairs(spark.createDataFrame(rows, "k long, id long, x0 double, y0 double, x1 double, y1 double"), 8.0, ("k",))
    # its sides were broadcast by their size before boxes were copied to their cells
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, found.collect()))
    assert got == sorted((p[0], p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and p[1] < q[1] and p[2] < q[4] and q[2] < p[4] and p[3] < q[5] and q[3] < p[5])


def test_box_relations_meet_once(spark):
    rng = np.random.default_rng(23)
    at, size = rng.integers(-20, 20, (120, 2)) * 0.25, rng.integers(1, 20, (120, 2)) * 0.25
    rows = [(i, *map(float, p), *map(float, p + s)) for i, (p, s) in enumerate(zip(at, size, strict=True))]
    found = spatial.box_relations(spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double"), 8.0)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    want = []
    for i, x0, y0, x1, y1 in rows:
        for j, u0, v0, u1, v1 in rows:
            common = max(0, min(x1, u1) - max(x0, u0)) * max(0, min(y1, v1) - max(y0, v0))
            apart = np.hypot(max(0, u0 - x1, x0 - u1), max(0, v0 - y1, y0 - v1))
            kind = "CONTAINING" if common / ((u1 - u0) * (v1 - v0)) > 0.9 else "CONTAINED" if common / ((x1 - x0) * (y1 - y0)) > 0.9 else "NEIGHBORING" if apart < 0.5 else None
            want += [(i, j, kind)] if i != j and kind else []
    assert sorted(map(tuple, found.collect())) == sorted(want)
