"""Operators without a plain SQL form, against plain Python."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kawara.functions import geometry as g
from kawara.operators import graph, grouped, kernels, mesh, modeling, raster, spatial, texture
from kawara.plans import models
from kawara.streaming import meshes

RING = "array<struct<x:double,y:double,z:double>>"


def ring(*corners):
    return [dict(zip("xyz", map(float, c), strict=False)) for c in corners]


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


@pytest.mark.parametrize("axes, least, smallest", [("xy", 4, 1), ("xyz", 5, 8)])
def test_dbscan(spark, axes, least, smallest):
    rng = np.random.default_rng(3)
    p = np.round(np.concatenate([rng.uniform(0, 8, (350, len(axes))), rng.normal(4, 0.3, (250, len(axes)))]), 2)
    points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, " + ", ".join(f"{k} double" for k in axes))
    want = labels_by_hand(p, 0.5, least)
    sizes = Counter(want.values())
    got = {r.id: r.cluster for r in graph.dbscan(points, 0.5, least, smallest, axes).collect()}
    assert got == {i: c for i, c in want.items() if sizes[c] >= smallest}


def test_leaf_pruning(spark):
    rng = np.random.default_rng(2)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 60, (55, 2))] + [(i, i + 1) for i in range(100, 112)] + [(200, 201), (201, 202), (202, 200), (202, 203)]
    got = {tuple(r) for r in graph.pruned_leaves(spark.createDataFrame(edges, "a long, b long")).collect()}
    left = {tuple(sorted(e)) for e in edges if e[0] != e[1]}
    while True:
        n = Counter(v for e in left for v in e)
        kept = {e for e in left if n[e[0]] > 1 and n[e[1]] > 1}
        if kept == left:
            break
        left = kept
    assert got == left and (200, 201) in got


def test_moved_nodes(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 0.0), (3, 9.0, 0.0)], "id long, x double, y double")
    edges = spark.createDataFrame([(1, 2, 0), (2, 3, 1), (1, 3, 0)], "a long, b long, label int")
    kept, left = graph.moved_nodes(nodes, edges, spark.createDataFrame([(3, 5.0, 0.001)], "id long, x double, y double"), 0.01)
    assert {r.id for r in kept.collect()} == {1, 2}
    assert [tuple(r) for r in left.collect()] == [(1, 2, 0)]


def test_mesh_rows(spark):
    square = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)]
    rows = [(1, 1, "ROOF", ring(*square)), (1, 2, "ROOF", None), (1, 3, "ROOF", []), (1, 4, "WALL", ring((0, 0, 0), (2, 2, 0), (2, 0, 0), (0, 1, 0)))]
    faces = spark.createDataFrame(rows, f"mesh_id long, face_id long, element string, ring {RING}")
    found = {r.face_id: r for r in mesh.checked(faces).collect()}
    assert [found[k].status for k in (1, 2, 3, 4)] == ["SUCCESS", "ERROR", "ERROR", "WARN"]
    messages = [r.message for r in mesh.violations(mesh.checked(faces)).collect()]
    assert messages == ["1: self_intersection: 4"]
    assert mesh.checked(faces.limit(0)).count() == 0 and mesh.crossing_faces(faces.limit(0), 1.0).count() == 0


@pytest.mark.parametrize("faces, rings", [
    # a side of two faces against one: the middle corner lies on the long edge
    ([[(0, 0, 0), (2, 0, 0), (2, 1, 0), (0, 1, 0)], [(1, 0, 0), (0, 0, 0), (0, 0, 1), (1, 0, 1)], [(2, 0, 0), (1, 0, 0), (1, 0, 1), (2, 0, 1)]], 1),
    ([[(0, 0, 0), (1, 0, 0), (0, 1, 0)], [(0, 0, 0), (0, 1, 0), (1, 0, 0)]], 0),
    ([[(0, 0, 0), (1, 0, 0), (0, 1, 0)], [(5, 5, 0), (6, 5, 0), (5, 6, 0)]], 2),
])
def test_openings(faces, rings):
    found = kernels.open_rings(faces)
    assert len(found) == rings
    # what closes the openings closes the solid
    assert kernels.open_rings([*faces, *found]) == []


def test_triangles_cross():
    flat = np.array([[(0, 0, 0), (4, 0, 0), (0, 4, 0)]], float)
    for other, want in (
        ([(1, 1, -1), (1.2, 1, -1), (1.1, 1, 1)], True), ([(1, 1, 0), (1.2, 1, 0), (1.1, 1, 1)], False), ([(0, 0, 0), (4, 0, 0), (1, 1, 2)], False),
        ([(3, 3, -1), (3.2, 3, -1), (3.1, 3, 1)], False), ([(1, 1, 1), (2, 1, 1), (1, 2, 1)], False), ([(-1, 1, -1), (9, 1, -1), (1, 1, 30)], True),
    ):
        assert kernels.triangles_cross(flat, np.array([other], float))[0] == want == kernels.triangles_cross(np.array([other], float), flat)[0]


def test_delaunay_and_contours():
    p = np.random.default_rng(0).uniform(0, 10, (80, 2))
    for t in kernels.delaunay(p):
        x, y, size = kernels._circle(*p[list(t)])
        assert (((p - [x, y]) ** 2).sum(1) >= size * (1 - 1e-9)).all()
    two = np.concatenate([p[:40] / 5, p[40:] / 5 + 20])
    assert len(kernels.alpha_shape(two, 0.5)) == 2 and kernels.alpha_shape(p[:2], 2.0) == [] == kernels.alpha_shape(np.array([(0, 0), (1, 1), (2, 2.0)]), 2.0)


def test_overlap():
    l_shape = [(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)]
    square = [(1, 1), (5, 1), (5, 5), (1, 5)]
    assert kernels.overlap_area(l_shape, square) == pytest.approx(5) == kernels.overlap_area(square[::-1], l_shape)
    assert kernels.overlap_area(l_shape, [(2.5, 2.5), (3, 2.5), (3, 3)]) == 0
    assert kernels.ring_gap(l_shape, [(2.5, 2.25), (3, 2.5), (3, 3)]) == pytest.approx(0.25)


def test_small_kernels():
    assert kernels.snapped([(0, 0), (0.1, 0), (1, 0), (0.9, 0.05), (0.06, 0)], 0.2) == [0, 0, 2, 2, 0]
    around = kernels.bridged([(0, 0), (10, 0), (10, 10), (0, 10)], [(4, 4), (6, 4), (6, 6), (4, 6)])
    assert len(around) == 10 and kernels.signed_area(np.array(around)) == 96
    roof = [(0, 0, 0), (2, 0, 0), (2, 1, 1), (2, 2, 0), (0, 2, 0), (0, 1, 1)]
    found = kernels.triangulated_3d(roof)
    assert len(found) == 4 and sum({2, 5} <= set(t) for t in found) == 2  # the ridge is an edge
    ring_ = kernels.with_missing_vertices([(0, 0, 0), (4, 0, 0), (4, 4, 0)], [(1, 0, 0), (2, 0.0005, 0), (3, 0.5, 0), (0, 0, 0)])
    assert ring_ == [(0, 0, 0), (1, 0, 0), (2, 0.0005, 0), (4, 0, 0), (4, 4, 0)]
    labels = kernels.mean_shift_nd(np.array([[0, 0, 0], [3, 0, 0], [100, 0, 0.0]]), np.array([1, 1, 5.0]), 20)
    assert labels[0] == labels[1] != labels[2] == 0
    assert kernels.seed_merged([0, 2.0, 1.9], 2.0) == [0, 1, 0]


def test_nearest_however_far(spark):
    rng = np.random.default_rng(5)
    p, q = rng.uniform(0, 100, (60, 2)), rng.uniform(0, 100, (25, 2))
    left = spark.createDataFrame([(i, i % 2, *map(float, x)) for i, x in enumerate(p)], "a long, k long, x double, y double")
    right = spark.createDataFrame([(i, i % 2, *map(float, x)) for i, x in enumerate(q)], "b long, k long, x double, y double")
    got = {r.a: (r.b, r.distance) for r in spatial.nearest(left, right, "a", "b", 1.0, ("k",)).collect()}
    for i, x in enumerate(p):
        away = [(np.hypot(*(x - y)), j) for j, y in enumerate(q) if j % 2 == i % 2]
        assert got[i] == (min(away)[1], pytest.approx(min(away)[0]))
    assert spatial.nearest(left, right.limit(0), "a", "b", 1.0).count() == 0


def test_crossed_in_blocks(spark):
    left, right = spark.range(7), spark.range(50).withColumnRenamed("id", "other")
    assert spatial.crossed(left, right, 8).distinct().count() == 350


def test_packing_of_rectangles(spark):
    rng = np.random.default_rng(4)
    made = [(int(i % 3), int(i), str(i % 11), int(w), int(h)) for i, (w, h) in enumerate(rng.integers(1, 40, (120, 2)))]
    rects = spark.createDataFrame(made, "atlas long, seq long, building string, w int, h int")
    for rows in (grouped.packed(rects, 64).collect(), [r for r in grouped.shelved(rects, 64).collect()]):
        assert len(rows) == 120
        for a in rows:
            for b in rows:
                if a.atlas == b.atlas and a.seq < b.seq and getattr(a, "page", 0) == getattr(b, "page", 0) != -1:
                    assert not (a.x < b.x + b.w and b.x < a.x + a.w and a.y < b.y + b.h and b.y < a.y + a.h)
            assert a.x + a.w <= 64 if "page" in a else a.x + a.w <= a.page_w and a.y + a.h <= a.page_h


def test_heights(spark):
    z = [0.0] * 10 + [0.2] * 5 + [5.0] * 20 + [5.1] * 3 + [9.0]
    points = spark.createDataFrame([(1, float(v)) for v in z], "building_id long, z double")
    got = {r.z: (r.n, r.cluster) for r in grouped.heights_clustered(points, 0.5).collect()}
    assert got == {0.0: (10, 1), 0.2: (5, 1), 5.0: (20, 0), 5.1: (3, 0), 9.0: (1, 2)}


def test_verticality(spark):
    rng = np.random.default_rng(6)
    p = rng.uniform(-1, 1, (50, 2))
    flat = [(1, float(x), float(y), 0.0) for x, y in p]
    wall = [(2, float(x), 0.0, float(y)) for x, y in p]
    got = {r.id: r for r in grouped.verticality(spark.createDataFrame(flat + wall, "id long, nx double, ny double, nz double")).collect()}
    assert got[1].verticality == pytest.approx(0, abs=1e-9) and got[2].verticality == pytest.approx(1) and got[1].planarity > 0.5


def test_texture(spark):
    photos = spark.createDataFrame([(1, 5.0, 5.0, 100.0, 0.0, 0.0, 0.0, 2.0, 0.02, 100, 100), (2, 500.0, 5.0, 100.0, 0.0, 0.0, 0.0, 2.0, 0.02, 100, 100)],
                                   "photo_no long, x0 double, y0 double, z0 double, omega double, phi double, kappa double, focal double, pixel double, width int, height int")
    faces = spark.createDataFrame([(7, ring((0, 0, 0), (10, 0, 0), (10, 10, 0), (0, 10, 0)))], f"face_id long, ring {RING}")
    views = {r.photo_no: r for r in texture.face_views(faces, photos).collect()}
    assert views[1].visible and views[1].area == pytest.approx(100) and not views[2].visible
    assert texture.best_photo(texture.face_views(faces, photos)).first().photo_no == 1
    corners = [(f, e, float(x), 0.0, float(z)) for f, e, pts in (
        (1, "WALL", [(0, 0), (1, 0), (1, 3), (0, 3)]), (2, "ROOF", [(0, 3), (1, 3), (1, 5)]), (3, "ROOF", [(0, 3), (1, 3), (1, 4)]), (4, "ROOF", [(0, 3), (9, 9)]),
    ) for x, z in pts]
    roofs = texture.roof_of_wall(spark.createDataFrame(corners, "face_id long, element string, x double, y double, z double"))
    assert [tuple(r) for r in roofs.collect()] == [(1, 2)]
    pixels = spark.createDataFrame([(1, True), (1, False), (2, False), (2, False), (2, True)], "polygon_id long, is_balcony boolean")
    assert {r.polygon_id: r.balcony for r in texture.balconies(pixels).collect()} == {1: True, 2: False}


def test_models(spark):
    images = spark.createDataFrame([(1, 300, 10, b""), (2, 10, 10, b"a"), (3, 256, 256, b"")], "building_id long, width int, height int, content binary")

    def load():
        return lambda rows: pd.DataFrame({"building_id": rows.building_id, "roof": ["FLAT" if c else "NON_FLAT" for c in rows.content]})

    assert {r.building_id: r.roof for r in models.roof_classes(images, load).collect()} == {1: "FLAT", 2: "FLAT", 3: "NON_FLAT"}
    with pytest.raises(models.NoModel):
        models.roof_classes(images)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"mesh_id":1,"face_id":2,"element":"ROOF","ring":[{"x":0,"y":0,"z":0},{"x":2,"y":2,"z":0},{"x":2,"y":0,"z":0},{"x":0,"y":1,"z":0}]}\n')
    found = meshes.violations(meshes.read_faces(spark, str(tmp_path / "in")))
    q = found.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.check for r in spark.table("found").collect()] == ["self_intersection"]


def test_raster(spark):
    far = [(1, 0, 0, 0, 1.0), (1, 1, 5000, 0, 2.0)]
    rows = spark.createDataFrame(far + [(2, 0, 0, 0, 3.0), (2, 1, 0, 0, 4.0), (2, 2, 2, 1, 5.0)], "building_id long, pid long, col int, row int, value double")
    got = {(r.col, r.row): r.value for r in raster.filled(rows).collect()}
    assert got == {(0, 0): 3.0, (1, 0): 3.0, (2, 0): 5.0, (0, 1): 3.0, (1, 1): 5.0, (2, 1): 5.0}


def test_blocks_are_closed(spark):
    outlines = [(1, ring((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))), (2, ring((0, 0), (0, 4), (4, 4), (4, 0)))]
    blocks = spark.createDataFrame(outlines, "building_id long, ring array<struct<x:double,y:double>>").withColumn("bottom", F.lit(0.0)).withColumn("top", F.lit(3.0))
    faces = modeling.extruded(blocks)
    assert mesh.open_edges(faces).count() == 0
    up = faces.select("mesh_id", "element", g.normal(F.col("ring"))["z"].alias("z")).where("element <> 'WALL'").collect()
    assert all((r.z < 0) == (r.element == "ROOF") for r in up)
