"""From clusters of points and outlines to the faces of building models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kawara.functions import geometry as g
from kawara.operators import graph, kernels, spatial
from kawara.operators.raster import _grouped
from kawara.operators.spatial import _cut

RING2 = "array<struct<x:double,y:double>>"


def numbered(rows: DataFrame, keys: tuple[str, ...], name: str, *order: Column) -> DataFrame:
    """rows with their number (from 0) within keys in an order that leaves no ties."""
    by = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    return rows.withColumn(name, F.row_number().over(by) - 1)


def clusters_by_size(clusters: DataFrame) -> DataFrame:
    """clusters (building_id, cluster, n) with rank: most points first, equals in the order they came in."""
    return numbered(clusters, ("building_id",), "rank", F.desc("n"), F.asc("cluster"))


def planes_by_height(planes: DataFrame) -> DataFrame:
    """planes (building_id, plane, height) with rank: highest first, then the later plane."""
    return numbered(planes, ("building_id",), "rank", F.desc("height"), F.desc("plane"))


def insertions(points: DataFrame) -> DataFrame:
    """points (building_id, roof, place, t, ...) with rank: by roof, from the last place and the largest t backwards, so
    that an insertion does not move the places of those to come."""
    return numbered(points, ("building_id",), "rank", F.asc("roof"), F.desc("place"), F.desc("t"))


def outer_ring(rings: DataFrame) -> DataFrame:
    """(building_id, ring_id): the ring of largest area, the smallest id of equals. rings: building_id, ring_id, ring."""
    size = F.struct(g.area(F.col("ring")).alias("area"), (-F.col("ring_id")).alias("last"))
    return rings.groupBy("building_id").agg(F.max_by("ring_id", size).alias("ring_id"))


def by_mesh(buildings: DataFrame) -> DataFrame:
    """buildings (file, seq, code, ...) with rank: by mesh code, equals in their order."""
    return numbered(buildings, ("file",), "rank", F.asc("code"), F.asc("seq"))


def siblings(parents: DataFrame) -> DataFrame:
    """(parent, children): the sorted roofs that share a parent. parents: child, parent."""
    return parents.where("parent IS NOT NULL").groupBy("parent").agg(F.array_sort(F.collect_list("child")).alias("children"))


def status_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(name, status, n) of several status columns."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("status")) for c in columns))).alias("s")
    return rows.select(each).groupBy("s.name", "s.status").agg(F.count("*").alias("n"))


def nearest_plane(samples: DataFrame, planes: DataFrame, none: float = 999.0) -> DataFrame:
    """(building_id, sample_id, plane, distance): the plane whose outline is nearest to each sample, the smallest of
    equals; a plane without an outline is none away."""
    away = F.coalesce(g.ring_distance(g.point(F.col("x"), F.col("y")), F.col("ring")), F.lit(none))
    pairs = samples.select("building_id", "sample_id", "x", "y").join(planes.select("building_id", "plane", "ring"), "building_id")
    best = pairs.groupBy("building_id", "sample_id").agg(F.min(F.struct(away.alias("distance"), "plane")).alias("b"))
    return best.select("building_id", "sample_id", "b.plane", "b.distance")


def farthest_inside(rings: DataFrame, most: float = 0.5) -> DataFrame:
    """(id, distance): of the corners of ring inside the outline and at most `most` from its line the largest distance,
    0 if there is none. rings: id, ring, outline."""
    corner = rings.select("id", "outline", F.explode_outer("ring").alias("p"))
    away = g.ring_distance(F.col("p"), F.col("outline"))
    inside = g.contains(F.col("outline"), F.col("p.x"), F.col("p.y"))
    corner = corner.withColumn("away", F.when(inside, away))
    good = F.when(F.col("away") <= most, F.col("away"))
    return corner.groupBy("id").agg(F.coalesce(F.max(good), F.lit(0.0)).alias("distance"))


def base_edge(edges: DataFrame, threshold: float) -> DataFrame:
    """(building_id, edge, aligned, length, ux, uy): the edge that most length of all edges goes with; the longer, then
    the first of equals. edges: building_id, edge, ax, ay, bx, by. ux, uy is the unit vector from b to a.

    Another edge goes with an edge if, at the other's start, the directions to the edge's end and to the other's end
    differ by a multiple of 90 degrees, within the threshold.
    """
    size = F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)
    own = edges.withColumn("length", size).where("length > 0")
    other = own.select("building_id", *(F.col(c).alias(f"o_{c}") for c in ("length", "ax", "ay", "bx", "by")))
    here = F.atan2(F.col("by") - F.col("o_ay"), F.col("bx") - F.col("o_ax"))
    there = F.atan2(F.col("o_by") - F.col("o_ay"), F.col("o_bx") - F.col("o_ax"))
    aligned = F.when(g.axis_aligned(F.degrees(there - here), threshold), F.col("o_length")).otherwise(0.0)
    kept = ["building_id", "edge", "length", "ax", "ay", "bx", "by"]
    sums = own.join(other, "building_id").groupBy(*kept).agg(F.sum(aligned).alias("aligned"))
    best = sums.groupBy("building_id").agg(F.max_by(F.struct("edge", "aligned", "length", "ax", "ay", "bx", "by"), F.struct(F.round("aligned", 9), "length", -F.col("edge"))).alias("b"))
    unit = [((F.col(f"b.a{k}") - F.col(f"b.b{k}")) / F.col("b.length")).alias(f"u{k}") for k in "xy"]
    return best.select("building_id", "b.edge", "b.aligned", "b.length", *unit)


def moved_inside(nodes: DataFrame) -> DataFrame:
    """nodes (id, x, y, outline) with those that are not inside their outline moved to its nearest point."""
    at = g.nearest_on_ring(g.point(F.col("x"), F.col("y")), F.col("outline"))
    rows = nodes.withColumn("at", F.when(~g.contains(F.col("outline"), F.col("x"), F.col("y")), at))
    return rows.withColumn("x", F.coalesce("at.x", "x")).withColumn("y", F.coalesce("at.y", "y")).drop("at")


def plane_types(lines: DataFrame, near: DataFrame, band: float = 5.0, square: float = 10.0, shortest: float = 0.0) -> DataFrame:
    """(building_id, plane, type, angle): what the outline's lines near a roof plane look like.

    Mean shift joins the angles of a building's lines (building_id, line, angle, length); near is (building_id, plane,
    line), every plane at least once (line may be null). Lines no longer than shortest do not count. angle is that of
    the longest line, the first of equals.
    """

    def make(found: pa.Table) -> dict:
        order = np.argsort(found.column("line").to_numpy())
        angle = found.column("angle").to_numpy()[order]
        distinct, place, count = np.unique(angle, return_inverse=True, return_counts=True)
        label = kernels.mean_shift(distinct, count.astype(float), band)[place]
        centre = np.array([angle[label == k].mean() for k in label])
        return {"line": found.column("line").to_numpy()[order], "label": label, "centre": centre}

    kept = lines.select(F.col("building_id").cast("long"), F.col("line").cast("long"), F.col("angle").cast("double"))
    labels = _grouped(kept, "building_id", "building_id long, line long, label int, centre double", make)
    rows = near.join(lines.join(labels, ["building_id", "line"]).where(F.col("length") > shortest), ["building_id", "line"], "left")
    per = rows.groupBy("building_id", "plane").agg(
        F.count_distinct("label").alias("n"), F.min("centre").alias("low"), F.max("centre").alias("high"),
        F.max_by("angle", F.when(F.col("label").isNotNull(), F.struct("length", -F.col("line")))).alias("angle"),
    )
    right = F.abs(F.col("high") - F.col("low") - 90) < square
    kind = F.when(F.col("n") == 0, "NO_NEIGHBOR_LINE").when(F.col("n") == 1, "ONE_NEIGHBOR_LINE").when((F.col("n") == 2) & right, "ORTHOGONAL_CROSSING")
    kind = kind.when(F.col("n") == 2, "NOT_ORTHOGONAL_CROSSING").otherwise("THREE_OR_MORE_NEIGHBOR_LINES")
    return per.select("building_id", "plane", kind.alias("type"), "angle")


def merged_corners(corners: DataFrame, radius: float) -> DataFrame:
    """corners (id, x, y, ...) moved to the mean of their cluster: chains of steps of at most radius."""
    labels = graph.radius_components(corners.select("id", "x", "y"), radius)
    rows = corners.join(labels, "id")
    mean = rows.groupBy("comp").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    return rows.join(mean, "comp").withColumn("x", F.col("mx")).withColumn("y", F.col("my")).drop("comp", "mx", "my")


def welded_corners(corners: DataFrame, radius: float, step: float) -> DataFrame:
    """corners (id, x, y, z) welded: those that chain up in the plane within radius take the first one's x and y, and the
    largest z of those among them that chain up in height within step. A corner that is nowhere stays as it is.

    Corners in one place and height are one, and corners are told by their place and height where they go. The different
    heights of a stack meet in one task.
    """
    seen = _cut(corners.where(spatial.PLACED).groupBy("x", "y", "z").agg(F.min("id").alias("id")))
    places = _cut(seen.groupBy("x", "y").agg(F.min("id").alias("id")))
    found = graph.place_components(places, radius).withColumnRenamed("comp", "stack")
    stacks = _cut(seen.select("x", "y", "z").join(found, ["x", "y"]))
    levels = graph.gap_clusters(stacks.select("stack", "z").distinct(), ["stack"], "z", step, "z")
    levels = levels.select(F.col("stack").alias("of"), F.col("z").alias("height"), F.max("z").over(Window.partitionBy("stack", "cluster")).alias("top"))
    # a stack is named by its first corner
    first = places.select(F.col("id").alias("stack"), F.col("x").alias("fx"), F.col("y").alias("fy"))
    moves = stacks.join(first.hint("merge"), "stack").join(levels.hint("merge"), F.expr("stack = of AND z <=> height"))
    moves = _cut(moves.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), "fx", "fy", "top"))
    moves = F.broadcast(moves) if moves.count() <= spatial.MOST else moves.hint("merge")
    rows = corners.select("id", "x", "y", "z").join(moves, F.expr("x = px AND y = py AND z <=> pz"), "left")
    top = F.when(F.col("fx").isNull(), F.col("z")).otherwise(F.col("top"))
    return rows.select("id", F.coalesce("fx", "x").alias("x"), F.coalesce("fy", "y").alias("y"), top.alias("z"))


def kept_apart(points: DataFrame, gone: DataFrame, ground: float) -> DataFrame:
    """points (building_id, pid, z, label) without those of gone (building_id, pid), and where they belong: GROUND where
    they have no label or lie under the ground, else ROOF."""
    rows = points.join(gone.select("building_id", "pid"), ["building_id", "pid"], "left_anti")
    return rows.withColumn("kind", F.when(F.col("label").isNull() | (F.col("z") < ground), "GROUND").otherwise("ROOF"))


def colours_clustered(points: DataFrame, band: float = 20.0) -> DataFrame:
    """(building_id, level, red, green, blue, n, cluster): mean shift over the colours of each level of a building.

    points: building_id, level, red, green, blue of 16 bits. Equal colours (over 256, whole) are counted first, so a
    group is its distinct colours.
    """
    bits = [F.floor(F.col(c) / 256).cast("int").alias(c) for c in ("red", "green", "blue")]
    counts = points.select("building_id", "level", *bits).groupBy("building_id", "level", "red", "green", "blue").agg(F.count("*").alias("n"))

    def run(found: pa.Table) -> pa.Table:
        rgb = np.column_stack([found.column(c).to_numpy() for c in ("red", "green", "blue")]).astype(float)
        order = np.lexsort(rgb.T[::-1])
        labels = kernels.mean_shift_nd(rgb[order], found.column("n").to_numpy()[order].astype(float), band)
        return found.take(pa.array(order)).append_column("cluster", pa.array(labels.astype(np.int32)))

    return counts.groupBy("building_id", "level").applyInArrow(run, "building_id long, level int, red int, green int, blue int, n long, cluster int")


def contours(points: DataFrame, alpha: float = 2.0) -> DataFrame:
    """(building_id, cluster, part, ring): the alpha shape of each cluster; none for too few points, or points in line."""

    def run(found: pa.Table) -> pa.Table:
        rings = kernels.alpha_shape(np.column_stack([found.column(k).to_numpy() for k in "xy"]), alpha)
        keys = [pa.array([found.column(k)[0].as_py()] * len(rings), t) for k, t in (("building_id", pa.int64()), ("cluster", pa.int64()))]
        points = [[{"x": x, "y": y} for x, y in r] for r in rings]
        kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
        return pa.Table.from_arrays([*keys, pa.array(range(len(rings)), pa.int32()), pa.array(points, kind)], names=["building_id", "cluster", "part", "ring"])

    kept = points.select(F.col("building_id").cast("long"), F.col("cluster").cast("long"), "x", "y").distinct()
    return kept.groupBy("building_id", "cluster").applyInArrow(run, f"building_id long, cluster long, part int, ring {RING2}")


def _rings(column: pa.Array) -> list[np.ndarray]:
    return [np.array([(p["x"], p["y"]) for p in r], float).reshape(-1, 2) for r in column.to_pylist()]


def polygon_relations(polygons: DataFrame, size: float, keys: tuple[str, ...] = (), share: float = 0.9, gap: float = 0.5) -> DataFrame:
    """As spatial.box_relations(), for simple rings (keys, id, ring): pairs of boxes that are near enough are looked at,
    and their common area and distance computed in Arrow batches. Rings that are boxes themselves are compared as such."""
    b = g.bounds(F.col("ring"))
    boxed = polygons.select(*keys, "id", "ring", *(b[f"{n}_{k}"].alias(f"{k}{i}") for k in "xy" for i, n in enumerate(("min", "max"))))
    boxed = boxed.withColumn("whole", F.coalesce(_is_box(F.col("ring")), F.lit(False)))
    plain = spatial.box_relations(boxed.where("whole").select(*keys, "id", "x0", "y0", "x1", "y1"), size, keys, share, gap)
    grown = boxed.withColumns({f"{k}{i}": F.col(f"{k}{i}") + (gap if i else -gap) for k in "xy" for i in (0, 1)})
    pairs = spatial.box_pairs(grown.select(*keys, "id", "x0", "y0", "x1", "y1", "whole"), size, keys, "NOT (whole AND o_whole)")
    own = boxed.select(*keys, F.col("id").alias("a"), F.col("ring").alias("own"))
    other = boxed.select(*keys, F.col("id").alias("b"), F.col("ring").alias("other"))
    rows = pairs.join(own, [*keys, "a"]).join(other, [*keys, "b"]).select(*(F.col(k).cast("long") for k in keys), "a", "b", "own", "other")
    schema = ", ".join([*(f"{k} long" for k in keys), "a long", "b long", "common double", "apart double", "own_area double", "other_area double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = _rings(batch.column("own")), _rings(batch.column("other"))
            common = [kernels.overlap_area(x, y) for x, y in zip(p, q, strict=True)]
            apart = [0.0 if c > 0 else kernels.ring_gap(x, y) for c, x, y in zip(common, p, q, strict=True)]
            sizes = [[abs(kernels.signed_area(x)) for x in side] for side in (p, q)]
            keep = [batch.column(i) for i in range(len(keys) + 2)]
            yield pa.RecordBatch.from_arrays([*keep, *(pa.array(c, pa.float64()) for c in (common, apart, *sizes))], names=[*keys, "a", "b", "common", "apart", "own_area", "other_area"])

    found = rows.mapInArrow(run, schema)
    kind = lambda own, other: (
        F.when(F.col("common") / F.col(other) > share, "CONTAINING").when(F.col("common") / F.col(own) > share, "CONTAINED").when(F.col("apart") < gap, "NEIGHBORING")
    )
    one = found.select(*keys, "a", "b", kind("own_area", "other_area").alias("relation"))
    two = found.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), kind("other_area", "own_area").alias("relation"))
    plain = plain.select(*(F.col(k).cast("long") for k in keys), "a", "b", "relation")
    return plain.unionByName(one.unionByName(two).where("relation IS NOT NULL"))


def _is_box(ring: Column) -> Column:
    """Whether a ring is a rectangle along the axes, of some area: opposite corners differ in both axes, others in one."""
    p = [F.get(ring, F.lit(i)) for i in range(4)]
    apart = [(p[i][k] != p[i + 2][k]) for i in (0, 1) for k in "xy"]
    turn = ((p[0].x == p[1].x) & (p[1].y == p[2].y) & (p[2].x == p[3].x) & (p[3].y == p[0].y)) | ((p[0].y == p[1].y) & (p[1].x == p[2].x) & (p[2].y == p[3].y) & (p[3].x == p[0].x))
    return (F.size(ring) == 4) & apart[0] & apart[1] & apart[2] & apart[3] & turn


def ground_clusters(clusters: DataFrame, relations: DataFrame, least_area: float = 20.0, least_width: float = 1.0) -> DataFrame:
    """clusters (building_id, id, height, ground, area, perimeter) with is_ground.

    A cluster without area is ground; so is one under the ground that lies in another, is small, or is narrow. Where
    that leaves no roof, the cluster of largest area is one. relations: building_id, a, b, relation.
    """
    held = relations.where("relation = 'CONTAINING'").select("building_id", F.col("b").alias("id")).distinct().withColumn("held", F.lit(True))
    rows = clusters.join(held.hint("merge"), ["building_id", "id"], "left")
    narrow = F.col("area") / F.nullif("perimeter", F.lit(0.0)) < least_width
    low = (F.col("height") < F.col("ground")) & (F.coalesce("held", F.lit(False)) | (F.col("area") < least_area) | F.coalesce(narrow, F.lit(True)))
    rows = rows.withColumn("is_ground", (F.col("area") == 0) | low).drop("held")
    by = Window.partitionBy("building_id")
    none = F.min(F.col("is_ground").cast("int")).over(by) == 1
    first = F.max_by("id", F.struct("area", -F.col("id"))).over(by)
    return rows.withColumn("is_ground", F.when(none & (F.col("id") == first), F.lit(False)).otherwise(F.col("is_ground")))


FACES = "mesh_id long, face_id long, element string, ring array<struct<x:double,y:double,z:double>>"


def with_missing_corners(faces: DataFrame, most: float = 0.001) -> DataFrame:
    """faces (mesh_id, face_id, element, ring) with the corners of other faces that lie on their edges; pairs of a roof
    and a ground are passed over. One mesh is one group; faces are done in order and see what earlier ones have become."""

    def make(found: pa.Table) -> dict:
        rows = sorted(found.to_pylist(), key=lambda r: r["face_id"])
        rings = [[(p["x"], p["y"], p["z"]) for p in r["ring"] or []] for r in rows]
        for i, r in enumerate(rows):
            for j, o in enumerate(rows):
                if i != j and {r["element"], o["element"]} != {"ROOF", "GROUND"}:
                    rings[i] = kernels.with_missing_vertices(rings[i], rings[j], most)
        points = [[dict(zip("xyz", p, strict=True)) for p in ring] for ring in rings]
        return {"face_id": [r["face_id"] for r in rows], "element": [r["element"] for r in rows], "ring": points}

    kept = faces.select(F.col("mesh_id").cast("long"), F.col("face_id").cast("long"), "element", "ring")
    return _grouped(kept, "mesh_id", FACES, make)


def coplanar_merged(faces: DataFrame, degrees: float = 5.0) -> DataFrame:
    """(mesh_id, face_id, grp): the group of faces that share edges and turn by less than degrees; the smallest face names it."""

    def make(found: pa.Table) -> dict:
        rows = sorted(found.to_pylist(), key=lambda r: r["face_id"])
        rings = [[(p["x"], p["y"], p["z"]) for p in r["ring"] or []] for r in rows]
        ids = [r["face_id"] for r in rows]
        return {"face_id": ids, "grp": [ids[k] for k in kernels.coplanar_groups(rings, degrees)]}

    kept = faces.select(F.col("mesh_id").cast("long"), F.col("face_id").cast("long"), "ring")
    return _grouped(kept, "mesh_id", "mesh_id long, face_id long, grp long", make)


def extruded(blocks: DataFrame) -> DataFrame:
    """The faces (mesh_id, face_id, element, ring) of blocks (building_id, ring, bottom, top): the ground clockwise from
    above, the roof against it, and a wall on each edge that looks outwards."""
    up = F.when(g.signed_area(F.col("ring")) < 0, F.reverse("ring")).otherwise(F.col("ring"))
    rows = blocks.withColumn("up", up)
    at = lambda p, z: g.point(p["x"], p["y"], F.col(z))
    wall = F.transform(g.edges(F.col("up")), lambda e: F.struct(F.lit("WALL").alias("element"), F.array(at(e["p"], "bottom"), at(e["q"], "bottom"), at(e["q"], "top"), at(e["p"], "top")).alias("ring")))
    roof = F.struct(F.lit("ROOF").alias("element"), F.transform("up", lambda p: at(p, "top")).alias("ring"))
    ground = F.struct(F.lit("GROUND").alias("element"), F.reverse(F.transform("up", lambda p: at(p, "bottom"))).alias("ring"))
    every = F.concat(F.array(roof), wall, F.array(ground))
    faces = rows.select(F.col("building_id").alias("mesh_id"), F.posexplode(every).alias("face_id", "f"))
    return faces.select("mesh_id", F.col("face_id").cast("long").alias("face_id"), "f.element", "f.ring")


def corners_on_edges(vertices: DataFrame, edges: DataFrame, error: float = 1e-3) -> DataFrame:
    """(mesh_id, edge, vertex): the first vertex that lies on each edge: its distances to the edge's ends exceed the
    edge's length by less than error. vertices: mesh_id, vertex, x, y, z; edges: mesh_id, edge, a, b (vertices)."""
    end = lambda e: vertices.select("mesh_id", F.col("vertex").alias(e), *(F.col(k).alias(f"{e}{k}") for k in "xyz"))
    rows = edges.join(end("a"), ["mesh_id", "a"]).join(end("b"), ["mesh_id", "b"])
    pairs = rows.join(vertices, "mesh_id").where("vertex <> a AND vertex <> b")
    away = lambda p, q: F.sqrt(sum(((F.col(f"{p}{k}") - F.col(f"{q}{k}")) ** 2 for k in "yz"), (F.col(f"{p}x") - F.col(f"{q}x")) ** 2))
    return pairs.where(away("a", "") + away("b", "") - away("a", "b") < error).groupBy("mesh_id", "edge").agg(F.min("vertex").alias("vertex"))


def missing_vertices(edges: DataFrame, points: DataFrame, size: float, most: float = 0.1, keys: tuple[str, ...] = ("building_id",)) -> DataFrame:
    """(keys, edge, point, t, x, y): the points that an edge passes within `most`, not at its ends, with the place along it
    (four decimals) where they belong. edges: keys, edge, ax, ay, bx, by; points: keys, point, x, y. Edges are dealt over
    the cells of their boxes."""
    box = [F.least(f"a{k}", f"b{k}") - most for k in "xy"] + [F.greatest(f"a{k}", f"b{k}") + most for k in "xy"]
    dealt = edges.withColumn("c", F.explode(spatial.box_cells(*box, size))).select(*edges.columns, "c.cx", "c.cy")
    rows = dealt.join(spatial.with_cell(points, size), [*keys, "cx", "cy"])
    u = g.point(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    foot = g.truncated_foot(g.point(F.col("x"), F.col("y")), g.point(F.col("ax"), F.col("ay")), u)
    rows = rows.withColumn("foot", foot).where("foot.t > 0 AND foot.t < 1").where(F.col("foot.distance") < most)
    return rows.select(*keys, "edge", "point", "foot.t", "foot.x", "foot.y")
