"""Mesh validation on rows: faces (mesh_id, face_id, element, ring), ring an array of (x, y, z)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kawara.functions import geometry as g
from kawara.operators import kernels, spatial


def corners(faces: DataFrame) -> DataFrame:
    """One row for each corner: mesh_id, face_id, idx, p."""
    return faces.select("mesh_id", "face_id", F.posexplode("ring").alias("idx", "p"))


def face_edges(faces: DataFrame) -> DataFrame:
    """Directed edges: mesh_id, face_id, idx, p, q."""
    return faces.select("mesh_id", "face_id", F.posexplode(g.edges(F.col("ring"))).alias("idx", "e")).select(
        "mesh_id", "face_id", "idx", "e.p", "e.q"
    )


def neighbours(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """rows with next_<value>: the following one, the last row's is the first."""
    by = Window.partitionBy(*keys).orderBy(order)
    first = F.first(value).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn(f"next_{value}", F.coalesce(F.lead(value).over(by), first))


def double_points(ring: Column, error: float = 0.01) -> Column:
    """Indexes of corners that repeat the one before them (cyclic) within the error."""
    n = F.size(ring)
    near = lambda i: g.same_point(ring[i], ring[(i + n - 1) % n], error)
    return F.filter(F.sequence(F.lit(0), n - 1), lambda i: near(i) & (n > 1))


def without_double_points(faces: DataFrame, error: float = 0.01) -> DataFrame:
    """faces with doubled (how many were removed), ring without them, and repaired: three corners at least are left."""
    found = faces.withColumn("gone", double_points(F.col("ring"), error))
    kept = F.transform(
        F.filter(F.sequence(F.lit(0), F.size("ring") - 1), lambda i: ~F.array_contains("gone", i)), lambda i: F.col("ring")[i]
    )
    found = found.withColumn("doubled", F.size("gone")).withColumn("ring", F.when(F.col("doubled") == 0, F.col("ring")).otherwise(kept))
    return found.withColumn("repaired", F.size("ring") >= 3).drop("gone")


def _open(faces: DataFrame, snap: float) -> DataFrame:
    """mesh_id, face_id, idx, p, q, a, b of the edges without their opposite.

    The n-th of equal edges meets the n-th of the opposite ones, so those beyond the number of opposite ones are left:
    one shuffle by the edge, whichever way it runs, and no join.
    """
    key = lambda p: F.concat_ws("_", *(F.rint(F.col(p)[c] / snap).cast("long") for c in "xyz"))
    edges = face_edges(faces).select("*", key("p").alias("a"), key("q").alias("b")).where("a <> b")
    edges = edges.withColumns({"low": F.least("a", "b"), "high": F.greatest("a", "b"), "ahead": F.col("a") < F.col("b")})
    both = Window.partitionBy("mesh_id", "low", "high")
    nth = F.row_number().over(Window.partitionBy("mesh_id", "low", "high", "ahead").orderBy("face_id", "idx"))
    rows = edges.withColumn("nth", nth).withColumn("aheads", F.count_if("ahead").over(both)).withColumn("all", F.count("*").over(both))
    opposite = F.when(F.col("ahead"), F.col("all") - F.col("aheads")).otherwise(F.col("aheads"))
    # edges of no known mesh meet none
    return rows.where(F.col("mesh_id").isNull() | (F.col("nth") > opposite)).select("mesh_id", "face_id", "idx", "p", "q", "a", "b")


def open_edges(faces: DataFrame, snap: float = 0.001) -> DataFrame:
    """Edges without their opposite; none in a closed solid. End points are compared on a grid of snap."""
    return _open(faces, snap).select("mesh_id", "face_id", "idx", "a", "b")


def fan(ring: Column) -> Column:
    """The triangles of a convex ring."""
    return F.transform(F.sequence(F.lit(1), F.size(ring) - 2), lambda i: F.array(ring[0], ring[i], ring[i + 1]))


CHECKED = (
    "mesh_id long, face_id long, element string, ring array<struct<x:double,y:double,z:double>>, doubled int, repaired boolean,"
    " zero_area boolean, non_plane boolean, crossings int, touches int, status string"
)


def _points(rings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The corners of all rings (n x 3) and where each ring starts, with the end of the last one. A null ring is empty."""
    rings = pa.concat_arrays([rings])  # no offset
    sizes = np.array(pc.fill_null(pc.list_value_length(rings), 0), np.int64)
    flat = rings.flatten()
    xyz = np.column_stack([np.asarray(pc.fill_null(flat.field(k).cast(pa.float64()), np.nan)) for k in range(3)]) if len(flat) else np.empty((0, 3))
    return xyz, np.concatenate([[0], np.cumsum(sizes)])


def checked(faces: DataFrame, thick: float = 0.03, degrees: float = 20.0, same: float = 0.01) -> DataFrame:
    """The checks in order; each runs on what the ones before have let through. One row for each face, no shuffle.

    doubled corners are taken out of ring; a face with fewer than three corners left (a null ring, say) is an ERROR,
    one that crosses or touches itself a WARN. Faces of equally many corners are checked together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xyz, starts = _points(batch.column(3))
            n = np.diff(starts)
            owner = np.repeat(np.arange(len(n)), n)
            before = np.arange(len(xyz)) - 1
            firsts = starts[:-1][n > 0]
            before[firsts] = starts[1:][n > 0] - 1
            double = (np.abs(xyz - xyz[before]) < same).all(1) & (n[owner] > 1)
            doubled = np.bincount(owner, double, len(n)).astype(np.int32)
            xyz, owner = xyz[~double], owner[~double]
            n = n - doubled
            starts = np.concatenate([[0], np.cumsum(n)])
            found = {k: np.zeros(len(n), t) for k, t in (("zero_area", bool), ("non_plane", bool), ("crossings", np.int32), ("touches", np.int32))}
            for size in np.unique(n[n >= 3]):
                rows = np.flatnonzero(n == size)
                shape = kernels.shape_checks(xyz[starts[rows][:, None] + np.arange(size)], thick, degrees)
                for k, v in zip(found, shape, strict=True):
                    found[k][rows] = v
            status = np.where(n < 3, "ERROR", np.where(found["crossings"] + found["touches"] > 0, "WARN", "SUCCESS"))
            point = pa.StructArray.from_arrays([pa.array(xyz[:, k]) for k in range(3)], ["x", "y", "z"])
            rings = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), point).cast(batch.column(3).type)
            columns = [pa.array(doubled), pa.array(n >= 3), *map(pa.array, found.values()), pa.array(status.tolist(), pa.string())]
            names = [*batch.schema.names, "doubled", "repaired", *found, "status"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], rings, *columns], names=names)

    ring = F.transform("ring", lambda p: F.struct(*(p[k].cast("double").alias(k) for k in "xyz")))
    kept = faces.select(F.col("mesh_id").cast("long"), F.col("face_id").cast("long"), "element", ring.alias("ring"))
    return kept.mapInArrow(run, CHECKED)


def violations(checks: DataFrame) -> DataFrame:
    """(mesh_id, check, face_id) of what checked() found, and a text for each."""
    kinds = {
        "double_point": F.col("doubled") > 0, "zero_area": F.col("zero_area"), "non_plane": F.col("non_plane"),
        "self_intersection": F.col("crossings") + F.col("touches") > 0,
    }
    found = F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in kinds.items())))
    rows = checks.select("mesh_id", "face_id", F.explode(found).alias("check"))
    return rows.withColumn("message", F.concat_ws(": ", "mesh_id", "check", F.col("face_id").cast("string")))


def distinct_vertices(vertices: DataFrame) -> DataFrame:
    """vertices (mesh_id, idx, x, y, z) with first: the smallest index of an equal vertex."""
    return vertices.withColumn("first", F.min("idx").over(Window.partitionBy("mesh_id", "x", "y", "z")))


TRIANGLES = "mesh_id long, face_id long, part int, t array<double>"


def triangles(faces: DataFrame) -> DataFrame:
    """(mesh_id, face_id, part, t): the triangles of each face, as nine numbers; concave faces are clipped ear by ear, those of equally
    many corners together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xyz, starts = _points(batch.column(2))
            size = np.diff(starts)
            n = np.maximum(size - 2, 0)
            flat, first = np.empty((n.sum(), 9)), np.cumsum(n) - n
            for k in np.unique(size[size >= 3]):
                own = np.flatnonzero(size == k)
                found = kernels.triangles_of_all(xyz[starts[own][:, None] + np.arange(k)])
                flat[first[own][:, None] + np.arange(k - 2)] = found.reshape(len(own), k - 2, 9)
            at = np.repeat(np.arange(len(n)), n)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(n.sum() + 1) * 9, pa.int32()), pa.array(flat.reshape(-1)))
            part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            columns = [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(part.astype(np.int32)), rows]
            yield pa.RecordBatch.from_arrays(columns, names=["mesh_id", "face_id", "part", "t"])

    return faces.select(F.col("mesh_id").cast("long"), F.col("face_id").cast("long"), "ring").mapInArrow(run, TRIANGLES)


def crossing_faces(faces: DataFrame, size: float) -> DataFrame:
    """Pairs (mesh_id, a, b) of faces of a mesh whose triangles cut each other; faces that touch or share an edge do not.

    Boxes on cells of the given size find pairs of triangles, which meet in the cell of their overlap's lower corner
    only; Arrow batches of pairs are then tested at once, an edge of one against the inside of the other, both ways.
    """
    at = lambda k: F.array(F.col("t")[k], F.col("t")[3 + k], F.col("t")[6 + k])
    t = triangles(faces)
    for k, axis in enumerate("xyz"):
        t = t.withColumn(f"{axis}0", F.array_min(at(k))).withColumn(f"{axis}1", F.array_max(at(k)))
    cells = spatial.box_cells(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), size)
    t = t.withColumn("c", F.explode(cells)).select("*", "c.cx", "c.cy").drop("c", "part")
    other = t.select("mesh_id", "cx", "cy", *(F.col(c).alias(f"o_{c}") for c in t.columns if c not in ("mesh_id", "cx", "cy")))
    pairs = t.join(other.hint("merge"), ["mesh_id", "cx", "cy"]).where("face_id < o_face_id")
    pairs = pairs.where(" AND ".join(f"{k}0 <= o_{k}1 AND o_{k}0 <= {k}1" for k in "xyz"))
    low = [spatial.cell(F.greatest(f"{k}0", f"o_{k}0"), size) == F.col(f"c{k}") for k in "xy"]
    pairs = pairs.where(low[0] & low[1]).select("mesh_id", "face_id", "o_face_id", "t", "o_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, o = (np.asarray(batch.column(k).flatten()).reshape(-1, 3, 3) for k in (3, 4))
            hit = pa.array(kernels.triangles_cross(t, o))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(hit) for k in range(3)], names=["mesh_id", "a", "b"])

    return pairs.mapInArrow(run, "mesh_id long, a long, b long").distinct()


CLOSED = "mesh_id long, element string, ring array<struct<x:double,y:double,z:double>>"


def openings(faces: DataFrame, snap: float = 0.001) -> DataFrame:
    """(mesh_id, element, ring): a face for each opening of a mesh, none for a closed solid.

    Only edges without a plain opposite meet in a task, with what they are an edge of; one mesh is one group. element
    follows from the way that the new face looks.
    """
    own = _open(faces, snap)
    flat = [F.col(f"{e}.{k}").cast("double").alias(f"{e}{k}") for e in "pq" for k in "xyz"]

    def run(found: pa.Table) -> pa.Table:
        rows = np.column_stack([found.column(f"{e}{k}").to_numpy() for e in "pq" for k in "xyz"])
        order = np.lexsort((found.column("idx").to_numpy(), found.column("face_id").to_numpy()))
        rings = kernels.rings_of_edges([(tuple(r[:3]), tuple(r[3:])) for r in rows[order].tolist()], snap)
        rings = [(kernels.element_of(r), r) for r in rings if len(r) >= 3]
        rings = [(e, r) for e, r in rings if e]
        points = [[dict(zip("xyz", p, strict=True)) for p in r] for _, r in rings]
        kind = pa.list_(pa.struct([(k, pa.float64()) for k in "xyz"]))
        mesh = pa.array([found.column("mesh_id")[0].as_py()] * len(rings), pa.int64())
        return pa.Table.from_arrays([mesh, pa.array([e for e, _ in rings], pa.string()), pa.array(points, kind)], names=["mesh_id", "element", "ring"])

    slim = own.select(F.col("mesh_id").cast("long"), F.col("face_id").cast("long"), "idx", *flat)
    return slim.groupBy("mesh_id").applyInArrow(run, CLOSED)


def closed(faces: DataFrame, snap: float = 0.001) -> DataFrame:
    """faces (mesh_id, face_id, element, ring) with a face for each opening, numbered on; repaired tells those."""
    new = openings(faces, snap)
    last = faces.groupBy("mesh_id").agg(F.max("face_id").alias("last"))
    number = F.row_number().over(Window.partitionBy("mesh_id").orderBy("element", "ring"))
    new = new.withColumn("n", number).join(last.hint("merge"), "mesh_id")
    new = new.select("mesh_id", (F.col("last") + F.col("n")).alias("face_id"), "element", "ring", F.lit(True).alias("repaired"))
    return faces.select("mesh_id", "face_id", "element", "ring", F.lit(False).alias("repaired")).unionByName(new)


def planar(faces: DataFrame, checks: DataFrame) -> DataFrame:
    """Faces as triangles where checks found them non-plane, and as they are elsewhere; faces without area are left out.

    checks: what checked() gives, whose rings are used. part numbers a face's triangles, null for whole faces.
    """
    good = checks.where("repaired AND NOT zero_area")
    whole = good.where("NOT non_plane").select("mesh_id", "face_id", F.lit(None).cast("int").alias("part"), "element", "ring")
    bent = good.where("non_plane")
    point = lambda k: g.point(F.col("t")[3 * k], F.col("t")[3 * k + 1], F.col("t")[3 * k + 2])
    cut = triangles(bent).join(bent.select("mesh_id", "face_id", "element"), ["mesh_id", "face_id"])
    cut = cut.select("mesh_id", "face_id", "part", "element", F.array(*map(point, range(3))).alias("ring"))
    return whole.unionByName(cut)
