"""Kernels over groups of rows: one building (thousands of rows) at a time, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kawara.operators import kernels


def heights_clustered(points: DataFrame, band: float, digits: int = 2) -> DataFrame:
    """(building_id, z, cluster): mean shift over each building's heights.

    Heights are counted at a resolution of digits first, so a building's group is its histogram, not its points.
    """
    counts = points.groupBy("building_id", F.round("z", digits).alias("z")).agg(F.count("*").alias("n"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("z")
        labels = kernels.mean_shift(rows.z.to_numpy(), rows.n.to_numpy(float), band)
        return pd.DataFrame({"building_id": rows.building_id, "z": rows.z, "n": rows.n, "cluster": labels})

    return counts.groupBy("building_id").applyInPandas(run, "building_id long, z double, n long, cluster int")


def seeds_merged(clusters: DataFrame, most: float) -> DataFrame:
    """clusters (key, seq, mean) with grp: greedy merging against the seed, in order of seq."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        return rows.assign(grp=kernels.seed_merged(rows["mean"], most))

    return clusters.select("key", "seq", "mean").groupBy("key").applyInPandas(run, "key long, seq long, mean double, grp int")


def triangulated(faces: DataFrame, best: bool = False) -> DataFrame:
    """(mesh_id, face_id, a, b, c) corner indexes of plane faces (ring of x, y): ear clipping, or the shortest diagonals."""
    cut = kernels.triangulated if best else kernels.ear_clipped

    def run(batches):
        for rows in batches:
            out = [
                (m, f, *t)
                for m, f, ring in zip(rows.mesh_id, rows.face_id, rows.ring, strict=True)
                for t in cut([(p["x"], p["y"]) for p in ring])
            ]
            yield pd.DataFrame(out, columns=["mesh_id", "face_id", "a", "b", "c"])

    return faces.select("mesh_id", "face_id", "ring").mapInPandas(run, "mesh_id long, face_id long, a int, b int, c int")


def packed(rects: DataFrame, most: int) -> DataFrame:
    """rects (atlas, seq, building, w, h) with page, x, y: one atlas is one group, in order of seq."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        found = kernels.bottom_left_packed(list(zip(rows.building, rows.w, rows.h, strict=True)), most)
        columns = np.array([p or (-1, -1, -1) for p in found]).reshape(-1, 3)
        return rows.assign(page=columns[:, 0], x=columns[:, 1], y=columns[:, 2])

    kept = rects.select("atlas", "seq", "building", "w", "h")
    return kept.groupBy("atlas").applyInPandas(run, "atlas long, seq long, building string, w int, h int, page int, x int, y int")


def shelved(rects: DataFrame, width: int) -> DataFrame:
    """rects (atlas, seq, w, h) with x, y and the page's size."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        places, page_w, page_h = kernels.shelf_packed(list(zip(rows.w, rows.h, strict=True)), width)
        return rows.assign(x=[p[0] for p in places], y=[p[1] for p in places], page_w=page_w, page_h=page_h)

    kept = rects.select("atlas", "seq", "w", "h")
    return kept.groupBy("atlas").applyInPandas(run, "atlas long, seq long, w int, h int, x int, y int, page_w int, page_h int")


def verticality(neighbours: DataFrame) -> DataFrame:
    """(id, planarity, linearity, verticality) from pairs (id, nx, ny, nz) of a point and those in its radius.

    Sums for the covariance are aggregated in Spark; only the 3 x 3 eigenvectors are Python.
    """
    axes = ("nx", "ny", "nz")
    sums = [F.avg(a).alias(f"m_{a}") for a in axes]
    sums += [F.avg(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(axes) for b in axes[i:]]
    rows = neighbours.groupBy("id").agg(F.count("*").alias("n"), *sums)

    def run(batches):
        for r in batches:
            mean = r[[f"m_{a}" for a in axes]].to_numpy()
            cov = np.zeros((len(r), 3, 3))
            for i, a in enumerate(axes):
                for j, b in enumerate(axes[i:], i):
                    cov[:, i, j] = cov[:, j, i] = r[f"{a}_{b}"] - mean[:, i] * mean[:, j]
            values, vectors = np.linalg.eigh(cov)
            root = np.sqrt(values.clip(0))
            top = np.where(root[:, 2] > 0, root[:, 2], 1)
            yield pd.DataFrame({
                "id": r.id, "planarity": (root[:, 1] - root[:, 0]) / top, "linearity": (root[:, 2] - root[:, 1]) / top,
                "verticality": 1 - np.abs(vectors[:, 2, 0]),
            })

    return rows.mapInPandas(run, "id long, planarity double, linearity double, verticality double")


def simplified(faces: DataFrame, least: float = 1e-4) -> DataFrame:
    """faces (mesh_id, face_id, ring of x, y) without the corners at which a ring runs straight on."""

    def run(batches):
        for rows in batches:
            rings = [[{"x": x, "y": y} for x, y in kernels.simplified([(p["x"], p["y"]) for p in ring], least)] for ring in rows.ring]
            yield pd.DataFrame({"mesh_id": rows.mesh_id, "face_id": rows.face_id, "ring": rings})

    ring = F.transform("ring", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return faces.select("mesh_id", "face_id", ring.alias("ring")).mapInPandas(run, "mesh_id long, face_id long, ring array<struct<x:double,y:double>>")


def roofs_triangulated(faces: DataFrame) -> DataFrame:
    """(mesh_id, face_id, a, b, c) corner indexes of rings in space, so that the triangles bend least.

    Rings of equally many corners are cut together.
    """

    def run(batches):
        for rows in batches:
            size = rows.ring.map(len).to_numpy()
            for n in np.unique(size[size >= 3]):
                own = rows[size == n]
                rings = np.array([[(p["x"], p["y"], p["z"]) for p in ring] for ring in own.ring], float)
                found = kernels.triangulated_3d_all(rings)
                columns = {c: found[:, k + 1] for k, c in enumerate("abc")}
                yield pd.DataFrame({"mesh_id": own.mesh_id.to_numpy()[found[:, 0]], "face_id": own.face_id.to_numpy()[found[:, 0]], **columns})

    return faces.select("mesh_id", "face_id", "ring").mapInPandas(run, "mesh_id long, face_id long, a int, b int, c int")


def plane_faces(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(building_id, face, outer, corners): the faces of each building's plane graph; the outer one has the largest area
    and runs clockwise. nodes: building_id, node, x, y; edges: building_id, a, b."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("node").reset_index(drop=True)
        place = {n: i for i, n in enumerate(left.node)}
        points = list(zip(left.x, left.y, strict=True))
        rings = kernels.planar_faces(points, [(place[a], place[b]) for a, b in zip(right.a, right.b, strict=True)])
        size = [kernels.signed_area(np.array([points[i] for i in r])) for r in rings]
        rows = [(left.building_id[0], k, size[k] < 0, [int(left.node[i]) for i in r]) for k, r in enumerate(rings)]
        return pd.DataFrame(rows, columns=["building_id", "face", "outer", "corners"])

    kept = nodes.select("building_id", "node", "x", "y").groupBy("building_id")
    pairs = kept.cogroup(edges.select(*(F.col(c).alias(c) for c in ("building_id", "a", "b"))).groupBy("building_id"))
    return pairs.applyInPandas(run, "building_id long, face int, outer boolean, corners array<long>")
