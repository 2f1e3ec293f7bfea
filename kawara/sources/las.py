"""LAS point clouds as a batch data source: format("las"), columns x, y, z, red, green, blue."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte offset of the colours in a point record, by point format.
COLOUR_AT = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}
POINTS = pa.schema([(n, pa.float64()) for n in ("x", "y", "z")] + [(n, pa.int32()) for n in ("red", "green", "blue")])
SCHEMA = "path string, x double, y double, z double, red int, green int, blue int"


class LasError(ValueError):
    pass


def header(data: bytes) -> dict:
    if data[:4] != b"LASF" or len(data) < 227:
        raise LasError("not a LAS file")
    offset, _, kind, size, count = struct.unpack_from("<IIBHI", data, 96)
    scale, shift = struct.unpack_from("<3d", data, 131), struct.unpack_from("<3d", data, 155)
    x1, x0, y1, y0, z1, z0 = struct.unpack_from("<6d", data, 179)
    if data[25] >= 4 and not count:
        count = struct.unpack_from("<Q", data, 247)[0]
    return {"offset": offset, "format": kind & 0x3F, "size": size, "count": count, "scale": scale, "shift": shift, "min": (x0, y0, z0), "max": (x1, y1, z1)}


def points(data: bytes) -> pa.RecordBatch:
    """The points of a file. Colours of 8 bits are raised to 16."""
    h = header(data)
    if h["format"] not in COLOUR_AT:
        raise LasError(f"point format {h['format']} has no colours")
    at = COLOUR_AT[h["format"]]
    kind = np.dtype({"names": ["p", "c"], "formats": ["<3i4", "<3u2"], "offsets": [0, at], "itemsize": h["size"]})
    rows = np.frombuffer(data, kind, h["count"], h["offset"])
    xyz = rows["p"] * np.array(h["scale"]) + np.array(h["shift"])
    rgb = rows["c"].astype(np.int32)
    if len(rgb) and rgb.max() < 256:
        rgb = rgb * 256
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (*xyz.T, *rgb.T)], schema=POINTS)


def _read(spark: SparkSession, path: str, swap_xy: bool) -> DataFrame:
    """The points of all files, and for a file without any, or that cannot be read, a row of nulls with its error."""
    names = ["path", *POINTS.names, "error"]
    kinds = [pa.string(), *POINTS.types, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = points(data)
                except (LasError, ValueError, struct.error) as e:
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip([name, *[None] * 6, str(e)], kinds, strict=True)], names=names)
                    continue
                if swap_xy:
                    found = found.select(["y", "x", "z", "red", "green", "blue"]).rename_columns(POINTS.names)
                if not (n := len(found)):  # an empty file is a row of nulls, so that its status is known
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip([name, *[None] * 7], kinds, strict=True)], names=names)
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), *found.columns, pa.nulls(n, pa.string())], names=names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, f"{SCHEMA}, error string")


def read_las(spark: SparkSession, path: str, swap_xy: bool = False) -> DataFrame:
    """Files are read by Spark (any file system), decoded whole in Arrow batches; those that cannot be read are skipped
    (tile_status tells which)."""
    return _read(spark, path, swap_xy).where("x IS NOT NULL").drop("error")


def tile_status(spark: SparkSession, path: str) -> DataFrame:
    """(path, points, status, message): a file that cannot be read is a WARN."""
    rows = _read(spark, path, False).groupBy("path").agg(F.count("x").alias("points"), F.max("error").alias("message"))
    return rows.select("path", "points", F.when(F.col("message").isNull(), "SUCCESS").otherwise("WARN").alias("status"), "message")


def tiles(spark: SparkSession, path: str) -> DataFrame:
    """(path, min_x, min_y, max_x, max_y, status) from the headers; a file without one is a WARN, with a null box."""

    def run(batches):
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    h = header(data)
                    rows.append((name, *h["min"][:2], *h["max"][:2], "SUCCESS"))
                except (LasError, struct.error):
                    rows.append((name, None, None, None, None, "WARN"))
            names = ["path", "min_x", "min_y", "max_x", "max_y", "status"]
            kinds = [pa.string(), *[pa.float64()] * 4, pa.string()]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, 400).alias("head"))
    return files.mapInArrow(run, "path string, min_x double, min_y double, max_x double, max_y double, status string")


def las_bytes(xyz: np.ndarray, rgb: np.ndarray, classes: np.ndarray | None = None, step: float = 0.001) -> bytes:
    """A LAS 1.2 file of point format 2. Coordinates are whole steps from the smallest ones; colours have 16 bits."""
    n = len(xyz)
    low, high = (xyz.min(0), xyz.max(0)) if n else (np.zeros(3), np.zeros(3))
    head = bytearray(227)
    head[:4], head[24:26] = b"LASF", bytes([1, 2])
    struct.pack_into("<HIIBHI", head, 94, 227, 227, 0, 2, 26, n)
    struct.pack_into("<3d3d", head, 131, *[step] * 3, *low)
    struct.pack_into("<6d", head, 179, high[0], low[0], high[1], low[1], high[2], low[2])
    kind = np.dtype({"names": ["p", "class", "c"], "formats": ["<3i4", "u1", "<3u2"], "offsets": [0, 15, 20], "itemsize": 26})
    rows = np.zeros(n, kind)
    rows["p"], rows["c"] = np.rint((xyz - low) / step), rgb
    if classes is not None:
        rows["class"] = classes
    return bytes(head) + rows.tobytes()


def las_files(points: DataFrame) -> DataFrame:
    """(path, content): a LAS file for each path of points (path, x, y, z, red, green, blue)."""

    def run(rows: pa.Table) -> pa.Table:
        xyz = np.column_stack([rows.column(k).to_numpy() for k in "xyz"])
        rgb = np.column_stack([rows.column(k).to_numpy() for k in ("red", "green", "blue")])
        order = np.lexsort((xyz[:, 2], xyz[:, 1], xyz[:, 0]))
        return pa.table({"path": [rows.column("path")[0].as_py()], "content": pa.array([las_bytes(xyz[order], rgb[order])], pa.binary())})

    kept = points.select("path", *(F.col(k).cast("double") for k in "xyz"), *(F.col(k).cast("int") for k in ("red", "green", "blue")))
    return kept.groupBy("path").applyInArrow(run, "path string, content binary")
