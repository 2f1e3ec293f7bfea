"""Rasters of buildings: pixel coordinates as columns, fills and decompositions as kernels over one building."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kawara.operators import kernels


def ortho_pixels(points: DataFrame, size: float, keys: tuple[str, ...]) -> DataFrame:
    """points (keys, x, y, ...) with col, row and the raster's origin (left, top), a multiple of size per group.

    Halves round to even; row 0 is the largest y.
    """
    edge = points.groupBy(*keys).agg((F.floor(F.min("x") / size) * size).alias("left"), (F.ceil(F.max("y") / size) * size).alias("top"))
    rows = points.join(edge, list(keys))
    col, row = F.rint((F.col("x") - F.col("left")) / size), F.rint((F.col("y") - F.col("top")) / -size)
    return rows.withColumn("col", col.cast("int")).withColumn("row", row.cast("int"))


def to_geo(pixels: DataFrame, size: float) -> DataFrame:
    """pixels (col, row, left, top, ...) with gx and gy, in single precision."""
    gx = (F.col("col").cast("float") * F.lit(size).cast("float") + F.col("left").cast("float")).cast("float")
    gy = (F.col("row").cast("float") * F.lit(-size).cast("float") + F.col("top").cast("float")).cast("float")
    return pixels.withColumn("gx", gx).withColumn("gy", gy)


def extent(pixels: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, min_col, min_row, width, height): the last pixel counts."""
    size = lambda c: (F.max(c) - F.min(c) + 1).cast("int")
    return pixels.groupBy(*keys).agg(F.min("col").alias("min_col"), F.min("row").alias("min_row"), size("col").alias("width"), size("row").alias("height"))


def last_write(pixels: DataFrame, keys: tuple[str, ...], value: str, order: str) -> DataFrame:
    """(keys, col, row, value): of the points on a pixel the last one in order."""
    return pixels.groupBy(*keys, "col", "row").agg(F.max_by(value, order).alias(value))


def missing_neighbour(pixels: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The pixels (keys, col, row) of a mask that miss one of their eight neighbours."""
    own = pixels.select(*keys, "col", "row").distinct()
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j))
    wanted = own.withColumn("o", F.explode(around)).select(
        *keys, F.col("col").alias("own_col"), F.col("row").alias("own_row"), (F.col("col") + F.col("o.i")).alias("col"), (F.col("row") + F.col("o.j")).alias("row")
    )
    found = wanted.join(own, [*keys, "col", "row"], "left_semi").groupBy(*keys, "own_col", "own_row").count()
    full = found.where("count = 8").select(*keys, F.col("own_col").alias("col"), F.col("own_row").alias("row"))
    return own.join(full, [*keys, "col", "row"], "left_anti")


def _grouped(rows: DataFrame, key: str, schema: str, make) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(found: pa.Table) -> pa.Table:
        columns = make(found)
        n = max((len(c) for c in columns.values()), default=0)
        columns[key] = [found.column(key)[0].as_py()] * n
        return pa.Table.from_arrays([pa.array(columns[f.name], f.type) for f in target], schema=target)

    return rows.groupBy(key).applyInArrow(run, schema)


def filled(pixels: DataFrame, largest: int = 4096) -> DataFrame:
    """(building_id, col, row, value): every pixel of each building's raster takes the value of its nearest point, the
    smallest pid of equals. pixels: building_id, pid, col, row (from 0), value. Rasters over largest a side are left out."""

    def make(found: pa.Table) -> dict:
        col, row, pid, value = (found.column(c).to_numpy() for c in ("col", "row", "pid", "value"))
        width, height = int(col.max()) + 1, int(row.max()) + 1
        if max(width, height) > largest:
            return {"col": [], "row": [], "value": []}
        order = np.argsort(pid, kind="stable")
        # of the points on one pixel only the first matters
        _, first = np.unique(row[order].astype(np.int64) * width + col[order], return_index=True)
        kept = order[np.sort(first)]
        near = kept[kernels.nearest_filled(col[kept], row[kept], width, height)]
        y, x = np.indices((height, width))
        return {"col": x.ravel(), "row": y.ravel(), "value": value[near.ravel()]}

    kept = pixels.select("building_id", F.col("pid").cast("long"), F.col("col").cast("int"), F.col("row").cast("int"), F.col("value").cast("double"))
    return _grouped(kept, "building_id", "building_id long, col int, row int, value double", make)


def decomposed(pixels: DataFrame, least: int) -> DataFrame:
    """(building_id, seq, x0, y0, x1, y1): the boxes that each building's mask of pixels (building_id, col, row) is made of."""

    def make(found: pa.Table) -> dict:
        col, row = (found.column(c).to_numpy() for c in ("col", "row"))
        mask = np.zeros((int(row.max() - row.min()) + 1, int(col.max() - col.min()) + 1), bool)
        mask[row - row.min(), col - col.min()] = True
        boxes = np.array(kernels.rectangles(mask, least), int).reshape(-1, 4) + np.array([col.min(), row.min()] * 2)
        return {"seq": np.arange(len(boxes)), **{k: boxes[:, i] for i, k in enumerate(("x0", "y0", "x1", "y1"))}}

    kept = pixels.select("building_id", F.col("col").cast("int"), F.col("row").cast("int")).distinct()
    return _grouped(kept, "building_id", "building_id long, seq int, x0 int, y0 int, x1 int, y1 int", make)


def mask_parts(pixels: DataFrame) -> DataFrame:
    """(building_id, col, row, part): 4-connected parts of each building's mask, from 1 in scan order."""

    def make(found: pa.Table) -> dict:
        col, row = (found.column(c).to_numpy() for c in ("col", "row"))
        mask = np.zeros((int(row.max() - row.min()) + 1, int(col.max() - col.min()) + 1), bool)
        mask[row - row.min(), col - col.min()] = True
        return {"col": col, "row": row, "part": kernels.mask_components(mask)[row - row.min(), col - col.min()]}

    kept = pixels.select("building_id", F.col("col").cast("int"), F.col("row").cast("int")).distinct()
    return _grouped(kept, "building_id", "building_id long, col int, row int, part int", make)


def turned(pixels: DataFrame, radian: float, keys: tuple[str, ...]) -> DataFrame:
    """pixels (keys, col, row, ...) with tcol and trow: turned about the origin, moved so that both start at 0, to whole
    pixels; untwisted() goes back."""
    c, s = float(np.cos(radian)), float(np.sin(radian))
    x, y = F.col("col") * c - F.col("row") * s, F.col("col") * s + F.col("row") * c
    rows = pixels.withColumn("tx", x).withColumn("ty", y)
    by = Window.partitionBy(*keys)
    rows = rows.withColumn("tx0", F.floor(F.min("tx").over(by))).withColumn("ty0", F.floor(F.min("ty").over(by)))
    return rows.withColumn("tcol", F.rint(F.col("tx") - F.col("tx0")).cast("int")).withColumn("trow", F.rint(F.col("ty") - F.col("ty0")).cast("int")).drop("tx", "ty")


def untwisted(pixels: DataFrame, radian: float) -> DataFrame:
    """pixels (tcol, trow, tx0, ty0, ...) with bx and by: where the turned pixel came from."""
    c, s = float(np.cos(radian)), float(np.sin(radian))
    x, y = F.col("tcol") + F.col("tx0"), F.col("trow") + F.col("ty0")
    return pixels.withColumn("bx", x * c + y * s).withColumn("by", y * c - x * s)
