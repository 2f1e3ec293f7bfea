"""Camera, orientation, world-file and parameter readers."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kawara.operators import spatial

ORIENTATION = "file string, x double, y double, z double, omega double, phi double, kappa double"


def read_orientation(spark: SparkSession, path: str) -> DataFrame:
    """Exterior orientation: tab-separated with a header; rows with an empty field are dropped."""
    rows = spark.read.csv(path, sep="\t", header=True, schema=ORIENTATION)
    return rows.dropna()


def read_camera(spark: SparkSession, path: str) -> DataFrame:
    """Focal length, sensor and pixel sizes and principal point: the line after the header."""
    names = ["focal", "sensor_w", "sensor_h", "pixel_w", "pixel_h", "ppx", "ppy"]
    return spark.read.csv(path, sep="\t", header=True, schema=", ".join(f"{n} double" for n in names)).limit(1)


def read_world_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, a, d, b, e, c, f): the six lines of each world file; files with other contents have nulls."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split(F.trim("value"), r"\s+").alias("v"))
    return files.select("path", *(F.get("v", F.lit(i)).try_cast("double").alias(n) for i, n in enumerate("adbecf")))


def image_at(points: DataFrame, images: DataFrame) -> DataFrame:
    """points (id, x, y) with the first image (image_no, a, e, c, f, width, height) that covers each.

    Images are dealt over square cells as wide as the widest of them, so that points meet the few images over their
    cell by an equi-join.
    """
    size = images.agg(F.max(F.greatest(F.abs(F.col("a") * F.col("width")), F.abs(F.col("e") * F.col("height"))))).first()[0]
    if not size:
        return points.select("id", F.lit(None).cast(images.schema["image_no"].dataType).alias("image_no")).limit(0)
    x1, y1 = F.col("c") + F.col("a") * F.col("width"), F.col("f") + F.col("e") * F.col("height")
    cells = spatial.box_cells(F.least("c", x1), F.least("f", y1), F.greatest("c", x1), F.greatest("f", y1), size)
    images = images.withColumn("cell", F.explode(cells)).select("*", "cell.cx", "cell.cy").drop("cell")
    col, row = (F.col("x") - F.col("c")) / F.col("a"), (F.col("y") - F.col("f")) / F.col("e")
    inside = (col >= 0) & (col < F.col("width")) & (row >= 0) & (row < F.col("height"))
    return spatial.with_cell(points, size).join(images, ["cx", "cy"]).where(inside).groupBy("id").agg(F.min("image_no").alias("image_no"))


@dataclass(frozen=True)
class PhaseChecks:
    delete_error_object: bool
    non_plane_thickness: float
    non_plane_angle: float


class ParameterError(ValueError):
    pass


def read_parameters(text: str, kind: type):
    """A frozen dataclass from a JSON object: every field is required, typed, and no other key is allowed."""
    try:
        data = json.loads(text)
    except json.JSONDecodeError as e:
        raise ParameterError(f"not JSON: {e}") from None
    known = {f.name: f.type for f in fields(kind)}
    if not isinstance(data, dict) or set(data) != set(known):
        raise ParameterError(f"keys have to be {sorted(known)}")
    for name, wanted in known.items():
        value = data[name]
        good = {"bool": isinstance(value, bool), "float": isinstance(value, int | float) and not isinstance(value, bool), "int": isinstance(value, int) and not isinstance(value, bool), "str": isinstance(value, str)}
        if not good.get(wanted, True):
            raise ParameterError(f"{name} has to be a {wanted}")
    return kind(**data)


def zone_number(value: Column) -> Column:
    """A plane rectangular zone, null outside 1 to 19."""
    return F.when(value.between(1, 19), value)


@dataclass(frozen=True)
class Atlas:
    input_folder: str
    output_folder: str
    width: int
    height: int
    background: str
    margin: int


@dataclass(frozen=True)
class Enlarging:
    input_folder: str
    output_folder: str
    gsd: float
    device: str


def read_atlas(data: bytes) -> Atlas:
    """Parameters of the atlas layout, from JSON in Shift-JIS; sizes have to be positive."""
    try:
        found = read_parameters(data.decode("shift_jis"), Atlas)
    except UnicodeDecodeError as e:
        raise ParameterError(f"not Shift-JIS: {e}") from None
    if min(found.width, found.height) <= 0 or found.margin < 0:
        raise ParameterError("width and height have to be positive, the margin not negative")
    return found


def read_enlarging(text: str) -> Enlarging:
    """Parameters of image enlarging; the ground sampling distance has to lie in 0.1 to 0.25."""
    found = read_parameters(text, Enlarging)
    if not 0.1 <= found.gsd <= 0.25:
        raise ParameterError("gsd has to be from 0.1 to 0.25")
    return found
