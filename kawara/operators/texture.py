"""Photo selection and texture statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kawara.functions import geometry as g
from kawara.operators import spatial
from kawara.operators.spatial import _cut


def best_photo(views: DataFrame) -> DataFrame:
    """For each face the photo in which all its corners are visible and its area is largest; the last of equals.

    views: face_id, photo_no, visible, area.
    """
    order = Window.partitionBy("face_id").orderBy(F.desc("area"), F.desc("photo_no"))
    ranked = views.where("visible").withColumn("rank", F.row_number().over(order))
    return ranked.where("rank = 1").select("face_id", "photo_no", "area")


def face_views(faces: DataFrame, photos: DataFrame) -> DataFrame:
    """Each face in each photo: visible (all corners) and its area in pixels. photos are broadcast in counted blocks.

    photos: photo_no, x0, y0, z0, omega, phi, kappa, focal, pixel, width, height.
    """
    pairs = spatial.crossed(faces.select("face_id", "ring"), photos)
    matrix = [c.alias(f"m{i}") for i, c in enumerate(g.rotation_matrix(F.col("omega"), F.col("phi"), F.col("kappa")))]
    pairs = pairs.select("*", *matrix)
    camera = g.point(F.col("x0"), F.col("y0"), F.col("z0"))
    m = [F.col(f"m{i}") for i in range(9)]
    seen = F.transform("ring", lambda p: g.projected(p, camera, m, F.col("focal"), F.col("pixel"), F.col("width"), F.col("height")))
    pairs = pairs.withColumn("seen", seen)
    flat = F.transform("seen", lambda s: g.point(s["u"], s["v"]))
    return pairs.select("face_id", "photo_no", F.forall("seen", lambda s: s["visible"]).alias("visible"), g.area(flat).alias("area"))


def roof_of_wall(corners: DataFrame) -> DataFrame:
    """(wall, roof): the highest roof that shares at least two corners with a wall. corners: face_id, element, x, y, z.

    Faces with the same corners share the same ones, so one wall of each kind is compared, with the first roof of each.
    """
    kinds = corners.where(F.col("element").isin("ROOF", "WALL")).groupBy("element", "face_id")
    kinds = kinds.agg(F.array_sort(F.collect_list(F.struct("x", "y", "z"))).alias("ring"), F.max("z").alias("top"))
    roofs, walls = (kinds.where(F.col("element") == e) for e in ("ROOF", "WALL"))
    first = _cut(roofs.groupBy("ring", "top").agg(F.min("face_id").alias("roof")))
    kept = _cut(walls.groupBy("ring").agg(F.min("face_id").alias("wall"), F.collect_list("face_id").alias("walls")))
    at = lambda rows, face: rows.select(face, F.explode("ring").alias("p")).select(face, "p.*")
    shared = at(kept, "wall").join(at(first, "roof").hint("merge"), ["x", "y", "z"])
    pairs = shared.groupBy("wall", "roof").count().where("count > 1").join(first.select("roof", "top"), "roof")
    best = pairs.groupBy("wall").agg(F.max_by("roof", F.struct("top", -F.col("roof"))).alias("roof"))
    return kept.select("wall", "walls").join(best, "wall").select(F.explode("walls").alias("wall"), "roof")


def is_usable_wall(width: Column, height: Column) -> Column:
    return width.between(16, 256) & height.between(16, 256)


def balconies(pixels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """polygon_id and whether at least the threshold of its pixels are balcony."""
    share = F.avg(F.col("is_balcony").cast("int"))
    return pixels.groupBy("polygon_id").agg((share >= threshold).alias("balcony"))


def best_wall_photo(views: DataFrame, roofs: DataFrame) -> DataFrame:
    """(face_id, photo_no, area): for each wall the photo that shows it whole, and its roof too where it has one; the
    largest area, the last of equals. views: as for best_photo, of walls and roofs; roofs: wall, roof (see roof_of_wall)."""
    seen = views.where("visible").select(F.col("face_id").alias("roof"), "photo_no", F.lit(True).alias("roof_seen"))
    rows = views.join(roofs.select(F.col("wall").alias("face_id"), "roof"), "face_id", "left").join(seen, ["roof", "photo_no"], "left")
    good = rows.withColumn("visible", F.col("visible") & (F.col("roof").isNull() | F.coalesce("roof_seen", F.lit(False))))
    return best_photo(good.select("face_id", "photo_no", "visible", "area"))


def photo_cameras(photos: DataFrame, camera: DataFrame, strict: bool = True) -> DataFrame:
    """photos (with width and height in pixels) beside the camera (focal, sensor_w, sensor_h, pixel_w, pixel_h), with
    pixel: its size as the sensor's width over the image's. A photo whose sensor is off by more than a pixel from what
    the pixel sizes say has fits false."""
    rows = spatial.crossed(photos, camera)
    fits = (F.abs(F.col("sensor_w") - F.col("width") * F.col("pixel_w")) <= F.col("pixel_w")) & (F.abs(F.col("sensor_h") - F.col("height") * F.col("pixel_h")) <= F.col("pixel_h"))
    return rows.withColumn("pixel", F.col("sensor_w") / F.col("width")).withColumn("fits", fits)
