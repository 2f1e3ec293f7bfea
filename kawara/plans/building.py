"""Heights, roll-ups and the flagship plan over buildings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kawara.functions import geometry as g
from kawara.operators import spatial


def box_ring(x0: str, y0: str, x1: str, y1: str) -> Column:
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    return F.array(*(g.point(F.col(a), F.col(b)) for a, b in corners))


def ground_points(points: DataFrame, footprints: DataFrame, ring_width: float = 1.0) -> DataFrame:
    """points (building_id, x, y, z) in the ring around their building's box footprint, not in it (borders excluded)."""
    rows = points.join(footprints, "building_id")
    outer = (F.col("x") > F.col("x0") - ring_width) & (F.col("x") < F.col("x1") + ring_width)
    outer &= (F.col("y") > F.col("y0") - ring_width) & (F.col("y") < F.col("y1") + ring_width)
    inner = (F.col("x") > F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") > F.col("y0")) & (F.col("y") < F.col("y1"))
    return rows.where(outer & ~inner)


def ground_heights(ground: DataFrame) -> DataFrame:
    """(building_id, min_z, mode_z): mode_z is the mid of the fullest bin of the lower half of the heights.

    Bins are about a metre wide, at least two, the last one closed, the first of equals wins.
    """
    by = Window.partitionBy("building_id")
    low = F.min("z").over(by)
    half = ground.withColumn("low", low).withColumn("half", (low + F.max("z").over(by)) / 2).where("z <= half")
    half = half.withColumn("top", F.max("z").over(by))
    bins = F.greatest(F.lit(2), F.floor(F.col("top") - F.col("low") + 0.5).cast("int"))
    half = half.withColumn("bins", bins)
    width = F.when(F.col("top") > F.col("low"), F.col("top") - F.col("low")).otherwise(F.lit(1.0)) / F.col("bins")
    half = half.withColumn("width", width).withColumn(
        "bin", F.least(F.floor((F.col("z") - F.col("low")) / F.col("width")).cast("int"), F.col("bins") - 1)
    )
    counts = half.groupBy("building_id", "bin").agg(F.count("*").alias("n"), F.first("low").alias("low"), F.first("width").alias("width"))
    mode = F.max_by(F.col("low") + (F.col("bin") + 0.5) * F.col("width"), F.struct("n", -F.col("bin")))
    return counts.groupBy("building_id").agg(F.first("low").alias("min_z"), mode.alias("mode_z"))


def roof_percentiles(points: DataFrame, ground: DataFrame, above: float = 2.0) -> DataFrame:
    """(building_id, p25, p90) of the heights over ground + above, or of all where none is. ground: building_id, min_z."""
    rows = points.join(ground.select("building_id", "min_z"), "building_id")
    high = F.when(F.col("z") > F.col("min_z") + above, F.col("z"))
    pick = lambda q: F.coalesce(F.percentile(high, F.lit(q)), F.percentile("z", F.lit(q)))
    return rows.groupBy("building_id").agg(pick(0.25).alias("p25"), pick(0.9).alias("p90"))


def building_status(texture: Column, self_crossing: Column, face_crossing: Column) -> Column:
    """SUCCESS, WARN or ERROR of a building: texture that failed or was skipped is an error, a crossing a warning."""
    bad = texture.isin("ERROR", "SKIP")
    warn = (texture == "WARN") | (self_crossing != "SUCCESS") | (face_crossing != "SUCCESS")
    return F.when(bad, "ERROR").when(warn, "WARN").otherwise("SUCCESS")


def write_summary(rows: DataFrame, path: str) -> None:
    """One CSV file with a header: a row for each building."""
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)


def building_heights(points: DataFrame, footprints: DataFrame, size: float = 16.0) -> DataFrame:
    """For each building: points in the footprint, lowest ground and most frequent ground height (null without ground)."""
    polygons = footprints.withColumn("ring", box_ring("x0", "y0", "x1", "y1"))
    inside = spatial.points_in_polygons(points, polygons.select("building_id", "ring"), size, ("building_id",))
    n = inside.groupBy("building_id").agg(F.count("*").alias("n_points"))
    heights = ground_heights(ground_points(points, footprints))
    rows = footprints.select("building_id").join(n, "building_id", "left").join(heights, "building_id", "left")
    return rows.select("building_id", F.coalesce("n_points", F.lit(0)).alias("n_points"), "min_z", "mode_z")
