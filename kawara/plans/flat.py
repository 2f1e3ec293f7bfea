"""Block models of all buildings at once: heights, faces, checks and a status for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kawara.functions import geometry as g
from kawara.operators import mesh, modeling
from kawara.plans import building


def blocks(points: DataFrame, footprints: DataFrame) -> DataFrame:
    """(building_id, ring, bottom, top, status): from the most frequent ground height to the 90th percentile of the roof's
    points. A building without ground or without points over it is an ERROR, and does not stop the others."""
    low = building.ground_heights(building.ground_points(points, footprints))
    top = building.roof_percentiles(points, low).select("building_id", F.col("p90").alias("top"))
    rows = footprints.withColumn("ring", building.box_ring("x0", "y0", "x1", "y1")).select("building_id", "ring")
    rows = rows.join(low.select("building_id", F.col("mode_z").alias("bottom")), "building_id", "left").join(top, "building_id", "left")
    good = F.col("bottom").isNotNull() & F.col("top").isNotNull() & (F.col("top") > F.col("bottom"))
    return rows.withColumn("status", F.when(good, "SUCCESS").otherwise("ERROR"))


def models(made: DataFrame) -> DataFrame:
    """The faces (mesh_id, face_id, element, ring) of all sound blocks, with openings closed."""
    return mesh.closed(modeling.extruded(made.where("status = 'SUCCESS'"))).drop("repaired")


def report(made: DataFrame, faces: DataFrame) -> DataFrame:
    """(building_id, status, faces, area): a building whose faces fail a check is a WARN; area is that of its roofs."""
    checks = mesh.checked(faces).where("status <> 'SUCCESS' OR zero_area OR non_plane").select("mesh_id").distinct().withColumn("bad", F.lit(True))
    roof = F.when(F.col("element") == "ROOF", g.area(F.col("ring"))).otherwise(0.0)
    sums = faces.groupBy("mesh_id").agg(F.count("*").alias("faces"), F.sum(roof).alias("area")).join(checks, "mesh_id", "left")
    rows = made.select("building_id", "status").join(sums.withColumnRenamed("mesh_id", "building_id"), "building_id", "left")
    status = F.when((F.col("status") == "SUCCESS") & F.coalesce("bad", F.lit(False)), "WARN").otherwise(F.col("status"))
    return rows.select("building_id", status.alias("status"), F.coalesce("faces", F.lit(0)).alias("faces"), F.coalesce("area", F.lit(0.0)).alias("area"))
