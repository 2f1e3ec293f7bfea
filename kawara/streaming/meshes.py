"""Checks on meshes as they arrive: stateless per face, so the stream needs no state or watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kawara.operators import mesh

FACES = "mesh_id long, face_id long, element string, ring array<struct<x:double,y:double,z:double>>"


def read_faces(spark: SparkSession, path: str) -> DataFrame:
    """A stream of face rows from JSON files that arrive in a folder."""
    return spark.readStream.schema(FACES).json(path)


def violations(faces: DataFrame) -> DataFrame:
    return mesh.violations(mesh.checked(faces))
