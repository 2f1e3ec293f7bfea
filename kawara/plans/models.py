"""Model inference behind a runner that the user supplies: no weights are part of this library."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Images with a side over this are flat roofs without asking a model.
LARGEST = 256


class NoModel(RuntimeError):
    """No runner is configured."""


def needs_model(width: Column, height: Column) -> Column:
    return (width <= LARGEST) & (height <= LARGEST)


def inferred(images: DataFrame, schema: str, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]] | None) -> DataFrame:
    """load() runs once for each task and returns what turns a batch of image rows into rows of schema."""
    if load is None:
        raise NoModel("no model is configured: pass a loader that returns a batch function")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield model(batch)

    return images.mapInPandas(run, schema)


def roof_classes(images: DataFrame, load=None) -> DataFrame:
    """(building_id, roof) from images (building_id, width, height, content): large ones are FLAT, the rest is asked."""
    large = images.where(~needs_model(F.col("width"), F.col("height"))).select("building_id", F.lit("FLAT").alias("roof"))
    small = images.where(needs_model(F.col("width"), F.col("height")))
    return large.unionByName(inferred(small, "building_id long, roof string", load))
