"""Small rasters made of the given embeddings, for kernels to run on: 8 x 8 pixels, one image per row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from constella.plans import views

SIDE = 8


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, px): three values from 0 to 255 for each pixel; about half of the pixels are black."""
    at = lambda k: F.floor(F.abs(F.col("embedding")[F.pmod(k, F.lit(64)).cast("int")].cast("double")) * 2000).cast("int")
    value = lambda k: F.pmod(at(k), F.lit(256))
    pixel = lambda i: F.when(F.pmod(at(i), F.lit(7)) < 4, F.array(*[F.lit(0)] * 3)).otherwise(F.array(value(i), value(i * 7 + 1), value(i * 13 + 2)))
    return views.table(spark, sf_dir, "embeddings").select("vec_id", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), pixel)).alias("px"))


def apply(pictures: DataFrame, kernel: Callable[[np.ndarray], list[list[int]]], columns: list[str]) -> DataFrame:
    """The rows of whole numbers that a kernel gives for each image, an Arrow batch of images at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for key, px in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = kernel(np.array(px, np.uint8).reshape(SIDE, SIDE, 3))
                ids += [key] * len(own)
                rows += own
            made = [pa.array([int(r[k]) for r in rows], pa.int32()) for k in range(len(columns))]
            yield pa.record_batch([pa.array(ids, pa.int64()), *made], ["vec_id", *columns])

    return pictures.mapInArrow(run, f"vec_id long, {', '.join(f'{c} int' for c in columns)}")
