"""Screenshots as RGBA rasters, through Spark's image source."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_rasters(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(pair_id, viewport, side, w, h, data) of files .../pair/viewport/side.png; unreadable files are an error."""
    part = lambda n: F.element_at(F.split("image.origin", "/"), n)
    raw = spark.read.format("image").load(paths).select(part(-3).alias("pair_id"), part(-2).alias("viewport"), F.regexp_replace(part(-1), "\\.[^.]*$", "").alias("side"), F.col("image.width").alias("w"), F.col("image.height").alias("h"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))

    def run(batches):
        for batch in batches:
            out = []
            for w, h, n, data in zip(*(batch.column(c).to_pylist() for c in ("w", "h", "channels", "data"))):
                pixels = np.frombuffer(data, np.uint8).reshape(h, w, n)
                colour = pixels[..., 2::-1] if n >= 3 else np.repeat(pixels, 3, axis=2)
                alpha = pixels[..., 3:] if n == 4 else np.full((h, w, 1), 255, np.uint8)
                out.append(np.concatenate([colour, alpha], axis=2).tobytes())
            names = ["pair_id", "viewport", "side", "w", "h"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.binary())], [*names, "data"])

    return raw.mapInArrow(run, "pair_id string, viewport string, side string, w int, h int, data binary")


def paired(rasters: DataFrame) -> DataFrame:
    """One row a pair and viewport: old_w, old_h, old_data, new_w, new_h, new_data."""
    side = lambda s: rasters.where(F.col("side") == s).select("pair_id", "viewport", *(F.col(c).alias(f"{s}_{c}") for c in ("w", "h", "data")))
    return side("old").join(side("new"), ["pair_id", "viewport"])
