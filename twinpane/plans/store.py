"""Tables that are computed once in a session and read by many queries."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_held: dict[tuple, str] = {}


def folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; a temporary folder only where a local session leaves it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = (spark.sparkContext.applicationId, "folder")
    if key not in _held:
        _held[key] = "file://" + tempfile.mkdtemp(prefix="twinpane-pairs-")
    return _held[key]


def once(spark: SparkSession, name: str, of: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that `make` gives for an input `of`, written the first time it is asked for in a session."""
    key = (spark.sparkContext.applicationId, name, of)
    if key not in _held:
        path = f"{folder(spark)}/twinpane-pairs/{name}-{uuid.uuid4().hex}"
        make().write.parquet(path)
        _held[key] = path
    return spark.read.parquet(_held[key])
