"""Intermediate tables in the folder that driver and executors share, each with an owner that empties it."""

from __future__ import annotations

import tempfile
import uuid
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only a local session may leave it unset, as in tests, and gets a folder of this machine."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = _LOCAL.setdefault("folder", f"file://{tempfile.mkdtemp(prefix='prospectra-')}")
    return place.rstrip("/")


class Shelf:
    """Stored tables of one computation. Leaving the block empties them, so nothing that is returned may read them."""

    def __init__(self, spark: SparkSession):
        self.spark, self._kept = spark, {}

    def put(self, df: DataFrame) -> DataFrame:
        """The same rows, written and read again, which cuts the lineage and survives the loss of executors."""
        path = f"{folder(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self._kept[path] = df.schema
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Shelf:
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, trace: TracebackType | None) -> None:
        for path, schema in self._kept.items():
            self.spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """A table that is returned: written and read again, and left for the cluster's cleaning of the folder."""
    return Shelf(df.sparkSession).put(df)


def lookup(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A stored table that joins take whole to every task if it has few rows, and shuffle if it has more."""
    kept = stored(df)
    return F.broadcast(kept) if kept.count() <= rows else kept
