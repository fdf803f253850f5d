"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The attribute of a stored table that names its folder, and the folder of a local session.
_PLACE = "_prospectra_place"
_LOCAL: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only a local session may leave it unset, as in tests, and gets a folder of this machine."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = _LOCAL.setdefault("folder", f"file://{tempfile.mkdtemp(prefix='prospectra-')}")
    return place.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet in the shared folder and read again.

    This cuts the lineage: what was written survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    setattr(back, _PLACE, path)
    return back


def drop(*tables: DataFrame) -> None:
    """Deletes stored tables. What is returned or will run later must not read them, so that it can be computed again."""
    for table in tables:
        path = getattr(table, _PLACE, None)
        if path is not None:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
