"""Versioned tables: a version is seen whole or not at all.

Rows are written to a folder of their own first. Then one row that names it is appended to a log,
which is a single small file, put in place by one rename. Readers follow the log, so a lost task, a
driver that stops between the two steps, or a second run leave the last whole version in sight.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_LOG = "week bigint, published bigint, id string, rows bigint, schema string"


class Snapshots:
    """The versions below a folder of any store that Spark reads, one per week; publishing a week again replaces what readers see of it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _log(self) -> DataFrame:
        return self.spark.read.schema(_LOG).parquet(f"{self.root}/log")

    def prepare(self) -> None:
        """An empty log, where there is none. Only the first run over a folder needs it."""
        self.spark.createDataFrame([], _LOG).write.mode("ignore").parquet(f"{self.root}/log")

    def publish(self, rows: DataFrame, week: int) -> str:
        """Writes a version and then shows it; returns its id. An existing version is never changed."""
        version = f"{week:08d}-{uuid.uuid4().hex}"
        rows.write.mode("error").parquet(f"{self.root}/data/{version}")
        count = self.spark.read.schema(rows.schema).parquet(f"{self.root}/data/{version}").count()
        entry = [(week, time.time_ns(), version, count, rows.schema.json())]
        self.spark.createDataFrame(entry, _LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/log")
        return version

    def versions(self) -> DataFrame:
        """(week, published, id, rows, schema): the last published version of each week."""
        return self._log().groupBy("week").agg(F.max_by(F.struct("published", "id", "rows", "schema"), F.struct("published", "id")).alias("v")).select("week", "v.*")

    def read(self, week: int | None = None) -> DataFrame | None:
        """The version of a week, or of the last one before it that has one; the newest without a week; None where there is none."""
        seen = self.versions() if week is None else self.versions().where(F.col("week") <= F.lit(week))
        last = seen.orderBy(F.desc("week")).limit(1).collect()
        if not last:
            return None
        schema = StructType.fromJson(json.loads(last[0]["schema"]))
        return self.spark.read.schema(schema).parquet(f"{self.root}/data/{last[0]['id']}")
