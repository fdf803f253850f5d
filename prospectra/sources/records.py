"""Record files in and out: CSV, gzipped CSV, JSON documents and JSON lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

#: Members of a JSON object that hold its records.
HOLDERS = ["players", "records"]


def read_records(spark: SparkSession, path: str, required: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """The records of a file or folder; the kind follows the ending: .csv, .csv.gz, .json, .jsonl.

    CSV columns are text, blank is null, a byte order mark is dropped, and with `strict` a ragged
    row is an error. A JSON document is a list of records, an object that holds them as `players`
    or `records`, or one record. Raises ValueError if a column in `required` is missing.
    """
    name = path.rstrip("/").lower().removesuffix(".gz")
    if name.endswith(".csv"):
        df = spark.read.csv(path, header=True, mode="FAILFAST" if strict else "PERMISSIVE", encoding="UTF-8", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, nullValue="")
        df = df.toDF(*[c.removeprefix("﻿") for c in df.columns])
    elif name.endswith((".jsonl", ".ndjson")):
        df = spark.read.json(path)
    elif name.endswith(".json"):
        df = spark.read.json(path, multiLine=True)
        held = [c for c in HOLDERS if c in df.columns and isinstance(df.schema[c].dataType, ArrayType) and isinstance(df.schema[c].dataType.elementType, StructType)]
        if held:
            df = df.select(F.inline(held[0]))
    else:
        raise ValueError(f"unknown kind of record file: {path}")
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    return df


def write_records(df: DataFrame, path: str, first: Sequence[str] = ()) -> None:
    """Writes a folder of CSV (.csv) or JSON lines (.jsonl) parts, columns in `first` leading; nulls are blank in CSV.

    An existing folder is an error; readers take a folder as complete when its _SUCCESS is there.
    """
    ordered = df.select(*[c for c in first if c in df.columns], *[c for c in df.columns if c not in first])
    if path.endswith(".csv"):
        ordered.write.csv(path, header=True, nullValue="", emptyValue="")
    elif path.endswith(".jsonl"):
        ordered.write.json(path, ignoreNullFields=False)
    else:
        raise ValueError(f"unknown kind of record file: {path}")


def template(spark: SparkSession, schema: str) -> DataFrame:
    """An empty table of a DDL schema, to be written as a form to fill in."""
    return spark.createDataFrame([], schema)
