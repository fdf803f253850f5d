"""Rows of plain files named by their place, and taken by it without moving what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectra.llm import scratch

#: Rows of a bitmap, which has 4 KB; bitmaps that are broadcast, at most (100 MB of them).
BITS, BROADCAST_MAPS = 32_768, 25_000


def numbered(df: DataFrame) -> DataFrame:
    """`df` with __row, the place of each row in its files, which is the same at every reading. Other tables than plain files are stored first."""
    plain = df._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation" and df.inputFiles()
    files = df if plain else scratch.stored(df)
    return files.select("*", F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string")).alias("__row"))


def _place(row: str) -> tuple[Column, Column, Column]:
    """The file of a __row, the number of its bitmap there, and its bit."""
    last = F.substring_index(row, ":", -1)
    file = F.col(row).substr(F.lit(1), F.length(row) - F.length(last) - 1)
    return file, F.floor(last.cast("long") / BITS), last.cast("long") % BITS


def _bit(held: Column, at: Column) -> Column:
    """Whether a bitmap has a bit, as 0 or 1."""
    byte = F.conv(F.hex(held.substr((F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (at % 8).cast("int")).cast("int")


def taken(rows: DataFrame, wanted: DataFrame, most: int = 1) -> DataFrame:
    """The numbered `rows` whose __row is in `wanted` (__row, __times), each __times times, 1 to `most`; without __row.

    Each file's wanted rows become bitmaps, which are broadcast, so that only places are shuffled;
    beyond BROADCAST_MAPS of them rows are joined.
    """
    columns = [c for c in rows.columns if c != "__row"]
    file, number, bit = _place("__row")
    levels = [F.bitmap_construct_agg(F.when(F.col("__times") > k, bit)).alias(f"__m{k}") for k in range(most)]
    wanted = wanted.select("__row", "__times")
    maps = scratch.stored(wanted.groupBy(file.alias("__f"), number.alias("__n")).agg(*levels))
    if maps.count() > BROADCAST_MAPS:
        met = rows.join(wanted, "__row")
    else:
        placed = rows.withColumns({"__file": file, "__number": number})
        met = placed.join(F.broadcast(maps), (F.col("__file") == F.col("__f")) & (F.col("__number") == F.col("__n")))
        met = met.withColumn("__times", sum((_bit(F.col(f"__m{k}"), bit) for k in range(most)), F.lit(0))).where("__times > 0")
    if most > 1:
        met = met.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int"))))
    return met.select(*columns)
