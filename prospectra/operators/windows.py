"""Window operators: peer percentiles, latest rows, top-k and movement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def peer_midrank(df: DataFrame, groups: Sequence[str], value: str, out: str, lower_is_better: bool = False) -> DataFrame:
    """Adds 100 * (rows below + half of the equal rows) / peers among rows with a value.

    Distinct values are counted first, so the window runs over one row per value, not per row.
    Rows without a value (null or NaN) get null and count as nobody's peer.
    """
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    src = df.withColumn("__v", v)
    counts = src.where("__v IS NOT NULL").groupBy(*groups, "__v").agg(F.count("*").alias("__n"))
    by_value = Window.partitionBy(*groups).orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everyone = Window.partitionBy(*groups)
    below = F.sum("__n").over(by_value) - F.col("__n")
    share = 100.0 * (below + 0.5 * F.col("__n")) / F.sum("__n").over(everyone)
    scored = counts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__v").alias("__w"), (100.0 - share if lower_is_better else share).alias(out))
    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)] + [F.col("__v") == F.col("__w")]
    on = same[0]
    for condition in same[1:]:
        on = on & condition
    return src.join(scored, on, "left").drop("__v", "__w", *[f"__g{i}" for i in range(len(groups))])


def best_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """Adds each row's number within its key, from 1, in a total order."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def latest_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], is_checkpoint: Column, value: str, out: str) -> DataFrame:
    """Adds the `value` of the last checkpoint row of the key at or before each row, in one window and without a range join."""
    w = Window.partitionBy(*keys).orderBy(order[0]).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    best = F.max(F.when(is_checkpoint, F.struct(*order, F.col(value).alias("__value")))).over(w)
    return df.withColumn(out, best["__value"])


def completed(df: DataFrame, groups: Sequence[str], period: str, closed: str) -> DataFrame:
    """The groups' periods of which every row is closed."""
    return df.groupBy(*groups, period).agg(F.min(closed).alias("__all")).where("__all").drop("__all")


def expanding(df: DataFrame, period: str, sums: dict[str, str]) -> DataFrame:
    """Adds sums over strictly earlier periods; `df` has one row per period, so the one window is small."""
    before = Window.partitionBy(F.lit(0)).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    return df.select("*", *[F.sum(c).over(before).alias(out) for c, out in sums.items()])
