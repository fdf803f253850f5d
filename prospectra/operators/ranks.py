"""Exact running sums in an order, of groups of any size.

Rows are range-partitioned by group and order, so a large group lies in many ranges. Sums of whole
ranges are added up over a table with one row per range and group; inside a range a window adds the
rows. No task sees a group, only a range of it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prospectra.sources import shared


def running(df: DataFrame, groups: Sequence[str], order: Sequence[Column], sums: Mapping[str, str]) -> DataFrame:
    """`df` with, for each column of `sums` under its name there, the sum over the group's rows before a row, and all_<name>, that over the group.

    Null groups are groups. Rows that the order doesn't tell apart follow each other in any order.
    The rows are stored once, so that a range is the same whenever it is read.
    """
    group = F.struct(*groups) if groups else F.struct(F.lit(0).alias("all"))
    columns = {f"__o{i}": o for i, o in enumerate(order)}
    ranged = df.withColumn("__g", group).repartitionByRange(F.col("__g"), *columns.values()).withColumn("__part", F.spark_partition_id())
    kept = shared.stored(ranged)
    parts = kept.groupBy("__g", "__part").agg(*[F.sum(c).alias(f"__s_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy("__g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("__g")
    known = parts.select(
        F.col("__g").alias("__h"), F.col("__part").alias("__q"),
        *[F.coalesce(F.sum(f"__s_{n}").over(earlier), F.lit(0)).alias(f"__b_{n}") for n in sums], *[F.sum(f"__s_{n}").over(whole).alias(f"all_{n}") for n in sums],
    )
    inside = Window.partitionBy("__g", "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = kept.withColumns({f"__l_{n}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    joined = local.join(known, (F.col("__g") == F.col("__h")) & (F.col("__part") == F.col("__q")))
    done = joined.withColumns({n: F.col(f"__b_{n}") + F.col(f"__l_{n}") for n in sums})
    return done.drop("__g", "__part", "__h", "__q", *[f"__{k}_{n}" for k in "bl" for n in sums])


def numbered(df: DataFrame, groups: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """Adds each row's number within its group, from 1, in a total order."""
    one = df.withColumn("__one", F.lit(1).cast("long"))
    return running(one, groups, order, {"__before": "__one"}).withColumn(out, F.col("__before") + 1).drop("__one", "__before", "all___before")


def competition(df: DataFrame, groups: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds 1 + the number of the group's rows with a higher value. Null groups are a group; a null or NaN value has no rank and is above nobody."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    valued = df.withColumn("__v", v)
    counts = valued.where("__v IS NOT NULL").groupBy(*groups, "__v").agg(F.count("*").alias("__n"))
    places = running(counts, groups, [F.desc("__v")], {"__above": "__n"})
    names = [*groups, "__v"]
    side = places.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(names)], (F.col("__above") + 1).alias(out))
    on = F.col("__v") == F.col(f"__k{len(groups)}")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"__k{i}"))
    return valued.join(side, on, "left").drop("__v", *[f"__k{i}" for i in range(len(names))])
