"""Histories from box rows and a schedule: what counts, what was dropped and why, and totals as of each period."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def judged_rows(box: DataFrame, schedule: DataFrame, game: str, final: Column) -> DataFrame:
    """The box rows with the schedule's columns and `verdict`: kept, unfinished, unknown_game, or no_game for a null one.

    `final` is a condition over the schedule's columns; null is not final. A game that the schedule
    has several times counts once, as final if any of its rows is.
    """
    known = schedule.withColumn("__final", F.coalesce(final, F.lit(False))).where(F.col(game).isNotNull())
    best = known.groupBy(F.col(game).alias("__game")).agg(F.max_by(F.struct(*[c for c in known.columns if c != game]), F.struct("__final", *[c for c in known.columns if c not in (game, "__final")])).alias("__s"))
    joined = box.join(best, F.col(game) == F.col("__game"), "left")
    verdict = F.when(F.col(game).isNull(), "no_game").when(F.col("__game").isNull(), "unknown_game").when(F.col("__s.__final"), "kept").otherwise("unfinished")
    held = [c for c in schedule.columns if c != game and c not in box.columns]
    return joined.select(*box.columns, *[F.col(f"__s.{c}").alias(c) for c in held], verdict.alias("verdict"))


def drop_counts(judged: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Per group how many rows had each verdict."""
    names = ["kept", "unfinished", "unknown_game", "no_game"]
    return judged.groupBy(*groups).agg(*[F.count(F.when(F.col("verdict") == v, 1)).alias(v) for v in names])


def checkpoints(rows: DataFrame, keys: Sequence[str], period: str, sums: Mapping[str, Column]) -> DataFrame:
    """One row per key and period with rows: each sum of the period, and as <name>_to_date that of all periods up to it.

    Rows are summed by period first; the window runs over a key's periods, of which there are few.
    A late row belongs to its own period: all later totals to date have it. Null keys are keys;
    rows without a period are left out.
    """
    totals = rows.where(F.col(period).isNotNull()).groupBy(*keys, period).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    upto = Window.partitionBy(*keys).orderBy(period).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return totals.select("*", *[F.sum(n).over(upto).alias(f"{n}_to_date") for n in sums])


def as_of(points: DataFrame, keys: Sequence[str], period: str, at: object) -> DataFrame:
    """The last checkpoint of each key at or before a period."""
    seen = points.where(F.col(period) <= F.lit(at))
    held = [c for c in points.columns if c not in keys]
    return seen.groupBy(*keys).agg(F.max_by(F.struct(*held), F.col(period)).alias("__p")).select(*keys, "__p.*")
