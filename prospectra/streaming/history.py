"""Weekly totals of box rows and a schedule that both arrive as streams."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weekly_totals(box: DataFrame, schedule: DataFrame, game: str, player: str, box_time: str, game_time: str, sums: Mapping[str, Column], within: str = "7 days", late: str = "14 days", span: str = "7 days") -> DataFrame:
    """(player, began, sums): totals by weeks of the game's time, over the box rows of games that `schedule` says are final.

    `schedule` has a row per final game; its columns besides the game's id and time are not used. A
    box row counts if it comes at most `within` before or after its game. Either side may be `late`:
    the join keeps rows that long, weeks come out once nothing of them can follow, and later rows are
    dropped. On tables the result is the same, without dropping anything. Append mode.
    """
    a = box.withWatermark(box_time, late)
    b = schedule.select(F.col(game).alias("__game"), F.col(game_time).alias("__at")).withWatermark("__at", late)
    near = (F.col(game) == F.col("__game")) & (F.col(box_time) >= F.col("__at") - F.expr(f"INTERVAL {within}")) & (F.col(box_time) <= F.col("__at") + F.expr(f"INTERVAL {within}"))
    weeks = a.join(b, near).groupBy(F.col(player), F.window("__at", span).alias("__w")).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return weeks.select(player, F.col("__w.start").alias("began"), *sums)
