"""Ranking and calibration metrics per group, from a score and a 0/1 label.

Scores are counted first, so that windows run over a group's distinct scores, not its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prospectra.operators import ranks


def roc_auc(df: DataFrame, groups: Sequence[str], score: str, label: str, out: str = "auc") -> DataFrame:
    """The share of (positive, negative) pairs in the right order, ties as half; null without both classes."""
    counts = df.groupBy(*groups, score).agg(F.sum(label).alias("__p"), F.sum(1 - F.col(label)).alias("__n"))
    below = Window.partitionBy(*groups).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    won = counts.withColumn("__won", F.col("__p") * (F.coalesce(F.sum("__n").over(below), F.lit(0)) + 0.5 * F.col("__n")))
    return won.groupBy(*groups).agg(F.try_divide(F.sum("__won"), F.sum("__p") * F.sum("__n")).alias(out))


def average_precision(df: DataFrame, groups: Sequence[str], score: str, label: str, tie: str, out: str = "ap") -> DataFrame:
    """Mean precision at each positive, by falling score (null scores last) and then rising `tie`; rows that these don't tell apart count at their last place."""
    counts = df.groupBy(*groups, score, tie).agg(F.count("*").alias("__n"), F.sum(label).alias("__p"))
    ranked = ranks.running(counts, groups, [F.desc(score), F.asc(tie)], {"__at": "__n", "__hits": "__p"})
    precision = (F.col("__hits") + F.col("__p")) / (F.col("__at") + F.col("__n"))
    return ranked.groupBy(*groups).agg(F.try_divide(F.sum(F.col("__p") * precision), F.sum("__p")).alias(out))


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def log_loss(p: Column, y: Column, clip: float = 1e-12) -> Column:
    q = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), p))
    return F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q)))


def calibration_error(df: DataFrame, groups: Sequence[str], p: str, label: str, bins: int = 10, out: str = "ece") -> DataFrame:
    """Mean distance of probability and rate over equal-width bins, weighed by their rows."""
    binned = df.groupBy(*groups, F.least(F.lit(bins - 1), F.floor(F.col(p) * bins)).alias("__bin")).agg(
        F.count("*").alias("__n"), F.avg(p).alias("__p"), F.avg(F.col(label).cast("double")).alias("__y")
    )
    return binned.groupBy(*groups).agg((F.sum(F.col("__n") * F.abs(F.col("__p") - F.col("__y"))) / F.sum("__n")).alias(out))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def best_f1(df: DataFrame, groups: Sequence[str], score: str, label: str) -> DataFrame:
    """The threshold with the best F1 among the scores, the smallest of equals."""
    counts = df.groupBy(*groups, score).agg(F.sum(label).alias("__p"), F.count("*").alias("__n"))
    up = Window.partitionBy(*groups).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_p = F.sum("__p").over(Window.partitionBy(*groups))
    tp, picked = F.sum("__p").over(up), F.sum("__n").over(up)
    rated = counts.withColumn("__f1", F.round(f1(tp, picked - tp, all_p - tp), 9))
    best = rated.groupBy(*groups).agg(F.max(F.struct(F.col("__f1"), (-F.col(score)).alias("__t"))).alias("__b"))
    return best.select(*groups, (-F.col("__b.__t")).alias("threshold"), F.col("__b.__f1").alias("f1"))


def board(df: DataFrame, groups: Sequence[str], score: str, label: str, tie: str, k: int) -> DataFrame:
    """precision, recall and binary NDCG of the k highest scores of each group."""
    w = Window.partitionBy(*groups).orderBy(F.desc(score), F.asc(tie))
    # The limit reaches below the window: a task keeps k rows of a group, however many there are.
    top = df.withColumn("__at", F.row_number().over(w)).where(F.col("__at") <= k)
    best = top.groupBy(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)]).agg(F.sum(label).alias("__hits"), F.sum(F.col(label) / F.log2(F.col("__at") + 1)).alias("__dcg"))
    totals = df.groupBy(*groups).agg(F.sum(label).alias("__all"), F.least(F.lit(k), F.count("*")).alias("__k"))
    per = totals.join(best, [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)])
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.greatest(F.col("__all"), F.lit(1))).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return per.select(*groups, (F.col("__hits") / F.col("__k")).alias("precision"), F.try_divide(F.col("__hits"), F.col("__all")).alias("recall"), F.when(F.col("__all") > 0, F.col("__dcg") / ideal).alias("ndcg"))
