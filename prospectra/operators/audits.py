"""Outcome horizons, leave-one-out encoding, observation rates and rule counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def horizon(df: DataFrame, key: str, period: str, span: int, least: int) -> DataFrame:
    """Counts of each key's rows in its first period and the `span` after; right-censored where the data end before that."""
    per = df.groupBy(key, period).agg(F.count("*").alias("__n"))
    first = per.groupBy(key).agg(F.min(period).alias("first_year"))
    last = per.agg(F.max(period).alias("__last"))
    within = per.join(first, key).where(F.col(period) <= F.col("first_year") + span).groupBy(key, "first_year").agg(F.sum("__n").alias("n"))
    outcome = F.when(F.col("first_year") + span > F.col("__last"), "right_censored").when(F.col("n") >= least, "contributor").otherwise("other")
    return within.crossJoin(F.broadcast(last)).select(key, "first_year", "n", outcome.alias("outcome"))  # `last` is one row


def encode_left_out(df: DataFrame, group: str, label: str, smoothing: float, out: str) -> DataFrame:
    """Adds each group's smoothed label rate without the row's own label.

    A row without a group gets the rate of all other rows; where there are no other rows, the rate is null.
    """
    groups = df.groupBy(F.col(group).alias("__g")).agg(F.sum(label).alias("__p"), F.count("*").alias("__n"))
    total = groups.agg(F.sum("__p").alias("__ap"), F.sum("__n").alias("__an"))
    joined = df.join(groups.where("__g IS NOT NULL"), F.col(group) == F.col("__g"), "left").crossJoin(F.broadcast(total))  # `total` is one row
    prior = F.try_divide(F.col("__ap") - F.col(label), F.col("__an") - 1)
    rate = F.when(F.col("__n").isNull(), prior).otherwise((F.col("__p") - F.col(label) + smoothing * prior) / (F.col("__n") - 1 + smoothing))
    return joined.withColumn(out, rate).drop("__g", "__p", "__n", "__ap", "__an")


def observed_rates(df: DataFrame, groups: Sequence[str], label: str, features: Sequence[str]) -> DataFrame:
    """The share of rows with each feature among good and bad ones, a row per group and feature."""
    seen = df.select(*groups, label, *[F.col(f).isNotNull().cast("double").alias(f) for f in features]).unpivot([*groups, label], list(features), "feature", "seen")
    rate = lambda y: F.round(F.avg(F.when(F.col(label) == y, F.col("seen"))), 9)
    return seen.groupBy(*groups, "feature").agg(rate(1).alias("good"), rate(0).alias("bad"))


def usable(feature: str, share: float = 0.015, least: int = 20, spread: float = 1e-8) -> Column:
    """Whether a feature is seen often enough and varies."""
    return (F.count(feature) >= F.greatest(F.lit(least), F.ceil(share * F.count("*")))) & (F.coalesce(F.stddev_pop(feature), F.lit(0.0)) >= spread)


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: the number of rows, and of rows that break each rule."""
    return df.agg(F.count("*").alias("n"), *[F.sum(F.when(rule, 1).otherwise(0)).alias(name) for name, rule in rules.items()])
