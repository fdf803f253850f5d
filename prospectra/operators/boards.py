"""Evaluation of candidates: category and profile scores, distance from the training rows, boards and their movement, feature choice and gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prospectra.operators import windows


def category_scores(values: DataFrame, specs: DataFrame, key: str) -> DataFrame:
    """(key, category, score, coverage, observed, expected): the weighted mean of the scores that there are, and the share of the weights that have a value.

    `values` has the key, metric, value and score (null where a value has no benchmark); `specs` metric, category and weight, a row for each.
    """
    joined = values.where("value is not null").join(F.broadcast(specs), "metric")
    per = joined.groupBy(key, "category").agg(
        F.sum(F.when(F.col("score").isNotNull() & (F.col("weight") > 0), F.col("weight") * F.col("score"))).alias("top"),
        F.sum(F.when(F.col("score").isNotNull() & (F.col("weight") > 0), F.col("weight"))).alias("bottom"),
        F.sum("weight").alias("seen"),
        F.count("*").alias("observed"),
    )
    whole = specs.groupBy(F.col("category").alias("c")).agg(F.sum("weight").alias("all"), F.count("*").alias("expected"))
    return per.join(F.broadcast(whole), F.col("category") == F.col("c")).select(key, "category", F.try_divide("top", "bottom").alias("score"), F.try_divide("seen", "all").alias("coverage"), "observed", "expected")


def profile_scores(categories: DataFrame, key: str, weights: Mapping[str, float], enough: float = 0.75) -> DataFrame:
    """(key, profile, evidence): the categories' weighted mean, drawn to 50 where the evidence behind it is less than `enough`."""
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("category")]
    per = categories.where(F.col("score").isNotNull()).where(weight.isNotNull()).groupBy(key).agg(F.sum(weight * F.col("score")).alias("top"), F.sum(weight).alias("bottom"), F.sum(weight * F.col("coverage")).alias("evidence"))
    raw = F.try_divide("top", "bottom")
    return per.select(key, (50 + (raw - 50) * F.least(F.lit(1.0), F.col("evidence") / enough)).alias("profile"), "evidence")


def distance_from_training(candidates: DataFrame, centres: DataFrame, features: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """Adds out_of_distribution, the root mean square of the features' robust z values; `centres` has a row per group with m_<feature> and s_<feature>."""
    joined = candidates.join(centres, list(groups), "left")
    squares = [F.pow((F.col(f) - F.col(f"m_{f}")) / F.col(f"s_{f}"), 2) for f in features]
    seen = sum((F.when(s.isNotNull(), 1.0).otherwise(0.0) for s in squares), F.lit(0.0))
    total = sum((F.coalesce(s, F.lit(0.0)) for s in squares), F.lit(0.0))
    return joined.withColumn("out_of_distribution", F.sqrt(F.try_divide(total, seen))).select(*candidates.columns, "out_of_distribution")


def board(df: DataFrame, likelihood: str, profile: str, stale: Column, ties: Sequence[Column], n: int) -> DataFrame:
    """The first n rows by likelihood, those without one by profile after them; stale rows are left out. The place is numbered over n rows only."""
    order = [F.desc_nulls_last(likelihood), F.desc_nulls_last(profile), *ties]
    top = df.where(~F.coalesce(stale, F.lit(False))).orderBy(*order).limit(n)
    return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def movement(current: DataFrame, previous: DataFrame, keys: Sequence[str], place: str, values: Sequence[str], scope: str) -> DataFrame:
    """Adds <place>_change (upwards is positive) and each value's change since the previous board; values of another scope don't compare."""
    before = previous.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(place).alias("__place"), F.col(scope).alias("__scope"), *[F.col(v).alias(f"__v{i}") for i, v in enumerate(values)])
    joined = current.join(before, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], "left")
    same = F.col(scope).eqNullSafe(F.col("__scope")) & F.col("__place").isNotNull()
    changes = {f"{place}_change": F.when(same, F.col("__place") - F.col(place))} | {f"{v}_change": F.when(same, F.col(v) - F.col(f"__v{i}")) for i, v in enumerate(values)}
    status = F.when(F.col("__place").isNull(), "new").when(~same, "other_scope").otherwise("compared")
    return joined.withColumns({**changes, "movement": status}).drop("__place", "__scope", *[f"__k{i}" for i in range(len(keys))], *[f"__v{i}" for i in range(len(values))])


def largest_differences(pairs: Mapping[str, Column], n: int = 3) -> Column:
    """The names of the n largest absolute differences of a row, largest first, equal ones by name backwards; missing ones don't count."""
    found = F.filter(F.array(*[F.struct(F.abs(c).alias("d"), F.lit(k).alias("name")) for k, c in pairs.items()]), lambda x: x["d"].isNotNull())
    return F.transform(F.slice(F.sort_array(found, asc=False), 1, n), lambda x: x["name"])


def selectable_features(df: DataFrame, features: Sequence[str], label: str, least: float = 0.25, least_in_class: float = 0.10, most_gap: float = 0.65, least_spread: float = 1e-8) -> DataFrame:
    """(feature, observed, positive, negative, spread, selected), in one aggregate over the rows.

    A feature needs enough values in all, in both classes, in classes about equally often, and values that differ.
    """
    share = lambda f, on: F.sum(F.when(on & F.col(f).isNotNull(), 1).otherwise(0)) / F.sum(F.when(on, 1).otherwise(0))
    yes, no = F.col(label) == 1, F.col(label) == 0
    parts = [F.struct(F.lit(f).alias("feature"), (F.count(f) / F.count("*")).alias("observed"), share(f, yes).alias("positive"), share(f, no).alias("negative"), F.stddev_pop(f).alias("spread")) for f in features]
    rows = df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("f")).select("f.*")
    fit = (F.col("observed") >= least) & (F.least("positive", "negative") >= least_in_class) & (F.abs(F.col("positive") - F.col("negative")) <= most_gap) & (F.col("spread") >= least_spread)
    return rows.withColumn("selected", F.coalesce(fit, F.lit(False)))


def evidence_gate(features: Sequence[str], least: int = 3, share: float = 0.30) -> tuple[Column, Column, Column]:
    """How many of the features a row has, their share, and whether that is enough."""
    observed = sum((F.when(F.col(f).isNotNull(), 1).otherwise(0) for f in features), F.lit(0))
    return observed, observed / len(features), (observed >= least) & (observed / len(features) >= share)


def outcome_states(players: DataFrame, games: DataFrame, complete: DataFrame, player: str, drafted: str, season: str, amount: Column, last_season: int, horizon: int = 3, least: float = 1.0) -> DataFrame:
    """(player, state, total): what a player did in the `horizon` seasons from the draft.

    A season that hasn't been played makes the outcome right_censored, one whose games are not all
    there incomplete; else it is contributor, below or zero by the total of `amount`.
    `complete` has the seasons whose games are all there.
    """
    spans = players.select(player, drafted, F.explode(F.sequence(F.col(drafted), F.col(drafted) + horizon - 1)).alias(season))
    done = complete.select(F.col(season).alias("__s")).distinct().withColumn("__whole", F.lit(True))
    totals = games.groupBy(player, season).agg(F.sum(amount).alias("__amount"))
    joined = spans.join(F.broadcast(done), F.col(season) == F.col("__s"), "left").join(totals, [player, season], "left")
    per = joined.groupBy(player).agg(F.max(season).alias("__last"), F.min(F.coalesce("__whole", F.lit(False))).alias("__all"), F.coalesce(F.sum("__amount"), F.lit(0.0)).alias("total"))
    state = F.when(F.col("__last") > last_season, "right_censored").when(~F.col("__all"), "incomplete").when(F.col("total") >= least, "contributor").when(F.col("total") > 0, "below").otherwise("zero")
    return per.select(player, state.alias("state"), "total")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return windows.best_rows(df, keys, order)


def benchmarks(candidates: DataFrame, references: DataFrame, key: str, position: str, lower: Sequence[str], least: int = 5) -> DataFrame:
    """(key, position, metric, value, reference, peers, score): where a value stands among the first reference that has enough values of its position and metric.

    `candidates` is long, with metric and value; `references` has the position, metric, value, reference
    and priority. The score is the share below and half of the equal ones; of metrics in `lower`, less is
    better. Values without a reference have a null score.
    """
    keys = [position, "metric"]
    sound = references.where("value is not null and not isnan(value)")
    sizes = sound.groupBy(*keys, "priority", "reference").agg(F.count("*").alias("peers")).where(F.col("peers") >= least)
    chosen = sizes.groupBy(*keys).agg(F.min(F.struct("priority", "reference", "peers")).alias("c")).select(*keys, "c.*")
    counts = sound.join(chosen.select(*keys, "priority"), [*keys, "priority"]).groupBy(*keys, "value").agg(F.count("*").alias("n"))
    # Values that are asked for stand among the counted ones: the window runs over distinct values only.
    asked = candidates.where("value is not null and not isnan(value)").select(*keys, "value").distinct().withColumn("n", F.lit(0))
    merged = counts.unionByName(asked).groupBy(*keys, "value").agg(F.sum("n").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = merged.withColumn("below", below)
    joined = candidates.join(placed, [*keys, "value"], "left").join(chosen.drop("priority"), keys, "left")
    share = 100.0 * (F.col("below") + 0.5 * F.col("n")) / F.col("peers")
    return joined.select(key, *keys, "value", "reference", "peers", F.when(F.col("metric").isin(*lower), 100 - share).otherwise(share).alias("score"))


def evaluated(candidates: DataFrame, references: DataFrame, specs: DataFrame, key: str, position: str, lower: Sequence[str], weights: Mapping[str, float]) -> DataFrame:
    """(key, profile, evidence) of long candidates: benchmarks, then categories, then one profile."""
    scored = benchmarks(candidates, references, key, position, lower)
    return profile_scores(category_scores(scored, specs, key), key, weights)
