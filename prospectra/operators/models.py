"""Logistic models fitted side by side: cross-validation folds and bootstrap replicates in shared passes.

A plan says which periods each fit learns from and with what weight. Fits advance together: a pass
over the rows sums every fit's gradient and curvature, which are a few numbers per fit, and the
driver takes one Newton step for each. Rows are never gathered. More fits, or more features, than
one pass can sum for take several passes.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prospectra.operators.robust import counted_quantiles
from prospectra.sources import shared

#: Numbers that the driver gets from a pass, at most, and sums in one aggregate.
MOST_NUMBERS, MOST_SUMS = 500_000, 800

Plan = list[tuple[int, int, float]]


def expanding_plan(periods: Sequence[int]) -> Plan:
    """(fit, period, weight): the fit of each period but the first learns from all earlier ones."""
    return [(p, q, 1.0) for p in periods for q in periods if q < p]


def bootstrap_plan(periods: Sequence[int], replicates: int, seed: int) -> Plan:
    """(fit, period, weight): each replicate draws as many periods as there are, with replacement."""
    rng = random.Random(seed)
    draws = [Counter(rng.choices(sorted(periods), k=len(periods))) for _ in range(replicates)]
    return [(r, p, float(n)) for r, drawn in enumerate(draws) for p, n in sorted(drawn.items())]


@dataclass
class Fitted:
    """For each fit: medians that stand in for missing values, means, scales, and weights with the intercept last.

    `flags` has, for fits with missing flags, what a missing value of each feature adds.
    """

    features: list[str]
    by_fit: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    flags: dict[int, np.ndarray] = field(default_factory=dict)

    def linear(self) -> dict[int, tuple[list[float], float, list[float]]]:
        """Per fit: (weights on unscaled features, intercept, medians)."""
        out = {}
        for fit, (median, mean, scale, w) in self.by_fit.items():
            raw = w[:-1] / scale
            out[fit] = (raw.tolist(), float(w[-1] - raw @ mean), median.tolist())
        return out

    def score(self, rows: DataFrame, fit: str, out: str = "probability") -> DataFrame:
        """`rows` with `out`, each by the fit that the column `fit` names; null where there is no such fit."""
        zeros = np.zeros(len(self.features))
        table = [(k, w, b, m, self.flags.get(k, zeros).tolist()) for k, (w, b, m) in self.linear().items()]
        known = rows.sparkSession.createDataFrame(table, "__scored_by bigint, __w array<double>, __b double, __m array<double>, __f array<double>")
        joined = rows.join(F.broadcast(known), F.col(fit) == F.col("__scored_by"), "left")
        z = F.col("__b")
        for i, c in enumerate(self.features):
            x = F.col(c).cast("double")
            z = z + F.col("__w")[i] * F.coalesce(x, F.col("__m")[i]) + F.when(x.isNull(), F.col("__f")[i]).otherwise(0.0)
        return joined.withColumn(out, 1 / (1 + F.exp(-z))).drop("__scored_by", "__w", "__b", "__m", "__f")


def fit_logistic(rows: DataFrame, plan: Plan, features: Sequence[str], label: str, period: str, l2: float = 0.08, rounds: int = 25, flags: bool = False) -> Fitted:
    """Logistic fits that minimise the weighted mean log loss + l2 / 2 * |w|^2, the intercept free.

    Missing values become the median of a fit's own rows, columns are scaled to mean 0 and deviation 1
    over them; rows without a label are left out. Fits without rows of both classes are left out.
    With `flags` a feature that a fit's rows lack somewhere also has a weight for being missing.
    """
    base = rows.where(F.col(label).isNotNull()).select(F.col(period).cast("bigint").alias("__at"), F.col(label).cast("double").alias("__y"), *[F.col(c).cast("double").alias(c) for c in features])

    def dealt(part: Plan) -> DataFrame:
        # A part of a plan has a row per fit and period of at most MOST_NUMBERS fits.
        used = rows.sparkSession.createDataFrame(part, "__fit bigint, __period bigint, __weight double")
        return base.join(F.broadcast(used), F.col("__at") == F.col("__period"))

    return _in_parts(plan, len(features), lambda part: fit_dealt(dealt(part), features, l2, rounds, flags))


def _in_parts(plan: Plan, k: int, fit: Callable[[Plan], Fitted]) -> Fitted:
    """The fits of a plan, as many at once as the driver takes numbers of."""
    fits = sorted({f for f, _, _ in plan})
    at_once = max(1, MOST_NUMBERS // ((k + 1) * (k + 2) // 2 + k + 1))
    if len(fits) <= at_once:
        return fit(plan)
    parts = [set(fits[i : i + at_once]) for i in range(0, len(fits), at_once)]
    each = [fit([x for x in plan if x[0] in part]) for part in parts]
    return Fitted(each[0].features, {f: v for one in each for f, v in one.by_fit.items()}, {f: v for one in each for f, v in one.flags.items()})


def fit_dealt(dealt: DataFrame, features: Sequence[str], l2: float, rounds: int = 25, flags: bool = False) -> Fitted:
    """The fits of rows that are dealt already: __fit, __weight, the label __y and the features.

    Rows are scaled and stored once; each Newton round reads them once for all fits.
    """
    spark, k, names = dealt.sparkSession, len(features), list(features)
    w = F.col("__weight")

    def against(values: dict[int, np.ndarray], name: str, to: DataFrame) -> DataFrame:
        side = spark.createDataFrame([(f, v.tolist()) for f, v in values.items()], f"__f bigint, {name} array<double>")
        return to.join(F.broadcast(side), F.col("__fit") == F.col("__f")).drop("__f")

    with shared.Shelf(spark) as shelf:
        raw = shelf.put(dealt.select("__fit", "__weight", "__y", *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)]))
        seen = raw.groupBy("__fit").agg(F.min("__y").alias("lo"), F.max("__y").alias("hi"), F.sum(w).alias("n"), *[F.max(F.col(f"x{i}").isNull()).alias(f"m{i}") for i in range(k)]).where("lo < hi").collect()
        if not seen:
            return Fitted(names, {})
        total = {r["__fit"]: r["n"] for r in seen}
        lacking = {r["__fit"]: np.array([flags and r[f"m{i}"] for i in range(k)], bool) for r in seen}
        found = {f: np.zeros(k) for f in total}
        long = raw.unpivot(["__fit", "__weight"], [f"x{i}" for i in range(k)], "__name", "__x").where("__x IS NOT NULL")
        for r in counted_quantiles(long, ["__fit", "__name"], "__x", {"m": 0.5}, "__weight", ranged=True).collect():
            if r["__fit"] in found:
                found[r["__fit"]][int(r["__name"][1:])] = r["m"]
        filled = against(found, "med", raw).select("__fit", "__weight", "__y", *[F.coalesce(f"x{i}", F.col("med")[i]).alias(f"x{i}") for i in range(k)], *[F.col(f"x{i}").isNull().cast("double").alias(f"m{i}") for i in range(k)])
        mean = {r["__fit"]: np.array([r[f"s{i}"] / total[r["__fit"]] for i in range(k)]) for r in filled.groupBy("__fit").agg(*[F.sum(w * F.col(f"x{i}")).alias(f"s{i}") for i in range(k)]).collect()}
        centred = against(mean, "mu", filled)
        spread = centred.groupBy("__fit").agg(*[F.sum(w * F.pow(F.col(f"x{i}") - F.col("mu")[i], 2)).alias(f"q{i}") for i in range(k)]).collect()
        deviation = {r["__fit"]: np.sqrt([r[f"q{i}"] / total[r["__fit"]] for i in range(k)]) for r in spread}
        scale = {f: np.where(d > 1e-8, d, 1.0) for f, d in deviation.items()}
        shown = [i for i in range(k) if any(v[i] for v in lacking.values())]
        columns = [((F.col(f"x{i}") - F.col("mu")[i]) / F.col("sd")[i]) for i in range(k)] + [F.col(f"m{i}") for i in shown] + [F.lit(1.0)]
        size = len(columns)
        scaled = shelf.put(against(scale, "sd", centred).select("__fit", "__weight", "__y", *[c.alias(f"z{i}") for i, c in enumerate(columns)]))
        weights = {f: np.zeros(size) for f in total}
        penalty = np.append(np.full(size - 1, l2), 0.0)
        for _ in range(rounds):
            now = against(weights, "beta", scaled)
            z: Column = sum((F.col("beta")[i] * F.col(f"z{i}") for i in range(size)), F.lit(0.0))
            p = now.withColumn("__p", 1 / (1 + F.exp(-z)))
            slope = [F.sum(w * (F.col("__p") - F.col("__y")) * F.col(f"z{i}")).alias(f"g{i}") for i in range(size)]
            bend = [F.sum(w * F.col("__p") * (1 - F.col("__p")) * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"h{i}_{j}") for i in range(size) for j in range(i + 1)]
            sums, steepest = slope + bend, 0.0
            got: dict[int, dict[str, float]] = {f: {} for f in total}
            for at in range(0, len(sums), MOST_SUMS):
                for r in p.groupBy("__fit").agg(*sums[at : at + MOST_SUMS]).collect():
                    got[r["__fit"]] |= r.asDict()
            for f, r in got.items():
                # A flag that a fit has no use for keeps the weight 0.
                free = np.concatenate([np.ones(k, bool), lacking[f][shown], [True]])
                g = np.where(free, np.array([r[f"g{i}"] for i in range(size)]) / total[f] + penalty * weights[f], 0.0)
                h = np.array([[r[f"h{max(i, j)}_{min(i, j)}"] for j in range(size)] for i in range(size)]) / total[f]
                step = np.linalg.solve(np.where(np.outer(free, free), h, 0.0) + np.diag(np.where(free, penalty + 1e-12, 1.0)), g)
                weights[f] = weights[f] - step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))
                steepest = max(steepest, float(np.abs(g).max()))
            if steepest < 1e-9:
                break
    flagged = {f: np.zeros(k) for f in total}
    for f, weight in weights.items():
        flagged[f][shown] = weight[k : k + len(shown)]
    return Fitted(names, {f: (found[f], mean[f], scale[f], np.append(weights[f][:k], weights[f][-1])) for f in total}, flagged)


def case_control(df: DataFrame, group: str, label: str, key: str, least: int, most: int, per_positive: int = 6) -> DataFrame:
    """All positives of a group and its first negatives by a hash of the key: per_positive times as many, within [least, most]."""
    order = F.sha2(F.concat(F.lit("sample:"), F.col(key).cast("string")), 256)
    count = df.groupBy(F.col(group).alias("__g")).agg(F.sum(label).alias("__pos"))
    negatives = df.where(F.col(label) == 0).withColumn("__at", F.row_number().over(Window.partitionBy(group).orderBy(order, key))).where(F.col("__at") <= most)
    cap = F.least(F.lit(most), F.greatest(F.lit(least), per_positive * F.coalesce("__pos", F.lit(0))))
    taken = negatives.join(count, F.col(group).eqNullSafe(F.col("__g"))).where(F.col("__at") <= cap)
    return df.where(F.col(label) == 1).unionByName(taken.select(*df.columns))
