"""The probability of an outcome in the next period: fits, calibration and judgement by earlier periods only.

A plan deals periods to fits (see models.py): each period's model learns from all earlier ones, a
replicate from periods drawn with replacement. All fits of a plan advance in shared passes. A fit
learns from all its positives and its first negatives by a hash, its intercept makes up for those
left out, and categories enter as smoothed rates of its own rows, without a row's own label.
Calibration is a second plan, over the out-of-sample scores of earlier periods: a period's own
outcomes and later ones never reach its model, its rates or its calibrator.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prospectra.operators import metrics, models
from prospectra.operators.robust import LEAST, counted_quantiles
from prospectra.sources import shared

#: A calibrator's least rows and rows of each class; periods that only train before the first one judged.
CALIBRATION_ROWS, CALIBRATION_CLASS, WARM_UP = 40, 8, 2
#: Negatives to a positive, the least and the most of them, for models and for calibrators.
SAMPLE, CALIBRATION_SAMPLE = (6, 180, 500), (8, 240, 800)


@dataclass
class Design:
    """What a model learns from. `contexts` are categories with the weight of the prior; `sample` None takes all negatives."""

    key: str
    label: str
    period: str
    features: Sequence[str]
    contexts: Mapping[str, float] = field(default_factory=dict)
    sample: tuple[int, int, int] | None = SAMPLE
    calibration_sample: tuple[int, int, int] | None = CALIBRATION_SAMPLE
    l2: float = 0.12
    rounds: int = 25

    def names(self) -> list[str]:
        return [*self.features, *[f"rate_{c}" for c in self.contexts]]


@dataclass
class Class:
    """Rows and positives of a period."""

    rows: int
    positives: int


def classes(rows: DataFrame, label: str, period: str) -> dict[int, Class]:
    """One entry per period with labelled rows."""
    counted = rows.where(F.col(label).isNotNull() & F.col(period).isNotNull()).groupBy(F.col(period).cast("bigint").alias("p")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos"))
    return {r["p"]: Class(r["n"], r["pos"]) for r in counted.collect()}


def _totals(plan: models.Plan, by_period: Mapping[int, Class]) -> dict[int, tuple[float, float]]:
    """(rows, positives) of each fit."""
    rows, positives = Counter(), Counter()
    for fit, period, weight in plan:
        rows[fit] += weight * by_period[period].rows
        positives[fit] += weight * by_period[period].positives
    return {f: (rows[f], positives[f]) for f in rows}


def _plan(spark: SparkSession, plan: models.Plan) -> DataFrame:
    return spark.createDataFrame(plan, "__fit bigint, __period bigint, __weight double")


def sampled(rows: DataFrame, plan: models.Plan, by_period: Mapping[int, Class], key: str, label: str, period: str, ratio: tuple[int, int, int] | None) -> DataFrame:
    """`rows` dealt to fits, with __fit and __weight: all positives, and of the negatives the first by a hash, ratio[0] to a positive, within ratio[1] and ratio[2].

    A fit's first negatives are among its periods' first ones, so no task orders more than these.
    """
    used = _plan(rows.sparkSession, plan)
    known = rows.where(F.col(label).isNotNull()).withColumn("__period_of", F.col(period).cast("bigint"))
    if ratio is None:
        return known.join(F.broadcast(used), F.col("__period_of") == F.col("__period")).drop("__period", "__period_of")
    per, least, most = ratio
    limits = rows.sparkSession.createDataFrame([(f, float(min(most, max(least, per * p)))) for f, (_, p) in _totals(plan, by_period).items()], "__of bigint, __most double")
    hashed = known.withColumn("__hash", F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.col("__period_of").cast("string")), 256))
    order = [F.col("__hash"), F.col(key)]
    first = hashed.where(F.col(label) == 0).withColumn("__at", F.row_number().over(Window.partitionBy("__period_of").orderBy(*order))).where(F.col("__at") <= most).drop("__at")
    dealt = lambda df: df.join(F.broadcast(used), F.col("__period_of") == F.col("__period"))
    before = F.coalesce(F.sum("__weight").over(Window.partitionBy("__fit").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    negatives = dealt(first).withColumn("__before", before).join(F.broadcast(limits), F.col("__fit") == F.col("__of")).withColumn("__weight", F.least("__weight", F.col("__most") - F.col("__before"))).where(F.col("__weight") > 0)
    return dealt(hashed.where(F.col(label) == 1)).unionByName(negatives.drop("__before", "__of", "__most")).drop("__hash", "__period", "__period_of")


def with_rates(rows: DataFrame, fit: str, history: DataFrame, plan: models.Plan, by_period: Mapping[int, Class], design: Design, own: bool) -> DataFrame:
    """`rows` with rate_<context>: the smoothed share of positives of the category among the rows that the column `fit` learns from.

    With `own` a row's label is left out of the counts. Empty and null categories have no rate.
    """
    totals = [(f, n, p) for f, (n, p) in _totals(plan, by_period).items()]
    joined = rows.join(F.broadcast(rows.sparkSession.createDataFrame(totals, "__t bigint, __rows double, __pos double")), F.col(fit) == F.col("__t"), "left")
    removed = F.col(design.label).cast("double") if own else F.lit(0.0)
    one = 1.0 if own else 0.0
    prior = F.coalesce(F.try_divide(F.greatest(F.col("__pos") - removed, F.lit(0.0)), F.col("__rows") - one), F.try_divide("__pos", "__rows"))
    for c, weight in design.contexts.items():
        counted = history.where(F.col(design.label).isNotNull() & (F.col(c).cast("string") != "")).groupBy(F.col(design.period).cast("bigint").alias("__at"), F.col(c).alias("__value")).agg(F.sum(F.lit(1.0)).alias("__n"), F.sum(F.col(design.label).cast("double")).alias("__p"))
        by_fit = counted.join(F.broadcast(_plan(rows.sparkSession, plan)), F.col("__at") == F.col("__period")).groupBy(F.col("__fit").alias("__cf"), "__value").agg(F.sum(F.col("__weight") * F.col("__n")).alias("__n"), F.sum(F.col("__weight") * F.col("__p")).alias("__p"))
        joined = joined.join(by_fit, (F.col(fit) == F.col("__cf")) & (F.col(c) == F.col("__value")), "left")
        n, p = F.coalesce("__n", F.lit(0.0)), F.coalesce("__p", F.lit(0.0))
        kept = lambda x, less: F.when(n > 0, F.greatest(x - less, F.lit(0.0))).otherwise(0.0)
        rate = (kept(p, removed) + weight * prior) / (kept(n, F.lit(one)) + weight)
        joined = joined.withColumn(f"rate_{c}", F.when(F.col(c).cast("string") != "", rate)).drop("__cf", "__value", "__n", "__p")
    return joined.drop("__t", "__rows", "__pos")


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def corrected(fitted: models.Fitted, dealt: DataFrame, full: Mapping[int, tuple[float, float]], label: str) -> models.Fitted:
    """Intercepts moved from the sample's share of positives to that of all rows of a fit."""
    for r in dealt.groupBy("__fit").agg(F.sum("__weight").alias("n"), F.sum(F.col("__weight") * F.col(label)).alias("p")).collect():
        rows, positives = full[r["__fit"]]
        if r["__fit"] in fitted.by_fit and 0 < positives < rows and 0 < r["p"] < r["n"]:
            fitted.by_fit[r["__fit"]][3][-1] += _logit(positives / rows) - _logit(r["p"] / r["n"])
    return fitted


def fit_plan(history: DataFrame, plan: models.Plan, by_period: Mapping[int, Class], design: Design) -> models.Fitted:
    """The models of a plan, in shared passes."""

    def part(some: models.Plan) -> models.Fitted:
        with shared.Shelf(history.sparkSession) as shelf:
            dealt = sampled(history, some, by_period, design.key, design.label, design.period, design.sample)
            ready = shelf.put(with_rates(dealt, "__fit", history, some, by_period, design, own=True).withColumn("__y", F.col(design.label).cast("double")))
            fitted = models.fit_dealt(ready, design.names(), design.l2, design.rounds)
            return corrected(fitted, ready, _totals(some, by_period), "__y")

    return models._in_parts(plan, len(design.names()), part)


def calibrators(scored: DataFrame, at: Sequence[int], design: Design) -> models.Fitted:
    """For each period of `at`, a logistic fit of the label on the logit of `raw` over the scores of all earlier periods.

    Periods with too few earlier scores have none.
    """
    by_period = classes(scored, design.label, design.period)
    plan: models.Plan = []
    for p in at:
        earlier = [q for q in sorted(by_period) if q < p]
        n, positives = sum(by_period[q].rows for q in earlier), sum(by_period[q].positives for q in earlier)
        if n >= CALIBRATION_ROWS and min(positives, n - positives) >= CALIBRATION_CLASS:
            plan += [(p, q, 1.0) for q in earlier]
    if not plan:
        return models.Fitted(["raw_logit"], {})
    own = Design(design.key, design.label, design.period, ["raw_logit"], {}, design.calibration_sample, None, design.l2, design.rounds)
    return fit_plan(scored.withColumn("raw_logit", _raw_logit()), plan, by_period, own)


def _raw_logit() -> Column:
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("raw")))
    return F.log(p / (1 - p))


def calibrated(scored: DataFrame, known: models.Fitted, period: str) -> DataFrame:
    """`scored` with `probability`: `raw` through the calibrator that the column `period` names, or as it is without one."""
    done = known.score(scored.withColumn("raw_logit", _raw_logit()), period, "__calibrated")
    return done.withColumn("probability", F.coalesce("__calibrated", "raw")).drop("__calibrated", "raw_logit")


@dataclass
class Forward:
    """`scored`: the key, label and period of each judged row with raw and calibrated probability, stored; the calibrators, periods and base rates behind them."""

    scored: DataFrame
    known: models.Fitted
    by_period: dict[int, Class]
    base_rate: dict[int, float]


def forward(history: DataFrame, design: Design) -> Forward:
    """Each period scored by the model and the calibrator of all earlier ones; the first has none. Rows without a label or period are left out."""
    by_period = classes(history, design.label, design.period)
    periods = sorted(by_period)
    plan = models.expanding_plan(periods)
    following = (periods[-1] + 1) if periods else 0
    if plan:
        fitted = fit_plan(history, plan, by_period, design)
    else:
        fitted = models.Fitted(design.names(), {})
    labelled = history.where(F.col(design.label).isNotNull()).withColumn(design.period, F.col(design.period).cast("bigint"))
    rated = with_rates(labelled, design.period, history, plan, by_period, design, own=False) if plan else labelled.withColumns({f"rate_{c}": F.lit(None).cast("double") for c in design.contexts})
    raw = shared.stored(fitted.score(rated, design.period, "raw").where("raw IS NOT NULL").select(design.key, design.label, design.period, "raw"))
    known = calibrators(raw, [*periods, following], design)
    totals = _totals(plan, by_period)
    return Forward(calibrated(raw, known, design.period), known, by_period, {f: p / n for f, (n, p) in totals.items() if n})


def judged(done: Forward, design: Design) -> DataFrame:
    """Per period after the warm-up: rows, positives, Brier score and that of the base rate before it, log loss, AUC, average precision, calibration error."""
    periods = sorted(done.by_period)
    shown = periods[WARM_UP:]
    p, y, t = F.col("probability"), F.col(design.label), design.period
    rates = done.scored.sparkSession.createDataFrame(list(done.base_rate.items()), "__p bigint, __rate double")
    rows = done.scored.where(F.col(t).isin(shown)).join(F.broadcast(rates), F.col(t) == F.col("__p"))
    summed = rows.groupBy(t).agg(F.count("*").alias("n"), F.sum(y).alias("positives"), metrics.brier(p, y).alias("brier"), metrics.brier(F.col("__rate"), y).alias("baseline_brier"), metrics.log_loss(p, y).alias("log_loss"))
    auc = metrics.roc_auc(rows, [t], "probability", design.label)
    precision = metrics.average_precision(rows, [t], "probability", design.label, design.key)
    error = metrics.calibration_error(rows, [t], "probability", design.label)
    return summed.join(auc, t).join(precision, t).join(error, t)


def gate(done: Forward, design: Design) -> dict[str, object]:
    """Whether probabilities may be shown, and what that rests on: the scores of all judged periods together."""
    periods = sorted(done.by_period)
    rows = done.scored.where(F.col(design.period).isin(periods[WARM_UP:])).withColumn("__every", F.lit(1))
    rates = rows.sparkSession.createDataFrame(list(done.base_rate.items()), "__p bigint, __rate double")
    p, y = F.col("probability"), F.col(design.label)
    joined = rows.join(F.broadcast(rates), F.col(design.period) == F.col("__p"))
    found = joined.agg(F.count("*").alias("n"), F.sum(y).alias("positives"), metrics.brier(p, y).alias("brier"), metrics.brier(F.col("__rate"), y).alias("base")).collect()[0]
    auc = metrics.roc_auc(rows, ["__every"], "probability", design.label).collect()
    precision = metrics.average_precision(rows, ["__every"], "probability", design.label, design.key).collect()
    n, positives = found["n"], found["positives"] or 0
    facts = {"n": n, "positives": positives, "periods": len(periods), "brier": found["brier"], "baseline": found["base"], "auc": auc[0]["auc"] if auc else None, "ap": precision[0]["ap"] if precision else None}
    following = (periods[-1] + 1) if periods else 0
    # Rows, share of the baseline's score, AUC, precision above the base rate; periods, positives and negatives of a rare outcome.
    quality = n >= 50 and found["brier"] < 0.995 * found["base"] and facts["auc"] is not None and facts["auc"] >= 0.55 and facts["ap"] is not None and facts["ap"] >= positives / n + 0.02
    stage = len(periods) >= 4 and positives >= 30 and n - positives >= 100 and following in done.known.by_fit
    return {**facts, "passes": bool(quality and stage)}


def predict(candidates: DataFrame, history: DataFrame, design: Design, done: Forward | None = None, replicates: int = 30, seed: int = 8128, least_observed: int = 3) -> DataFrame:
    """`candidates` with status, raw, probability, low, high (80 % over replicates of whole periods), out_of_range and coverage.

    The model learns from all of `history`, the calibrator from its out-of-sample scores. `status` is
    `withheld` where the gate fails, `insufficient` below `least_observed` observed inputs (then all
    numbers but coverage are null), else `estimate`. An empty history withholds everything.
    """
    done = done or forward(history, design)
    periods = sorted(done.by_period)
    following = (periods[-1] + 1) if periods else 0
    passes = bool(periods) and bool(gate(done, design)["passes"])
    seen = sum((F.col(c).isNotNull().cast("int") for c in design.names()), F.lit(0))
    numbers = ["raw", "probability", "low", "high", "out_of_range"]
    if not passes:
        bare = candidates.withColumns({f"rate_{c}": F.when(F.col(c).cast("string") != "", 0.0) for c in design.contexts})
        bare = bare.withColumns({"coverage": seen / len(design.names()), "status": F.lit("withheld"), **{c: F.lit(None).cast("double") for c in numbers}})
        return bare.drop(*[f"rate_{c}" for c in design.contexts])
    draws = [(following + 1 + r, p, w) for r, p, w in models.bootstrap_plan(periods, replicates, seed)] if len(periods) >= 3 else []
    plan = [(following, p, 1.0) for p in periods] + draws
    fitted = fit_plan(history, plan, done.by_period, design)
    # Replicates are a fixed number of rows to a candidate.
    marked = shared.stored(candidates.withColumn("__row", F.monotonically_increasing_id()))
    spread = marked.select("__row", *dict.fromkeys([*design.features, *design.contexts])).withColumn("__fit", F.explode(F.array(*[F.lit(f) for f in sorted(fitted.by_fit)])))
    rated = with_rates(spread, "__fit", history, plan, done.by_period, design, own=False)
    scored = calibrated(fitted.score(rated, "__fit", "raw").withColumn("__next", F.lit(following)), done.known, "__next")
    main = F.col("__fit") == following
    others = F.sort_array(F.collect_list(F.when(~main, F.col("probability"))))
    by_row = scored.groupBy("__row").agg(F.max(F.when(main, F.col("raw"))).alias("raw"), F.max(F.when(main, F.col("probability"))).alias("probability"), others.alias("__others"), F.max(F.when(main, seen)).alias("__seen"))
    at = lambda p: F.col("__others")[F.floor(p * (F.size("__others") - 1)).cast("int")] + (p * (F.size("__others") - 1) - F.floor(p * (F.size("__others") - 1))) * (F.col("__others")[F.ceil(p * (F.size("__others") - 1)).cast("int")] - F.col("__others")[F.floor(p * (F.size("__others") - 1)).cast("int")])
    bounds = {"low": F.when(F.size("__others") > 0, at(0.1)), "high": F.when(F.size("__others") > 0, at(0.9))}
    judged_rows = marked.join(by_row.withColumns(bounds), "__row")
    away = out_of_range(judged_rows, history.where(F.col(design.label).isNotNull()), design.features)
    enough = F.col("__seen") >= least_observed
    shown = away.withColumns({c: F.when(enough, F.col(c)) for c in numbers} | {"coverage": F.col("__seen") / len(design.names()), "status": F.when(enough, "estimate").otherwise("insufficient")})
    return shown.drop("__row", "__others", "__seen")


def out_of_range(rows: DataFrame, history: DataFrame, features: Sequence[str]) -> DataFrame:
    """`rows` with out_of_range: the root mean square of robust distances from the history's medians, over the features that a row has."""
    if not features:
        return rows.withColumn("out_of_range", F.lit(None).cast("double"))
    long = history.select(*[F.col(c).cast("double").alias(c) for c in features]).unpivot([], list(features), "__name", "__x").where("__x IS NOT NULL")

    def middles(values: DataFrame) -> dict[str, float]:
        return {r["__name"]: r["m"] for r in counted_quantiles(values, ["__name"], "__x", {"m": 0.5}, ranged=True).collect()}

    middle = middles(long)
    spread = {r["__name"]: r["s"] for r in long.groupBy("__name").agg(F.stddev_pop("__x").alias("s")).collect()}
    at = F.create_map(*[F.lit(x) for pair in middle.items() for x in pair]) if middle else None
    away = middles(long.withColumn("__x", F.abs(F.col("__x") - at[F.col("__name")]))) if middle else {}
    total, have = F.lit(0.0), F.lit(0.0)
    for c in [c for c in features if c in middle]:
        scale = 1.4826 * away[c] if 1.4826 * away[c] > LEAST else spread[c] if spread[c] > LEAST else 1.0
        d = (F.col(c) - middle[c]) / scale
        total, have = total + F.when(F.col(c).isNotNull(), d * d).otherwise(0.0), have + F.col(c).isNotNull().cast("double")
    return rows.withColumn("out_of_range", F.sqrt(F.try_divide(total, have)))


def with_fold(rows: DataFrame, key: str, folds: int = 5, out: str = "fold") -> DataFrame:
    """`rows` with a fold from 0 on, drawn by a hash of the key: for histories without usable periods."""
    return rows.withColumn(out, F.pmod(F.xxhash64(F.lit("fold"), F.col(key).cast("string")), F.lit(folds)).cast("bigint"))


def nested(history: DataFrame, design: Design) -> DataFrame:
    """The key, label, fold, raw and calibrated probability of each labelled row, stored; design.period names the fold.

    A row's model learns from the other folds. Its calibrator learns from scores of those folds that
    models without both the row's fold and the scored one have given, so that the row's fold reaches
    neither. A model without two folds serves both ways; all models are one plan of shared passes.
    Folds whose others lack a class have no scores.
    """
    spark, t = history.sparkSession, design.period
    by_fold = classes(history, design.label, t)
    folds = sorted(by_fold)
    outer = {h: i for i, h in enumerate(folds)}
    pairs = {(h, i): len(folds) + n for n, (h, i) in enumerate((a, b) for a in folds for b in folds if a < b)}
    plan = [(outer[h], q, 1.0) for h in folds for q in folds if q != h] + [(f, q, 1.0) for (h, i), f in pairs.items() for q in folds if q not in (h, i)]
    labelled = history.where(F.col(design.label).isNotNull() & F.col(t).isNotNull()).withColumn(t, F.col(t).cast("bigint"))
    kept = [design.key, design.label, t, "raw"]
    if not plan:
        return shared.stored(labelled.withColumns({"raw": F.lit(None).cast("double"), "probability": F.lit(None).cast("double")}).select(*kept, "probability").limit(0))
    fitted = fit_plan(history, plan, by_fold, design)

    def scored(uses: list[tuple[int, int, int]]) -> DataFrame:
        """Rows by the (fold, calibrated fold, fit) that are asked for."""
        asked = spark.createDataFrame(uses, "__fold bigint, __for bigint, __by bigint")
        rows = labelled.join(F.broadcast(asked), F.col(t) == F.col("__fold"))
        rated = with_rates(rows, "__by", history, plan, by_fold, design, own=False)
        return shared.stored(fitted.score(rated, "__by", "raw").where("raw IS NOT NULL").select(*kept, "__for"))

    inner = scored([(q, h, pairs[min(h, q), max(h, q)]) for h in folds for q in folds if q != h]) if pairs else None
    own = scored([(h, h, outer[h]) for h in folds])
    known = models.Fitted(["raw_logit"], {})
    if inner is not None:
        sizes = classes(inner, design.label, "__for")
        enough = [h for h, c in sizes.items() if c.rows >= CALIBRATION_ROWS and min(c.positives, c.rows - c.positives) >= CALIBRATION_CLASS]
        if enough:
            second = Design(design.key, design.label, "__for", ["raw_logit"], {}, design.calibration_sample, None, design.l2, design.rounds)
            known = fit_plan(inner.withColumn("raw_logit", _raw_logit()), [(h, h, 1.0) for h in enough], sizes, second)
    return shared.stored(calibrated(own, known, "__for").select(*kept, "probability"))


def families(history: DataFrame, design: Design, named: Mapping[str, Sequence[str]]) -> DataFrame:
    """What each family of features alone reaches, judged as `judged` does, with `family`: simple baselines for a model of all of them."""
    out = None
    for name, features in sorted(named.items()):
        alone = replace(design, features=list(features), contexts={})
        one = judged(forward(history, alone), alone).withColumn("family", F.lit(name))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no families given")
    return out
