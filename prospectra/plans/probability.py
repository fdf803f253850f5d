"""Queries of past-only calibration and the probability of an outcome in the next period."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectra.operators import probability
from prospectra.plans.catalog import register
from prospectra.sources.tables import table


def large_orders(spark: SparkSession, root: str) -> DataFrame:
    """Orders with lines: whether these are worth 300,000 or more, how many they are, the customer's nation and segment, the year."""
    lines = table(spark, root, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.sum("l_extendedprice").alias("worth"))
    orders = table(spark, root, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, root, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return orders.select(
        "o_orderkey", (F.col("worth") >= 300000).cast("int").alias("large"), F.year("o_orderdate").alias("year"), F.col("n_lines").cast("double").alias("n_lines"), "o_totalprice",
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"), F.col("c_nationkey").cast("string").alias("nation"), F.col("c_mktsegment").alias("segment"),
    )


PLAIN = probability.Design("o_orderkey", "large", "year", ["n_lines", "o_totalprice"], {}, None, None)
WHOLE = probability.Design("o_orderkey", "large", "year", ["n_lines", "o_totalprice", "balance"], {"nation": 30.0, "segment": 12.0})


def _newton(name: str, rows: str, k: int, rounds: int, l2: float) -> str:
    """CTEs <name>0 to <name><rounds>: per fit the weights b0 (free) to bk of a logistic fit over `rows` (fit, y, z1 to zk), by Newton steps from zero."""
    z = ["1.0", *[f"z{i}" for i in range(1, k + 1)]]
    out = f"{name}0 AS (SELECT fit, {', '.join(f'CAST(0 AS DOUBLE) AS b{i}' for i in range(k + 1))} FROM (SELECT DISTINCT fit FROM {rows}))"
    for r in range(rounds):
        line = " + ".join(f"w.b{i} * {z[i]}" for i in range(k + 1))
        g = [f"avg((p - y) * {z[i]}) + {l2 if i else 0} * any_value(b{i}) AS g{i}" for i in range(k + 1)]
        h = [f"avg(p * (1 - p) * {z[i]} * {z[j]}) + {(l2 if i else 0) if i == j else 0} AS h{i}{j}" for i in range(k + 1) for j in range(i + 1)]
        at = lambda i, j: f"h{max(i, j)}{min(i, j)}"

        def det(columns: list[list[str]]) -> str:
            if len(columns) == 2:
                return f"({columns[0][0]} * {columns[1][1]} - {columns[1][0]} * {columns[0][1]})"
            a, b, c = columns
            return f"({a[0]} * ({b[1]} * {c[2]} - {c[1]} * {b[2]}) - {b[0]} * ({a[1]} * {c[2]} - {c[1]} * {a[2]}) + {c[0]} * ({a[1]} * {b[2]} - {b[1]} * {a[2]}))"

        matrix = [[at(i, j) for i in range(k + 1)] for j in range(k + 1)]
        slope = [f"g{i}" for i in range(k + 1)]
        steps = [f"b{i} - {det([slope if j == i else matrix[j] for j in range(k + 1)])} / {det(matrix)} AS b{i}" for i in range(k + 1)]
        out += f""",
{name}{r + 1} AS MATERIALIZED (SELECT fit, {', '.join(steps)} FROM (
  SELECT fit, {', '.join(f'any_value(b{i}) AS b{i}' for i in range(k + 1))}, {', '.join(g)}, {', '.join(h)} FROM (
    SELECT d.*, {', '.join(f'w.b{i}' for i in range(k + 1))}, 1 / (1 + exp(-({line}))) AS p FROM {rows} d JOIN {name}{r} w ON w.fit = d.fit) GROUP BY fit))"""
    return out


_PAST_ONLY = f"""
WITH o AS MATERIALIZED (
  SELECT o_orderkey AS id, CAST(worth >= 300000 AS INTEGER) AS y, year(o_orderdate) AS t, CAST(n AS DOUBLE) AS x1, o_totalprice AS x2
  FROM orders JOIN (SELECT l_orderkey, count(*) AS n, sum(l_extendedprice) AS worth FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey WHERE o_orderdate IS NOT NULL),
f AS (SELECT DISTINCT t AS fit FROM o WHERE t > (SELECT min(t) FROM o)),
s AS (SELECT fit, avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2 FROM f JOIN o ON o.t < f.fit GROUP BY fit),
d AS MATERIALIZED (SELECT s.fit, o.y, (x1 - m1) / s1 AS z1, (x2 - m2) / s2 AS z2 FROM s JOIN o ON o.t < s.fit),
{_newton("w", "d", 2, 12, 0.12)},
r AS MATERIALIZED (
  SELECT id, y, t, 1 / (1 + exp(-(b0 + b1 * (x1 - m1) / s1 + b2 * (x2 - m2) / s2))) AS raw FROM o JOIN s ON s.fit = o.t JOIN w12 ON w12.fit = o.t),
q AS MATERIALIZED (SELECT *, ln(greatest(1e-9, least(1 - 1e-9, raw)) / (1 - greatest(1e-9, least(1 - 1e-9, raw)))) AS l FROM r),
c AS (
  SELECT fit, avg(l) AS m, stddev_pop(l) AS s FROM f JOIN q ON q.t < f.fit GROUP BY fit
  HAVING count(*) >= 40 AND sum(y) >= 8 AND count(*) - sum(y) >= 8),
e AS MATERIALIZED (SELECT c.fit, q.y, (l - m) / s AS z1 FROM c JOIN q ON q.t < c.fit),
{_newton("v", "e", 1, 12, 0.12)}
SELECT q.id AS o_orderkey, q.t AS year, q.raw, coalesce(1 / (1 + exp(-(b0 + b1 * (l - m) / s))), q.raw) AS probability
FROM q LEFT JOIN c ON c.fit = q.t LEFT JOIN v12 ON v12.fit = q.t
"""


@register("past_only_calibration", _PAST_ONLY, rounded=["raw", "probability"], digits=6)
def past_only_calibration(spark: SparkSession, root: str) -> DataFrame:
    """Each order's probability by the model of all earlier years, and through the calibrator of earlier years' scores."""
    done = probability.forward(large_orders(spark, root).select("o_orderkey", "large", "year", "n_lines", "o_totalprice"), PLAIN)
    return done.scored.select("o_orderkey", "year", "raw", "probability")


@register("next_period_validation")
def next_period_validation(spark: SparkSession, root: str) -> DataFrame:
    """Per judged year how the whole model did: sampled negatives, categories as rates, calibrated by earlier years."""
    return probability.judged(probability.forward(large_orders(spark, root), WHOLE), WHOLE)


@register("next_period_probability")
def next_period_probability(spark: SparkSession, root: str) -> DataFrame:
    """The orders of the last year, judged by a model of all years before it, with intervals."""
    rows = large_orders(spark, root)
    last = rows.agg(F.max("year")).collect()[0][0]
    history = rows.where(F.col("year") < F.lit(last))
    candidates = rows.where(F.col("year") == F.lit(last)).drop("large")
    return probability.predict(candidates, history, WHOLE).select("o_orderkey", "status", "raw", "probability", "low", "high", "out_of_range", "coverage")


@register("nested_folds")
def nested_folds(spark: SparkSession, root: str) -> DataFrame:
    """Each order's probability out of fold, folds drawn by a hash, calibrated by folds within folds."""
    rows = probability.with_fold(large_orders(spark, root), "o_orderkey")
    return probability.nested(rows, replace(WHOLE, period="fold")).select("o_orderkey", "fold", "raw", "probability")


@register("simple_baselines")
def simple_baselines(spark: SparkSession, root: str) -> DataFrame:
    """Per judged year what two families of features reach alone."""
    return probability.families(large_orders(spark, root), WHOLE, {"lines": ["n_lines"], "money": ["o_totalprice", "balance"]})
