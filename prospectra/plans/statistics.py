"""Robust statistics and metric queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectra.functions import scalars as S
from prospectra.operators import metrics
from prospectra.operators.robust import counted_quantiles, robust_scale
from prospectra.plans.catalog import register
from prospectra.sources.tables import table

_SCORED = "SELECT l.doc_id, d.lang, l.quality, l.toxic, least(1.0, d.n_chars / 8000.0) AS p FROM labels l JOIN documents d ON d.doc_id = l.doc_id"


def scored(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "lang", F.least(F.lit(1.0), F.col("n_chars") / 8000.0).alias("p"))
    return table(spark, root, "labels").join(docs, "doc_id")


@register(
    "quantiles",
    "SELECT c_mktsegment, quantile_cont(c_acctbal, 0.2) AS q20, quantile_cont(c_acctbal, 0.5) AS q50, quantile_cont(c_acctbal, 0.8) AS q80, quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) AS iqr FROM customer GROUP BY c_mktsegment",
    rounded=["q20", "q50", "q80", "iqr"], digits=6
)
def quantiles(spark: SparkSession, root: str) -> DataFrame:
    rows = counted_quantiles(table(spark, root, "customer"), ["c_mktsegment"], "c_acctbal", {"q20": 0.2, "q50": 0.5, "q80": 0.8, "q25": 0.25, "q75": 0.75}, ranged=True)
    return rows.select("c_mktsegment", "q20", "q50", "q80", (F.col("q75") - F.col("q25")).alias("iqr"))


@register(
    "mad_scale",
    """SELECT p_brand, CASE WHEN 1.4826 * mad(p_retailprice) > 1e-9 THEN 1.4826 * mad(p_retailprice) WHEN stddev_pop(p_retailprice) > 1e-9 THEN stddev_pop(p_retailprice) ELSE 1 END AS scale
       FROM part GROUP BY p_brand""",
    rounded=["scale"], digits=6
)
def mad_scale(spark: SparkSession, root: str) -> DataFrame:
    return robust_scale(table(spark, root, "part"), ["p_brand"], {"p_retailprice": "scale"})


@register(
    "dispersion",
    "SELECT c_nationkey, avg(c_acctbal) AS mean, var_pop(c_acctbal) AS var_p, var_samp(c_acctbal) AS var_s, stddev_pop(c_acctbal) AS sd_p FROM customer GROUP BY c_nationkey",
    rounded=["mean", "var_p", "var_s", "sd_p"], digits=4
)
def dispersion(spark: SparkSession, root: str) -> DataFrame:
    a = "c_acctbal"
    return table(spark, root, "customer").groupBy("c_nationkey").agg(F.avg(a).alias("mean"), F.var_pop(a).alias("var_p"), F.var_samp(a).alias("var_s"), F.stddev_pop(a).alias("sd_p"))


@register(
    "metric_score_target",
    """WITH s AS (SELECT c_mktsegment, median(c_acctbal) AS m, CASE WHEN 1.4826 * mad(c_acctbal) > 1e-9 THEN 1.4826 * mad(c_acctbal) WHEN stddev_pop(c_acctbal) > 1e-9 THEN stddev_pop(c_acctbal) ELSE 1 END AS sc FROM customer GROUP BY 1)
       SELECT c_custkey, round(100 * exp(-0.5 * power((c_acctbal - m) / sc / 1.75, 2)), 6) AS score FROM customer JOIN s USING (c_mktsegment)""",
)
def metric_score_target(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    scale = robust_scale(rows, ["c_mktsegment"], {"c_acctbal": "sc"}, medians=True)
    return rows.join(scale, "c_mktsegment").select("c_custkey", F.round(S.target_score(F.col("c_acctbal"), F.col("m_c_acctbal"), F.col("sc")), 6).alias("score"))


@register(
    "weighted_mean_cov",
    """SELECT l_suppkey, sum(l_quantity * CASE WHEN l_returnflag <> 'N' THEN l_discount END) / sum(CASE WHEN l_returnflag <> 'N' THEN l_quantity END) AS wmean,
              avg(CASE WHEN l_returnflag <> 'N' THEN 1.0 ELSE 0.0 END) AS coverage FROM lineitem GROUP BY l_suppkey""",
    rounded=["wmean", "coverage"], digits=9
)
def weighted_mean_cov(spark: SparkSession, root: str) -> DataFrame:
    known = F.col("l_returnflag") != "N"
    rows = table(spark, root, "lineitem").groupBy("l_suppkey")
    return rows.agg((F.sum(F.when(known, F.col("l_quantity") * F.col("l_discount"))) / F.sum(F.when(known, F.col("l_quantity")))).alias("wmean"), F.avg(F.when(known, 1.0).otherwise(0.0)).alias("coverage"))


@register(
    "roc_auc",
    f"""WITH s AS ({_SCORED}), r AS (SELECT lang, quality AS y, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2.0 AS rk FROM s)
       SELECT lang, CASE WHEN sum(y) * sum(1 - y) > 0 THEN (sum(y * rk) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) END AS auc FROM r GROUP BY lang""",
    rounded=["auc"], digits=9
)
def roc_auc(spark: SparkSession, root: str) -> DataFrame:
    return metrics.roc_auc(scored(spark, root), ["lang"], "p", "quality")


@register(
    "average_precision",
    f"""WITH s AS ({_SCORED}), r AS (SELECT lang, toxic, row_number() OVER w AS n, sum(toxic) OVER (w ROWS UNBOUNDED PRECEDING) AS hits FROM s WINDOW w AS (PARTITION BY lang ORDER BY p DESC, doc_id))
       SELECT lang, avg(CASE WHEN toxic = 1 THEN CAST(hits AS DOUBLE) / n END) AS ap FROM r GROUP BY lang""",
    rounded=["ap"], digits=9
)
def average_precision(spark: SparkSession, root: str) -> DataFrame:
    return metrics.average_precision(scored(spark, root), ["lang"], "p", "toxic", "doc_id")


@register(
    "brier_log_loss",
    f"""SELECT lang, avg(power(p - quality, 2)) AS brier, avg(-(quality * ln(q) + (1 - quality) * ln(1 - q))) AS log_loss
       FROM (SELECT *, greatest(1e-12, least(1 - 1e-12, p)) AS q FROM ({_SCORED})) GROUP BY lang""",
    rounded=["brier", "log_loss"], digits=9
)
def brier_log_loss(spark: SparkSession, root: str) -> DataFrame:
    p, y = F.col("p"), F.col("quality")
    return scored(spark, root).groupBy("lang").agg(metrics.brier(p, y).alias("brier"), metrics.log_loss(p, y).alias("log_loss"))


@register(
    "ece_bins",
    f"""WITH b AS (SELECT lang, least(9, floor(p * 10)) AS b, count(*) AS n, avg(p) AS p, avg(quality) AS y FROM ({_SCORED}) GROUP BY 1, 2)
       SELECT lang, sum(n * abs(p - y)) / sum(n) AS ece FROM b GROUP BY lang""",
    rounded=["ece"], digits=9
)
def ece_bins(spark: SparkSession, root: str) -> DataFrame:
    return metrics.calibration_error(scored(spark, root), ["lang"], "p", "quality")


@register(
    "f1_at",
    f"""SELECT lang, coalesce(2.0 * sum(CASE WHEN p >= 0.5 THEN toxic ELSE 0 END) / nullif(sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) + sum(toxic), 0), 0) AS f1 FROM ({_SCORED}) GROUP BY lang""",
    rounded=["f1"], digits=9
)
def f1_at(spark: SparkSession, root: str) -> DataFrame:
    hit, y = F.when(F.col("p") >= 0.5, 1).otherwise(0), F.col("toxic")
    return scored(spark, root).groupBy("lang").agg(metrics.f1(F.sum(hit * y), F.sum(hit * (1 - y)), F.sum((1 - hit) * y)).alias("f1"))


@register(
    "f1_search",
    f"""WITH c AS (SELECT lang, round(p, 3) AS t, sum(toxic) AS tp, count(*) AS n FROM ({_SCORED}) GROUP BY 1, 2),
       r AS (SELECT lang, t, sum(tp) OVER (PARTITION BY lang ORDER BY t DESC) AS tp, sum(n) OVER (PARTITION BY lang ORDER BY t DESC) AS n, sum(tp) OVER (PARTITION BY lang) AS y FROM c),
       f AS (SELECT lang, t, round(coalesce(2.0 * tp / nullif(n + y, 0), 0), 9) AS f1 FROM r)
       SELECT lang, t AS threshold, f1 FROM f QUALIFY row_number() OVER (PARTITION BY lang ORDER BY f1 DESC, t) = 1""",
)
def f1_search(spark: SparkSession, root: str) -> DataFrame:
    return metrics.best_f1(scored(spark, root).withColumn("t", F.round("p", 3)), ["lang"], "t", "toxic")


@register(
    "board_topk",
    """WITH o AS (SELECT year(o_orderdate) AS y, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS f, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders),
       i AS (SELECT y, sum(f) AS n FROM o GROUP BY y)
       SELECT CAST(o.y AS INTEGER) AS year, sum(CASE WHEN r <= 25 THEN f ELSE 0 END) / CAST(least(25, count(*)) AS DOUBLE) AS precision, sum(CASE WHEN r <= 25 THEN f ELSE 0 END) / CAST(sum(f) AS DOUBLE) AS recall,
              sum(CASE WHEN r <= 25 THEN f / log2(r + 1) ELSE 0 END) / (SELECT sum(1 / log2(k + 1)) FROM range(1, 26) t(k) WHERE k <= any_value(i.n)) AS ndcg
       FROM o JOIN i ON i.y = o.y GROUP BY o.y""",
    rounded=["precision", "recall", "ndcg"], digits=9
)
def board_topk(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "orders").select(F.year("o_orderdate").alias("year"), "o_orderkey", "o_totalprice", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("f"))
    return metrics.board(rows, ["year"], "o_totalprice", "f", "o_orderkey", 25)
