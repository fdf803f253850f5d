"""Queries of sampling, model fits, release gates, ledgers and event windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectra.operators import metrics, models
from prospectra.plans.catalog import register
from prospectra.sources.tables import table
from prospectra.streaming import windows


def _labelled(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "labels").join(table(spark, root, "documents"), "doc_id").select("lang", "doc_id", "toxic", "n_chars")


@register(
    "case_control_sample",
    """SELECT lang, doc_id, toxic FROM (SELECT lang, doc_id, toxic, sum(toxic) OVER (PARTITION BY lang) AS pos,
              row_number() OVER (PARTITION BY lang, toxic ORDER BY sha256('sample:' || CAST(doc_id AS VARCHAR)), doc_id) AS place
       FROM labels JOIN documents USING (doc_id)) WHERE toxic = 1 OR (toxic = 0 AND place <= least(500, greatest(20, 6 * coalesce(pos, 0))))""",
)
def case_control_sample(spark: SparkSession, root: str) -> DataFrame:
    return models.case_control(_labelled(spark, root).select("lang", "doc_id", "toxic"), "lang", "toxic", "doc_id", 20, 500)


def order_rows(spark: SparkSession, root: str) -> DataFrame:
    """Orders as rows of a model: two features, a late status and the year."""
    orders = table(spark, root, "orders")
    return orders.select("o_orderkey", "o_totalprice", F.month("o_orderdate").alias("month"), (F.col("o_orderstatus") == "O").cast("int").alias("late"), F.year("o_orderdate").alias("year"))


def _years(rows: DataFrame) -> list[int]:
    return [r[0] for r in rows.select("year").where("year IS NOT NULL").distinct().orderBy("year").collect()]


@register("expanding_validation")
def expanding_validation(spark: SparkSession, root: str) -> DataFrame:
    """Per year, how well a model of all earlier years does on it."""
    rows = order_rows(spark, root)
    fitted = models.fit_logistic(rows, models.expanding_plan(_years(rows)), ["o_totalprice", "month"], "late", "year")
    scored = fitted.score(rows, "year").where("probability IS NOT NULL")
    p, y = F.col("probability"), F.col("late")
    return scored.groupBy("year").agg(F.count("*").alias("n"), metrics.brier(p, y).alias("brier"), metrics.log_loss(p, y).alias("log_loss"))


@register("bootstrap_interval")
def bootstrap_interval(spark: SparkSession, root: str) -> DataFrame:
    """An 80 % interval of each weight over replicates that draw whole years."""
    rows = order_rows(spark, root)
    fitted = models.fit_logistic(rows, models.bootstrap_plan(_years(rows), 20, 8128), ["o_totalprice", "month"], "late", "year")
    weights = [(fit, name, float(v)) for fit, (_, _, _, w) in fitted.by_fit.items() for name, v in zip([*fitted.features, "intercept"], w, strict=True)]
    by_fit = spark.createDataFrame(weights, "fit bigint, term string, weight double")
    return by_fit.groupBy("term").agg(F.percentile("weight", 0.1).alias("low"), F.percentile("weight", 0.9).alias("high"), F.count("*").alias("fits"))


@register(
    "intercept_correction",
    """SELECT lang, ln(greatest(1e-9, least(1 - 1e-9, r)) / (1 - greatest(1e-9, least(1 - 1e-9, r)))) - ln(1.0 / 6) AS correction
       FROM (SELECT lang, avg(CAST(toxic AS DOUBLE)) AS r FROM labels JOIN documents USING (doc_id) GROUP BY lang)""",
    rounded=["correction"], digits=9
)
def intercept_correction(spark: SparkSession, root: str) -> DataFrame:
    """What a model fitted at six negatives to a positive adds to its intercept, per language."""
    rate = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.avg("toxic")))
    return _labelled(spark, root).groupBy("lang").agg((F.log(rate / (1 - rate)) - F.log(F.lit(1.0 / 6))).alias("correction"))


@register(
    "promotion_gate",
    """SELECT lang, n, champion, challenger, n >= 20 AND challenger <= champion AS promoted FROM (
         SELECT lang, count(*) AS n, avg((0.1 - toxic) * (0.1 - toxic)) AS champion,
                avg((least(1.0, n_chars / 8000.0) - toxic) * (least(1.0, n_chars / 8000.0) - toxic)) AS challenger
         FROM labels JOIN documents USING (doc_id) GROUP BY lang)""",
    rounded=["champion", "challenger"], digits=9
)
def promotion_gate(spark: SparkSession, root: str) -> DataFrame:
    """Whether a challenger's Brier score lets it take the champion's place."""
    y = F.col("toxic")
    rated = _labelled(spark, root).groupBy("lang").agg(
        F.count("*").alias("n"),
        metrics.brier(F.lit(0.1), y).alias("champion"),
        metrics.brier(F.least(F.lit(1.0), F.col("n_chars") / 8000.0), y).alias("challenger"),
    )
    return rated.withColumn("promoted", (F.col("n") >= 20) & (F.col("challenger") <= F.col("champion")))


@register("contract_id", "SELECT p_brand, left(sha256(string_agg(DISTINCT p_type, '|' ORDER BY p_type)), 16) AS contract FROM part GROUP BY p_brand")
def contract_id(spark: SparkSession, root: str) -> DataFrame:
    """The identity of a list of features: part types, of which there are few."""
    names = F.array_join(F.sort_array(F.collect_set("p_type")), "|")
    return table(spark, root, "part").groupBy("p_brand").agg(F.substring(F.sha2(names, 256), 1, 16).alias("contract"))


@register(
    "ledger_audit",
    """SELECT CASE WHEN l_orderkey IS NULL THEN 'undeclared' WHEN o_orderkey IS NULL THEN 'missing' WHEN lines > 4 THEN 'large' ELSE 'sound' END AS status, count(*) AS n
       FROM orders FULL JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey GROUP BY 1""",
)
def ledger_audit(spark: SparkSession, root: str) -> DataFrame:
    """Declared artifacts against those seen."""
    declared = table(spark, root, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    both = table(spark, root, "orders").select("o_orderkey").join(declared, F.col("l_orderkey") == F.col("o_orderkey"), "full")
    status = F.when(F.col("l_orderkey").isNull(), "undeclared").when(F.col("o_orderkey").isNull(), "missing").when(F.col("lines") > 4, "large").otherwise("sound")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@register(
    "box_rows_routed",
    """SELECT event_id, 'clicks' AS stat, value FROM events WHERE event_type = 'click' AND value IS NOT NULL
       UNION ALL SELECT event_id, 'spend', value FROM events WHERE event_type = 'purchase' AND value IS NOT NULL
       UNION ALL SELECT event_id, 'orders', 1.0 FROM events WHERE event_type = 'purchase'""",
)
def box_rows_routed(spark: SparkSession, root: str) -> DataFrame:
    """A wide row as the long rows of its category's statistics, in one pass."""
    kind, value = F.col("event_type"), F.col("value").cast("double")

    def stat(on: str, name: str, v: Column) -> Column:
        return F.struct(F.lit(name).alias("stat"), F.when(kind == on, v).alias("value"))

    rows = F.array(stat("click", "clicks", value), stat("purchase", "spend", value), stat("purchase", "orders", F.lit(1.0)))
    return table(spark, root, "events").select("event_id", F.inline(F.filter(rows, lambda s: s["value"].isNotNull())))


@register(
    "name_aliases",
    """SELECT s_suppkey, unnest(list_distinct([lower(s_name), replace(lower(s_name), '#', ' '), split_part(lower(s_name), '#', 1)])) AS alias FROM supplier""",
)
def name_aliases(spark: SparkSession, root: str) -> DataFrame:
    name = F.lower("s_name")
    forms = F.array_distinct(F.array(name, F.replace(name, F.lit("#"), F.lit(" ")), F.split_part(name, F.lit("#"), F.lit(1))))
    return table(spark, root, "supplier").select("s_suppkey", F.explode(forms).alias("alias"))


@register(
    "fit_reasons",
    """SELECT p_partkey, 'large' AS reason FROM part WHERE p_size >= 40 UNION ALL SELECT p_partkey, 'small' FROM part WHERE p_size <= 10
       UNION ALL SELECT p_partkey, 'premium' FROM part WHERE p_retailprice >= 1500""",
)
def fit_reasons(spark: SparkSession, root: str) -> DataFrame:
    c = F.col
    reasons = F.array_compact(F.array(F.when(c("p_size") >= 40, "large"), F.when(c("p_size") <= 10, "small"), F.when(c("p_retailprice") >= 1500, "premium")))
    return table(spark, root, "part").select("p_partkey", F.explode(reasons).alias("reason"))


@register(
    "tumbling_totals",
    "SELECT event_type, strftime(ts, '%Y-%m-%d') AS began, count(*) AS n, sum(value) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
    rounded=["total"], digits=4
)
def tumbling_totals(spark: SparkSession, root: str) -> DataFrame:
    totals = windows.tumbling(table(spark, root, "events"), "event_type", "value")
    return totals.withColumn("began", F.date_format("began", "yyyy-MM-dd"))


@register(
    "session_counts",
    """SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (
         SELECT user_id, run, count(*) AS n FROM (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM (
           SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh
           FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)) GROUP BY 1, 2) GROUP BY 1""",
)
def session_counts(spark: SparkSession, root: str) -> DataFrame:
    found = windows.sessions(table(spark, root, "events"), "user_id", gap="6 hours")
    return found.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))
