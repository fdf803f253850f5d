"""Grouped totals, audits, encoders and outcome horizons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectra.functions import scalars as S
from prospectra.operators import audits
from prospectra.plans.catalog import register
from prospectra.plans.statistics import scored
from prospectra.sources.tables import table


@register(
    "box_week_totals",
    "SELECT user_id, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, sum(value) AS total, max(value) AS longest, count(DISTINCT CAST(ts AS DATE)) AS games FROM events GROUP BY 1, 2",
    rounded=["total"], digits=4
)
def box_week_totals(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "events").select("user_id", F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week"), "value", F.to_date("ts").alias("day"))
    return rows.groupBy("user_id", "week").agg(F.sum("value").alias("total"), F.max("value").alias("longest"), F.countDistinct("day").alias("games"))


@register(
    "season_totals",
    "SELECT user_id, event_type, sum(v) AS total, count(*) AS games, strftime(max(day), '%Y-%m-%d') AS latest FROM (SELECT user_id, event_type, CAST(ts AS DATE) AS day, max(value) AS v FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2",
    rounded=["total"], digits=4
)
def season_totals(spark: SparkSession, root: str) -> DataFrame:
    daily = table(spark, root, "events").groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.max("value").alias("v"))
    return daily.groupBy("user_id", "event_type").agg(F.sum("v").alias("total"), F.count("*").alias("games"), F.date_format(F.max("day"), "yyyy-MM-dd").alias("latest"))


KINDS = ["click", "error", "purchase", "signup", "view"]


@register("stat_pivot", "SELECT user_id, " + ", ".join(f"sum(value) FILTER (WHERE event_type = '{k}') AS {k}" for k in KINDS) + " FROM events GROUP BY user_id", rounded=["click", "error", "purchase", "signup", "view"], digits=4)
def stat_pivot(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").select("user_id", "event_type", "value").groupBy("user_id").pivot("event_type", KINDS).agg(F.sum("value"))


@register(
    "stat_unpivot",
    "SELECT l_returnflag, stat, value FROM (SELECT l_returnflag, sum(l_quantity) AS quantity, sum(l_tax) AS tax, sum(l_discount) AS discount FROM lineitem GROUP BY 1) UNPIVOT (value FOR stat IN (quantity, tax, discount))",
    rounded=["value"], digits=3
)
def stat_unpivot(spark: SparkSession, root: str) -> DataFrame:
    wide = table(spark, root, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("quantity"), F.sum("l_tax").alias("tax"), F.sum("l_discount").alias("discount"))
    return wide.unpivot(["l_returnflag"], ["quantity", "tax", "discount"], "stat", "value").where("value IS NOT NULL")


@register(
    "horizon_outcome",
    """WITH f AS (SELECT o_custkey, min(year(o_orderdate)) AS y FROM orders GROUP BY 1), last AS (SELECT max(year(o_orderdate)) AS y FROM orders),
       t AS (SELECT f.o_custkey, f.y, count(*) AS n FROM f JOIN orders o ON o.o_custkey = f.o_custkey AND year(o_orderdate) BETWEEN f.y AND f.y + 2 GROUP BY 1, 2)
       SELECT o_custkey, t.y AS first_year, n, CASE WHEN t.y + 2 > last.y THEN 'right_censored' WHEN n >= 5 THEN 'contributor' ELSE 'other' END AS outcome FROM t, last""",
)
def horizon_outcome(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "orders").select("o_custkey", F.year("o_orderdate").cast("long").alias("year"))
    return audits.horizon(rows, "o_custkey", "year", span=2, least=5)


@register(
    "target_encode_loo",
    """WITH s AS (SELECT l.doc_id, d.source, l.quality AS y FROM labels l JOIN documents d ON d.doc_id = l.doc_id), a AS (SELECT sum(y) AS p, count(*) AS n FROM s), g AS (SELECT source, sum(y) AS p, count(*) AS n FROM s GROUP BY 1)
       SELECT doc_id, round((g.p - y + 12 * (a.p - y) / CAST(a.n - 1 AS DOUBLE)) / (g.n - 1 + 12), 9) AS rate FROM s JOIN g ON g.source = s.source, a""",
)
def target_encode_loo(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "labels").select("doc_id", F.col("quality").alias("y")).join(table(spark, root, "documents").select("doc_id", "source"), "doc_id")
    return audits.encode_left_out(rows, "source", "y", 12.0, "rate").select("doc_id", F.round("rate", 9).alias("rate"))


@register(
    "missingness_gap",
    """WITH s AS (SELECT d.lang, l.quality AS y, CASE WHEN d.n_chars % 3 = 0 THEN NULL ELSE d.n_chars END AS size, CASE WHEN l.toxic = 1 THEN NULL ELSE 1 END AS mark FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
       u AS (SELECT lang, y, 'size' AS feature, size IS NOT NULL AS seen FROM s UNION ALL SELECT lang, y, 'mark', mark IS NOT NULL FROM s)
       SELECT lang, feature, round(avg(CASE WHEN y = 1 THEN CASE WHEN seen THEN 1.0 ELSE 0.0 END END), 9) AS good, round(avg(CASE WHEN y = 0 THEN CASE WHEN seen THEN 1.0 ELSE 0.0 END END), 9) AS bad FROM u GROUP BY 1, 2""",
)
def missingness_gap(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "lang", F.when(F.col("n_chars") % 3 != 0, F.col("n_chars")).alias("size"))
    rows = table(spark, root, "labels").join(docs, "doc_id").select("lang", F.col("quality").alias("y"), "size", F.when(F.col("toxic") != 1, 1).alias("mark"))
    return audits.observed_rates(rows, ["lang"], "y", ["size", "mark"])


@register(
    "feature_select",
    """SELECT f.lang, count(n_chars) >= greatest(20, ceil(0.015 * count(*))) AND coalesce(stddev_pop(n_chars), 0) >= 1e-8 AS use_size, count(q) >= greatest(20, ceil(0.015 * count(*))) AND coalesce(stddev_pop(q), 0) >= 1e-8 AS use_quality
       FROM (SELECT d.lang, d.n_chars, l.quality AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) f GROUP BY f.lang""",
)
def feature_select(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents").select("doc_id", "lang", "n_chars").join(table(spark, root, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.groupBy("lang").agg(audits.usable("n_chars").alias("use_size"), audits.usable("quality").alias("use_quality"))


@register(
    "room_metrics",
    """SELECT n.n_nationkey, k.k AS room, count(s.s_suppkey) AS members, coalesce(avg(s.s_acctbal), 0) AS mean_balance, sum(CASE WHEN s.s_acctbal > 5000 THEN 1 ELSE 0 END) / CAST(nullif(count(s.s_suppkey), 0) AS DOUBLE) AS veteran_share
       FROM nation n CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) k LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey AND s.s_suppkey % 3 = k.k GROUP BY 1, 2""",
    rounded=["mean_balance", "veteran_share"], digits=6
)
def room_metrics(spark: SparkSession, root: str) -> DataFrame:
    grid = table(spark, root, "nation").select("n_nationkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("room"))
    rows = table(spark, root, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), (F.col("s_suppkey") % 3).cast("int").alias("room"), "s_suppkey", "s_acctbal")
    old = F.sum(F.when(F.col("s_acctbal") > 5000, 1).otherwise(0))
    return grid.join(rows, ["n_nationkey", "room"], "left").groupBy("n_nationkey", "room").agg(
        F.count("s_suppkey").alias("members"), F.coalesce(F.avg("s_acctbal"), F.lit(0.0)).alias("mean_balance"), F.try_divide(old, F.count("s_suppkey")).alias("veteran_share")
    )


@register(
    "need_score",
    """SELECT s_suppkey, round((0.4 * (100 - (s_acctbal + 1000) / 110) + CASE WHEN s_suppkey % 4 > 0 THEN 0.3 * (s_suppkey % 100) ELSE 0 END + 0.3 * (s_nationkey * 4)) / (0.4 + CASE WHEN s_suppkey % 4 > 0 THEN 0.3 ELSE 0 END + 0.3), 6) AS need FROM supplier""",
)
def need_score(spark: SparkSession, root: str) -> DataFrame:
    depth, moving, poor = 100 - (F.col("s_acctbal") + 1000) / 110, F.when(F.col("s_suppkey") % 4 > 0, F.col("s_suppkey") % 100), F.col("s_nationkey") * 4
    score = S.weighted_mean([(depth, F.lit(0.4)), (moving, F.lit(0.3)), (poor, F.lit(0.3))])
    return table(spark, root, "supplier").select("s_suppkey", F.round(score, 6).alias("need"))


@register(
    "blend_maturity",
    """WITH t AS (SELECT o_custkey, year(o_orderdate) AS y, round(sum(o_totalprice), 0) AS v, count(*) AS n FROM orders GROUP BY 1, 2)
       SELECT a.o_custkey, a.y AS year, round(CASE WHEN b.v IS NULL THEN a.v ELSE a.v * greatest(0.15, least(0.75, a.n / 8.0)) + b.v * (1 - greatest(0.15, least(0.75, a.n / 8.0))) END, 4) AS blended,
              0.35 + 0.65 * least(1.0, a.n / 8.0) AS maturity FROM t a LEFT JOIN t b ON b.o_custkey = a.o_custkey AND b.y = a.y - 1""",
)
def blend_maturity(spark: SparkSession, root: str) -> DataFrame:
    totals = table(spark, root, "orders").groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("year")).agg(F.round(F.sum("o_totalprice"), 0).alias("v"), F.count("*").alias("n"))
    before = totals.select("o_custkey", (F.col("year") + 1).alias("year"), F.col("v").alias("b"))
    w = S.clamp(F.col("n") / 8.0, 0.15, 0.75)
    blended = F.when(F.col("b").isNull(), F.col("v")).otherwise(F.col("v") * w + F.col("b") * (1 - w))
    return totals.join(before, ["o_custkey", "year"], "left").select("o_custkey", "year", F.round(blended, 4).alias("blended"), (0.35 + 0.65 * F.least(F.lit(1.0), F.col("n") / 8.0)).alias("maturity"))


@register(
    "record_audit",
    """SELECT l_orderkey, l_linenumber, count(*) AS copies, min(l_partkey) AS first_part, count(DISTINCT l_partkey) > 1 AS conflict FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
)
def record_audit(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "lineitem").groupBy("l_orderkey", "l_linenumber")
    return rows.agg(F.count("*").alias("copies"), F.min("l_partkey").alias("first_part"), (F.min("l_partkey") < F.max("l_partkey")).alias("conflict")).where("copies > 1")


@register(
    "contract_audit",
    """SELECT count(*) AS n, CAST(sum(CASE WHEN l_discount NOT BETWEEN 0 AND 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS bad_discount, CAST(sum(CASE WHEN l_quantity < 2 THEN 1 ELSE 0 END) AS BIGINT) AS low_quantity, CAST(sum(CASE WHEN l_returnflag NOT IN ('A', 'R') THEN 1 ELSE 0 END) AS BIGINT) AS other_flag, CAST(sum(CASE WHEN l_shipdate IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS undated FROM lineitem""",
)
def contract_audit(spark: SparkSession, root: str) -> DataFrame:
    rules = {
        "bad_discount": ~F.col("l_discount").between(0, 0.05),
        "low_quantity": F.col("l_quantity") < 2,
        "other_flag": ~F.col("l_returnflag").isin("A", "R"),
        "undated": F.col("l_shipdate").isNull(),
    }
    return audits.violations(table(spark, root, "lineitem"), rules)


@register("pick_band", f"SELECT lang, quantile_cont(p, 0.2) AS low, quantile_cont(p, 0.5) AS mid, quantile_cont(p, 0.8) AS high FROM (SELECT d.lang, least(1.0, d.n_chars / 8000.0) AS p FROM labels l JOIN documents d ON d.doc_id = l.doc_id) GROUP BY lang HAVING count(*) >= 3", rounded=["low", "mid", "high"], digits=9)
def pick_band(spark: SparkSession, root: str) -> DataFrame:
    bands = scored(spark, root).groupBy("lang").agg(F.percentile("p", F.array(F.lit(0.2), F.lit(0.5), F.lit(0.8))).alias("q"), F.count("*").alias("n"))
    return bands.where("n >= 3").select("lang", F.col("q")[0].alias("low"), F.col("q")[1].alias("mid"), F.col("q")[2].alias("high"))
