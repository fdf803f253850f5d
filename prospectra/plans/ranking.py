"""Ranking, percentile and top-k queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectra.operators import ranks, rosters, windows
from prospectra.plans.catalog import register
from prospectra.sources.tables import table


@register(
    "peer_midrank",
    """
    WITH r AS (
      SELECT c_mktsegment, c_custkey,
             rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) - 1 AS lower_n,
             count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) AS equal_n,
             count(*) OVER (PARTITION BY c_mktsegment) AS peers
      FROM customer)
    SELECT c_mktsegment, c_custkey, round(100.0 * (lower_n + 0.5 * equal_n) / peers, 3) AS midrank
    FROM r
    """,
)
def peer_midrank(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    ranked = windows.peer_midrank(rows, ["c_mktsegment"], "c_acctbal", "midrank")
    return ranked.select("c_mktsegment", "c_custkey", F.round("midrank", 3).alias("midrank"))


@register("competition_rank", "SELECT o_orderkey, year(o_orderdate) AS year, rank() OVER (PARTITION BY year(o_orderdate) ORDER BY floor(o_totalprice / 1000) DESC) AS place FROM orders")
def competition_rank(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("year"), F.floor(F.col("o_totalprice") / 1000).alias("v"))
    return ranks.competition(rows, ["year"], "v", "place").drop("v")


@register(
    "discovery_top_n",
    """SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT DISTINCT l_returnflag, l_orderkey, l_linenumber, l_extendedprice FROM lineitem)
       QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 20""",
)
def discovery_top_n(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice").distinct()
    return windows.best_rows(rows, ["l_returnflag"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 20)


@register("latest_row", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_row(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return windows.best_rows(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@register("latest_snapshot", "SELECT user_id, event_id FROM events e WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events x WHERE x.user_id = e.user_id)")
def latest_snapshot(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "events").select("user_id", "event_id", F.to_date("ts").alias("day"))
    last = rows.groupBy("user_id").agg(F.max("day").alias("day"))
    return rows.join(last, ["user_id", "day"], "left_semi").select("user_id", "event_id")


@register(
    "asof_checkpoint",
    """SELECT o.user_id, o.event_id, c.event_id AS checkpoint FROM (SELECT * FROM events WHERE event_type = 'purchase') o
       LEFT JOIN events c ON c.user_id = o.user_id AND c.event_type = 'view' AND c.ts <= o.ts
       QUALIFY row_number() OVER (PARTITION BY o.event_id ORDER BY c.ts DESC NULLS LAST, c.event_id DESC) = 1""",
)
def asof_checkpoint(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "events").where(F.col("event_type").isin("purchase", "view")).select("user_id", "event_id", "ts", "event_type")
    return windows.latest_before(rows, ["user_id"], ["ts", "event_id"], F.col("event_type") == "view", "event_id", "checkpoint").where("event_type = 'purchase'").select("user_id", "event_id", "checkpoint")


@register(
    "completed_period",
    """SELECT year(o_orderdate) AS year, CAST(max(m) AS BIGINT) AS last_closed FROM (SELECT *, month(o_orderdate) AS m FROM orders)
       WHERE (year(o_orderdate), m) IN (SELECT (year(o_orderdate), month(o_orderdate)) FROM orders GROUP BY 1 HAVING bool_and(o_totalprice > 1500)) GROUP BY 1""",
)
def completed_period(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "orders").select(F.year("o_orderdate").cast("long").alias("year"), F.month("o_orderdate").cast("long").alias("m"), (F.col("o_totalprice") > 1500).alias("closed"))
    return windows.completed(rows, ["year"], "m", "closed").groupBy("year").agg(F.max("m").alias("last_closed"))


@register(
    "movement_delta",
    """WITH t AS (SELECT o_custkey, year(o_orderdate) AS year, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY year ORDER BY round(v, 2) DESC) AS place FROM t)
       SELECT a.o_custkey, a.year, a.place, b.place - a.place AS moved FROM r a LEFT JOIN r b ON b.o_custkey = a.o_custkey AND b.year = a.year - 1""",
)
def movement_delta(spark: SparkSession, root: str) -> DataFrame:
    totals = table(spark, root, "orders").groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    ranked = ranks.competition(totals, ["year"], "v", "place").drop("v")
    before = ranked.select("o_custkey", (F.col("year") + 1).alias("year"), F.col("place").alias("before"))
    return ranked.join(before, ["o_custkey", "year"], "left").select("o_custkey", "year", "place", (F.col("before") - F.col("place")).alias("moved"))


@register(
    "capital_decay",
    """SELECT year, o_orderpriority, round(sum(exp(-(r - 1) / 80.0)), 6) AS capital FROM (SELECT year(o_orderdate) AS year, o_orderpriority, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) GROUP BY 1, 2""",
)
def capital_decay(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "orders").select(F.year("o_orderdate").cast("long").alias("year"), "o_orderpriority", "o_totalprice", "o_orderkey")
    ranked = rosters.counted_rank(rows, ["year"], ["o_totalprice"], [F.asc("o_orderkey")], "r")
    return ranked.groupBy("year", "o_orderpriority").agg(F.round(F.sum(F.exp(-(F.col("r") - 1) / 80.0)), 6).alias("capital"))


@register(
    "expanding_folds",
    """WITH y AS (SELECT year(o_orderdate) AS year, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f FROM orders GROUP BY 1)
       SELECT h.year, CAST(sum(t.n) AS BIGINT) AS train_n, round(sum(t.f) / CAST(sum(t.n) AS DOUBLE), 9) AS prior_rate, h.n AS holdout_n FROM y h JOIN y t ON t.year < h.year GROUP BY h.year, h.n""",
)
def expanding_folds(spark: SparkSession, root: str) -> DataFrame:
    per = table(spark, root, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("holdout_n"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("f"))
    return windows.expanding(per, "year", {"holdout_n": "train_n", "f": "train_f"}).where("train_n IS NOT NULL").select("year", "train_n", F.round(F.col("train_f") / F.col("train_n"), 9).alias("prior_rate"), "holdout_n")
