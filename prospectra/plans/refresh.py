"""Queries of refreshes and versioned boards."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectra.operators import ranks, refresh
from prospectra.plans.catalog import register
from prospectra.sources import shared, snapshots
from prospectra.sources.tables import table


@register(
    "refreshed_rows",
    """WITH t AS (
         SELECT o_custkey AS id, any_value(o_orderpriority ORDER BY o_orderkey) AS notes, CASE WHEN min(o_orderkey) % 3 > 0 THEN 'school_roster' ELSE 'hand timed' END AS source,
                min(o_totalprice) AS weight, CAST(count(*) AS DOUBLE) AS total, max(month(o_orderdate)) AS week, sum(o_totalprice) FILTER (o_orderstatus = 'P') AS extra
         FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1),
       d AS (SELECT o_custkey AS id, max(o_totalprice) FILTER (o_orderstatus = 'F') AS weight, CAST(count(*) FILTER (o_orderstatus = 'O') AS DOUBLE) AS total FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1),
       z AS (SELECT *, nullif(total, 0) AS known FROM d)
       SELECT coalesce(z.id, t.id) AS id, t.notes,
              CASE WHEN z.id IS NULL THEN t.weight WHEN t.source = 'hand timed' THEN t.weight ELSE coalesce(z.weight, t.weight) END AS weight,
              CASE WHEN z.id IS NULL OR t.source = 'hand timed' THEN t.source END AS measurement_source,
              CASE WHEN z.id IS NULL THEN t.total WHEN t.week = 12 THEN coalesce(z.known, t.total) ELSE z.known END AS prod_total,
              CASE WHEN z.id IS NULL THEN 'tracked' WHEN t.id IS NULL THEN 'discovered' ELSE 'refreshed' END AS origin,
              CASE WHEN z.id IS NULL THEN t.extra END AS prod_extra_old
       FROM z FULL JOIN t ON z.id = t.id""",
)
def refreshed_rows(spark: SparkSession, root: str) -> DataFrame:
    """Customers as tracked from one year's orders, refreshed from the next year's."""
    c = F.col
    orders = table(spark, root, "orders").withColumn("year", F.year("o_orderdate"))
    first = F.min("o_orderkey")
    tracked = orders.where("year = 1995").groupBy(c("o_custkey").alias("id")).agg(
        F.min_by("o_orderpriority", "o_orderkey").alias("trait_notes"), F.when(first % 3 > 0, "school_roster").otherwise("hand timed").alias("measurement_source"), F.min("o_totalprice").alias("weight"),
        F.count("*").cast("double").alias("prod_total"), F.max(F.month("o_orderdate")).alias("as_of_week"), F.sum("o_totalprice").alias("observed_sum"), F.sum(F.when(c("o_orderstatus") == "P", c("o_totalprice"))).alias("extra_old"),
    )
    found = orders.where("year = 1996").groupBy(c("o_custkey").alias("id")).agg(F.max(F.when(c("o_orderstatus") == "F", c("o_totalprice"))).alias("weight"), F.nullif(F.count(F.when(c("o_orderstatus") == "O", 1)), F.lit(0)).cast("double").alias("prod_total"))
    merged = refresh.refreshed(found, tracked, "id", 12, refresh.Rules(measures=["weight"]))
    return merged.select("id", c("trait_notes").alias("notes"), "weight", "measurement_source", "prod_total", "origin", c("extra_old").alias("prod_extra_old"))


@register(
    "board_as_of",
    """SELECT o_custkey, total, rank() OVER (ORDER BY total DESC) AS place FROM (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders WHERE year(o_orderdate) <= 1997 GROUP BY 1)""",
)
def board_as_of(spark: SparkSession, root: str) -> DataFrame:
    """The board of 1997 among boards published year by year, one of them twice, as read in 1998, whose own was not published."""
    kept = snapshots.Snapshots(spark, f"{shared.folder(spark)}/boards-{uuid.uuid4().hex}")
    kept.prepare()
    orders = table(spark, root, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    for year in (1996, 1997, 1999, 1997):
        totals = orders.where(F.col("year") <= F.lit(year)).groupBy("o_custkey").agg(F.sum("price").cast("double").alias("total"))
        kept.publish(ranks.competition(totals, [], "total", "place"), year)
    return kept.read(1998)
