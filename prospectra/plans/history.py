"""Queries of histories with totals to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectra.operators import history
from prospectra.plans.catalog import register
from prospectra.sources.tables import table

_BOX = """b AS (SELECT *, CASE WHEN l_linenumber = 7 THEN l_orderkey + 1000000000 WHEN l_tax = 0 THEN NULL ELSE l_orderkey END AS game FROM lineitem),
          j AS (SELECT b.*, year(o_orderdate) AS season, CASE WHEN game IS NULL THEN 'no_game' WHEN o_orderkey IS NULL THEN 'unknown_game' WHEN o_orderstatus = 'F' THEN 'kept' ELSE 'unfinished' END AS verdict
                FROM b LEFT JOIN orders ON o_orderkey = game)"""


def judged_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines as box rows of orders as games; some name games that nobody knows, or none."""
    game = F.when(F.col("l_linenumber") == 7, F.col("l_orderkey") + 1000000000).when(F.col("l_tax") == 0, None).otherwise(F.col("l_orderkey"))
    box = table(spark, root, "lineitem").select("l_suppkey", "l_quantity", game.alias("game"))
    schedule = table(spark, root, "orders").select(F.col("o_orderkey").alias("game"), F.year("o_orderdate").alias("season"), "o_orderstatus")
    return history.judged_rows(box, schedule, "game", F.col("o_orderstatus") == "F")


@register("season_drops", f"WITH {_BOX} SELECT season, count(*) FILTER (verdict = 'kept') AS kept, count(*) FILTER (verdict = 'unfinished') AS unfinished, count(*) FILTER (verdict = 'unknown_game') AS unknown_game, count(*) FILTER (verdict = 'no_game') AS no_game FROM j GROUP BY 1")
def season_drops(spark: SparkSession, root: str) -> DataFrame:
    return history.drop_counts(judged_lines(spark, root), ["season"])


@register(
    "checkpoints_to_date",
    f"""WITH {_BOX}, t AS (SELECT l_suppkey, season, sum(l_quantity) AS quantity, count(*) AS games FROM j WHERE verdict = 'kept' GROUP BY 1, 2)
        SELECT l_suppkey, season, quantity, games, sum(quantity) OVER w AS quantity_to_date, CAST(sum(games) OVER w AS BIGINT) AS games_to_date FROM t WINDOW w AS (PARTITION BY l_suppkey ORDER BY season)""",
)
def checkpoints_to_date(spark: SparkSession, root: str) -> DataFrame:
    kept = judged_lines(spark, root).where("verdict = 'kept'")
    return history.checkpoints(kept, ["l_suppkey"], "season", {"quantity": F.col("l_quantity"), "games": F.lit(1)})
