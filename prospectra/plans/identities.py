"""Queries of one-to-one assignment and of identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectra.operators import matching
from prospectra.plans.catalog import register
from prospectra.sources.tables import table


def _rounds(pairs: str, rounds: int) -> str:
    """CTEs of the rounds of best offers over a table (l, r, s)."""
    out = f"r0 AS ({pairs})"
    for k in range(rounds):
        out += f""",
m{k} AS MATERIALIZED (
  SELECT a.l, a.r FROM
    (SELECT l, any_value(r) AS r FROM (SELECT l, r, s, max(s) OVER (PARTITION BY l) AS top FROM r{k}) WHERE s = top GROUP BY l HAVING count(*) = 1) a
    JOIN (SELECT r, any_value(l) AS l FROM (SELECT l, r, s, max(s) OVER (PARTITION BY r) AS top FROM r{k}) WHERE s = top GROUP BY r HAVING count(*) = 1) b
    ON a.l = b.l AND a.r = b.r),
r{k + 1} AS MATERIALIZED (SELECT * FROM r{k} WHERE l NOT IN (SELECT l FROM m{k}) AND r NOT IN (SELECT r FROM m{k}))"""
    return out


_ASSIGN_ROUNDS = 24
_ASSIGNED = f"""
WITH {_rounds("SELECT o_custkey AS l, l_partkey AS r, CAST(sum(l_quantity) AS DOUBLE) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2", _ASSIGN_ROUNDS)},
m AS ({" UNION ALL ".join(f"SELECT l, r, {k + 1} AS round FROM m{k}" for k in range(_ASSIGN_ROUNDS))}),
o AS (SELECT l, count(*) = 1 AS single FROM (SELECT l, s, max(s) OVER (PARTITION BY l) AS top FROM r{_ASSIGN_ROUNDS}) WHERE s = top GROUP BY l)
SELECT d.l AS o_custkey, m.r AS l_partkey, m.round,
       CASE WHEN m.r IS NOT NULL THEN 'matched' WHEN o.single THEN 'contested' WHEN NOT o.single THEN 'ambiguous' ELSE 'exhausted' END AS status
FROM (SELECT DISTINCT l FROM r0) d LEFT JOIN m ON m.l = d.l LEFT JOIN o ON o.l = d.l
"""


@register("best_offers", _ASSIGNED)
def best_offers(spark: SparkSession, root: str) -> DataFrame:
    """Each customer gets one part of its own among those it has bought, by the quantity bought."""
    lines = table(spark, root, "lineitem").join(table(spark, root, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    bought = lines.groupBy("o_custkey", "l_partkey").agg(F.sum("l_quantity").alias("bought"))
    return matching.assign(bought, "o_custkey", "l_partkey", "bought")


def part_rows(spark: SparkSession, root: str) -> DataFrame:
    """Parts with the fields by which they may be one: words of the name, type, size, price band; a hard identity where the size is large."""
    return table(spark, root, "part").select(
        "p_partkey", "p_brand", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("w0"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("w1"), F.col("p_type").alias("w2"), F.col("p_size").alias("size"),
        F.floor(F.col("p_retailprice") / 25).alias("band"), F.when(F.col("p_size") > 40, F.col("p_size")).alias("anchor"), "p_retailprice",
    )


@register("identity_groups")
def identity_groups(spark: SparkSession, root: str) -> DataFrame:
    """Parts of a brand that agree in three of five fields, size or price among them, as identities without two different anchors."""
    rows = part_rows(spark, root)
    links = matching.agreements(rows, "p_partkey", ["p_brand"], ["w0", "w1", "w2", "size", "band"], 3, ["size", "band"])
    return matching.identities(rows.select("p_partkey", "anchor"), "p_partkey", links, ["anchor"])


@register(
    "agreeing_links",
    """WITH RECURSIVE p AS (
         SELECT p_partkey AS id, p_brand AS g, split_part(p_name, ' ', 1) AS w0, split_part(p_name, ' ', 2) AS w1, p_type AS w2, p_size AS size, floor(p_retailprice / 25) AS band FROM part),
       e AS MATERIALIZED (
         SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.g = b.g AND a.id <> b.id
         WHERE ((a.w0 = b.w0)::INT + (a.w1 = b.w1)::INT + (a.w2 = b.w2)::INT + (a.size = b.size)::INT + (a.band = b.band)::INT) >= 3
           AND (a.size = b.size OR a.band = b.band)),
       r AS (SELECT id AS a, id AS b FROM p UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
       SELECT a AS p_partkey, min(b) AS identity FROM r GROUP BY a""",
)
def agreeing_links(spark: SparkSession, root: str) -> DataFrame:
    """The same without anchors: the connected components of agreeing parts."""
    rows = part_rows(spark, root)
    links = matching.agreements(rows, "p_partkey", ["p_brand"], ["w0", "w1", "w2", "size", "band"], 3, ["size", "band"])
    return matching.identities(rows.select("p_partkey"), "p_partkey", links, [])
