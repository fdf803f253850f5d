"""Queries of single-row rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectra.functions import scalars as S
from prospectra.plans.catalog import register
from prospectra.sources.tables import table


@register(
    "name_key",
    """SELECT s_suppkey, regexp_replace(regexp_replace(lower(strip_accents(s_name || ' Núñez-Ålund Jr.')), '\\b(jr|sr|ii|iii|iv)\\b', '', 'g'), '[^a-z0-9]', '', 'g') AS name_key FROM supplier""",
)
def name_key(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "supplier").select("s_suppkey", S.name_key(F.concat("s_name", F.lit(" Núñez-Ålund Jr."))).alias("name_key"))


@register("slugify", "SELECT p_partkey, regexp_replace(regexp_replace(lower(strip_accents(p_type || ' é ' || p_brand || '!')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")
def slugify(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "part").select("p_partkey", S.slug(F.concat("p_type", F.lit(" é "), "p_brand", F.lit("!"))).alias("slug"))


@register("first_number", "SELECT p_partkey, try_cast(nullif(regexp_extract(p_brand, '(-?[0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE) AS number FROM part")
def first_number(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "part").select("p_partkey", S.first_number(F.col("p_brand")).alias("number"))


@register(
    "ratio_split",
    "SELECT p_partkey, CAST(p_size AS DOUBLE) AS made, CAST(p_size + 3 AS DOUBLE) AS tried, (p_size + 0.6 * 25) / (p_size + 3 + 25.0) AS rate FROM part",
    rounded=["rate"], digits=9
)
def ratio_split(spark: SparkSession, root: str) -> DataFrame:
    made, tried = S.ratio_parts(F.concat_ws("/", "p_size", F.col("p_size") + 3))
    rows = table(spark, root, "part").select("p_partkey", made.alias("made"), tried.alias("tried"))
    return rows.withColumn("rate", S.smoothed_rate(F.col("made"), F.col("tried"), 0.6, 25.0))


@register(
    "typed_values",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN round(o_totalprice, 2) / 100 ELSE round(o_totalprice, 2) END AS value,
              CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS closed,
              CASE WHEN o_orderkey % 5 = 2 THEN 73.0 ELSE 70.0 END AS inches FROM orders""",
    rounded=["value"], digits=6
)
def typed_values(spark: SparkSession, root: str) -> DataFrame:
    kind = F.col("o_orderkey") % 5
    raw = F.format_number("o_totalprice", 2)
    text = F.when(kind == 0, " N/A ").when(kind == 1, F.concat(raw, F.lit("%"))).otherwise(raw)
    flag = F.when(F.col("o_orderstatus") == "F", "Yes").when(F.col("o_orderstatus") == "O", "undrafted").otherwise("?")
    tall = F.when(kind == 2, "6-1").otherwise("70")
    return table(spark, root, "orders").select("o_orderkey", S.number(text).alias("value"), S.boolean(flag).alias("closed"), S.height_inches(tall).alias("inches"))


@register("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@register(
    "readiness_curve",
    """SELECT p_partkey, CASE WHEN x <= 1 THEN 0.0 WHEN x <= 2 THEN (x - 1) * 25.0 WHEN x <= 3 THEN 25 + (x - 2) * 30.0 WHEN x <= 4 THEN 55 + (x - 3) * 27.0
              WHEN x <= 5 THEN 82 + (x - 4) * 18.0 ELSE 100.0 END AS readiness FROM (SELECT p_partkey, p_size / 8.0 AS x FROM part)""",
    rounded=["readiness"], digits=9
)
def readiness_curve(spark: SparkSession, root: str) -> DataFrame:
    curve = S.piecewise(F.col("p_size") / 8.0, [(1, 0), (2, 25), (3, 55), (4, 82), (5, 100)])
    return table(spark, root, "part").select("p_partkey", curve.alias("readiness"))


@register(
    "sigmoid_logit",
    """SELECT c_custkey, 1 / (1 + exp(-(c_acctbal / 1000))) AS p, ln(least(1 - 1e-9, greatest(1e-9, abs(c_acctbal) / 20000)) / (1 - least(1 - 1e-9, greatest(1e-9, abs(c_acctbal) / 20000)))) AS z FROM customer""",
    rounded=["p", "z"], digits=9
)
def sigmoid_logit(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "customer").select("c_custkey", S.sigmoid(F.col("c_acctbal") / 1000).alias("p"), S.logit(F.abs("c_acctbal") / 20000).alias("z"))


@register(
    "draft_day_age",
    """SELECT o_orderkey, CASE WHEN age BETWEEN 18 AND 30 THEN round(age, 3) END AS age
       FROM (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), make_date(2020, 4, 30)) / 365.2425 AS age FROM orders)""",
)
def draft_day_age(spark: SparkSession, root: str) -> DataFrame:
    age = F.datediff(F.make_date(F.lit(2020), F.lit(4), F.lit(30)), F.to_date("o_orderdate")) / F.lit(365.2425)
    return table(spark, root, "orders").select("o_orderkey", F.when(age.between(18, 30), F.round(age, 3)).alias("age"))


@register(
    "tier_labels",
    """SELECT c_custkey, CASE WHEN s >= 85 THEN 'elite' WHEN s >= 75 THEN 'strong' WHEN s >= 65 THEN 'solid' WHEN s >= 55 THEN 'developing' ELSE 'below' END AS tier
       FROM (SELECT c_custkey, (c_acctbal + 1000) / 110 AS s FROM customer)""",
)
def tier_labels(spark: SparkSession, root: str) -> DataFrame:
    s = (F.col("c_acctbal") + 1000) / 110
    tier = F.when(s >= 85, "elite").when(s >= 75, "strong").when(s >= 65, "solid").when(s >= 55, "developing").otherwise("below")
    return table(spark, root, "customer").select("c_custkey", tier.alias("tier"))
