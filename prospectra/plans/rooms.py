"""Queries of rooms, needs, benchmarks and whole evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectra.operators import boards as B
from prospectra.operators import rooms
from prospectra.plans.catalog import register
from prospectra.sources.tables import table

_ROOMS = """WITH g AS (SELECT n_nationkey AS team, k AS room FROM nation, (SELECT unnest([0, 1, 2]) AS k)),
       p AS (SELECT nullif(c_nationkey, 4) AS team, c_custkey % 3 AS room, CASE WHEN c_custkey % 5 > 0 THEN 20 + c_custkey % 17 END AS age, CASE WHEN c_custkey % 7 > 0 THEN CAST(c_custkey % 11 AS DOUBLE) END AS experience FROM customer),
       h AS (SELECT team, room, count(*) AS n, avg(age) AS age, avg(experience) AS exp, count(age) / count(*) AS ac, count(experience) / count(*) AS ec, sum(CASE WHEN experience >= 5 THEN 1 ELSE 0 END) / nullif(count(experience), 0) AS vet FROM p GROUP BY 1, 2),
       d AS (SELECT s_nationkey AS team, s_suppkey % 3 AS room, sum(exp(-(s_suppkey % 250) / 80.0)) AS cap FROM supplier GROUP BY 1, 2),
       r AS (SELECT g.team, g.room, coalesce(n, 0) AS n, age, exp, coalesce(ac, 0) AS ac, coalesce(ec, 0) AS ec, vet, coalesce(cap, 0) AS cap FROM g LEFT JOIN h ON h.team = g.team AND h.room = g.room LEFT JOIN d ON d.team = g.team AND d.room = g.room)"""


def _rank(c: str) -> str:
    others = f"(SELECT 100.0 * (count(*) FILTER (x.{c} < r.{c}) + 0.5 * count(*) FILTER (x.{c} = r.{c})) / count(x.{c}) FROM q x WHERE x.room = r.room)"
    return f"CASE WHEN r.{c} IS NOT NULL THEN {others} END"


@register(
    "room_needs",
    _ROOMS
    + f""", q AS (SELECT team, room, n, ac, ec, round(age, 9) AS age, round(exp, 9) AS exp, round(vet, 9) AS vet, round(cap, 9) AS cap FROM r),
       k AS (SELECT *, 100 - {_rank("n")} AS depth, {_rank("age")} AS pa, {_rank("exp")} AS pe, {_rank("vet")} AS pv, 100 - {_rank("cap")} AS lack FROM q r),
       t AS (SELECT *, (coalesce(pa * 0.45, 0) + coalesce(pe * 0.35, 0) + coalesce(pv * 0.2, 0)) / nullif(CASE WHEN pa IS NULL THEN 0 ELSE 0.45 END + CASE WHEN pe IS NULL THEN 0 ELSE 0.35 END + CASE WHEN pv IS NULL THEN 0 ELSE 0.2 END, 0) AS moving, 0.3 * 0.9 * (0.5 * ac + 0.5 * ec) AS mw FROM k),
       w AS (SELECT *, CASE WHEN moving IS NULL OR mw <= 0 THEN 0 ELSE mw END AS m FROM t)
       SELECT team, room, n AS members, depth AS depth_pressure, moving AS transition_pressure, lack AS lack_investment, (0.36 * depth + coalesce(m * moving, 0) + 0.24 * lack) / (0.36 + m + 0.24) AS need, 0.36 + CASE WHEN moving IS NULL THEN 0 ELSE mw END + 0.24 AS need_evidence, (0.36 * 0.78 + m * 0.72 + 0.24 * 0.95) / (0.36 + m + 0.24) AS need_confidence FROM w""",
    rounded=["depth_pressure", "transition_pressure", "lack_investment", "need", "need_evidence", "need_confidence"], digits=5
)
def room_needs(spark: SparkSession, root: str) -> DataFrame:
    key = F.col("c_custkey")
    grid = table(spark, root, "nation").select(F.col("n_nationkey").alias("team"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("room"))
    players = table(spark, root, "customer").select(F.nullif(F.col("c_nationkey"), F.lit(4)).alias("team"), (key % 3).cast("int").alias("room"), F.when(key % 5 > 0, 20 + key % 17).alias("age"), F.when(key % 7 > 0, (key % 11).cast("double")).alias("experience"))
    picks = table(spark, root, "supplier").select(F.col("s_nationkey").alias("team"), (F.col("s_suppkey") % 3).cast("int").alias("room"), (F.col("s_suppkey") % 250 + 1).alias("pick"))
    held = rooms.room_profiles(grid, players, picks, ["team", "room"])
    held = held.withColumns({c: F.round(c, 9) for c in (*rooms.TRANSITION, "draft_capital")})
    rated = rooms.needs(held, "room", 0.9, 0.8)
    return rated.select("team", "room", F.col("count").alias("members"), *rooms.PRESSURES, "need", "need_evidence", "need_confidence")


SPECS = [("size", "physical", 1.0), ("price", "production", 0.7), ("number", "production", 0.5)]
WEIGHTS = {"physical": 0.4, "production": 0.6}


def _long(spark: SparkSession, root: str) -> DataFrame:
    key = F.col("p_partkey")
    parts = table(spark, root, "part").select("p_partkey", "p_brand", F.when(key % 9 > 0, F.col("p_size").cast("double")).alias("size"), F.col("p_retailprice").alias("price"), (key % 13).cast("double").alias("number"))
    return parts.unpivot(["p_partkey", "p_brand"], ["size", "price", "number"], "metric", "value")


def _references(spark: SparkSession, root: str) -> DataFrame:
    """Three references of each position: a small cohort, an active model's rows, and all."""
    rows = _long(spark, root)
    first = rows.where("p_partkey % 23 = 0").withColumns({"reference": F.lit("cohort"), "priority": F.lit(1)})
    second = rows.where("p_partkey % 7 = 0").withColumns({"reference": F.lit("active"), "priority": F.lit(2)})
    return first.unionByName(second).unionByName(rows.withColumns({"reference": F.lit("pool"), "priority": F.lit(3)}))


_BENCHMARKS = """WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 9 > 0 THEN CAST(p_size AS DOUBLE) END AS size, p_retailprice AS price, CAST(p_partkey % 13 AS DOUBLE) AS number FROM part),
       l AS (SELECT p_partkey, p_brand, 'size' AS metric, size AS value FROM p UNION ALL SELECT p_partkey, p_brand, 'price', price FROM p UNION ALL SELECT p_partkey, p_brand, 'number', number FROM p),
       f AS (SELECT *, 'cohort' AS reference, 1 AS priority FROM l WHERE p_partkey % 23 = 0 UNION ALL SELECT *, 'active', 2 FROM l WHERE p_partkey % 7 = 0 UNION ALL SELECT *, 'pool', 3 FROM l),
       z AS (SELECT p_brand, metric, reference, priority, count(value) AS peers FROM f GROUP BY 1, 2, 3, 4 HAVING count(value) >= 5),
       c AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY p_brand, metric ORDER BY priority) = 1),
       v AS (SELECT f.p_brand, f.metric, f.value, c.reference, c.peers FROM f JOIN c ON c.p_brand = f.p_brand AND c.metric = f.metric AND c.priority = f.priority WHERE f.value IS NOT NULL),
       b AS (SELECT l.p_partkey, l.p_brand, l.metric, l.value, c.reference, c.peers, CASE WHEN l.value IS NOT NULL THEN (SELECT 100.0 * (count(*) FILTER (v.value < l.value) + 0.5 * count(*) FILTER (v.value = l.value)) / c.peers FROM v WHERE v.p_brand = l.p_brand AND v.metric = l.metric) END AS share FROM l LEFT JOIN c ON c.p_brand = l.p_brand AND c.metric = l.metric),
       s AS (SELECT p_partkey, p_brand, metric, value, reference, peers, CASE WHEN metric = 'price' THEN 100 - share ELSE share END AS score FROM b)"""


@register("benchmark_scores", _BENCHMARKS + " SELECT p_partkey, metric, value, reference, peers, score FROM s", rounded=["score"], digits=6)
def benchmark_scores(spark: SparkSession, root: str) -> DataFrame:
    return B.benchmarks(_long(spark, root), _references(spark, root), "p_partkey", "p_brand", ["price"]).drop("p_brand")


@register(
    "evaluated_board",
    _BENCHMARKS
    + """, g AS (SELECT p_partkey, CASE WHEN metric = 'size' THEN 'physical' ELSE 'production' END AS category, CASE metric WHEN 'size' THEN 1.0 WHEN 'price' THEN 0.7 ELSE 0.5 END AS w, score FROM s WHERE value IS NOT NULL),
       k AS (SELECT p_partkey, category, sum(w * score) / sum(CASE WHEN score IS NOT NULL THEN w END) AS score, sum(w) / CASE category WHEN 'physical' THEN 1.0 ELSE 1.2 END AS coverage, CASE category WHEN 'physical' THEN 0.4 ELSE 0.6 END AS share FROM g GROUP BY 1, 2),
       e AS (SELECT p_partkey, sum(share * score) / sum(share) AS raw, sum(share * coverage) AS evidence FROM k WHERE score IS NOT NULL GROUP BY 1),
       y AS (SELECT p.p_partkey, CASE WHEN p.p_partkey % 3 = 0 THEN p_size / 100.0 END AS likelihood, round(50 + (raw - 50) * least(1.0, evidence / 0.75), 6) AS profile FROM part p LEFT JOIN e ON e.p_partkey = p.p_partkey WHERE p.p_partkey % 10 > 0)
       SELECT p_partkey, likelihood, profile, row_number() OVER (ORDER BY likelihood DESC NULLS LAST, profile DESC NULLS LAST, p_partkey) AS place FROM y QUALIFY place <= 150""",
)
def evaluated_board(spark: SparkSession, root: str) -> DataFrame:
    specs = spark.createDataFrame(SPECS, "metric string, category string, weight double")
    profiles = B.evaluated(_long(spark, root), _references(spark, root), specs, "p_partkey", "p_brand", ["price"], WEIGHTS)
    rows = table(spark, root, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") / 100.0).alias("likelihood"), (F.col("p_partkey") % 10 == 0).alias("stale"))
    joined = rows.join(profiles.select("p_partkey", F.round("profile", 6).alias("profile")), "p_partkey", "left")
    return B.board(joined, "likelihood", "profile", F.col("stale"), [F.col("p_partkey")], 150).select("p_partkey", "likelihood", "profile", "place")
