"""Queries of rosters, discovery, evaluation and boards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectra.operators import boards as B
from prospectra.operators import rosters
from prospectra.operators.robust import robust_scale
from prospectra.operators.windows import best_rows
from prospectra.plans.catalog import register
from prospectra.sources.tables import table


@register(
    "eligible_roster",
    """WITH t AS (SELECT n_nationkey, n_regionkey <> 2 AS counts, n_nationkey % 7 = 3 AS fair FROM nation),
       r AS (SELECT o_custkey, o_orderkey, o_totalprice, CAST(o_orderkey % 30 AS INTEGER) AS team, CASE WHEN o_orderpriority LIKE '1%' THEN ' FBS' ELSE 'fcs' END AS division, o_orderstatus = 'F' AS active FROM orders)
       SELECT o_custkey, o_orderkey, team FROM r LEFT JOIN t ON team = n_nationkey WHERE coalesce(counts AND NOT fair, lower(trim(division)) = 'fbs')
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY active DESC, o_totalprice DESC, o_orderkey) = 1""",
)
def eligible_roster(spark: SparkSession, root: str) -> DataFrame:
    teams = table(spark, root, "nation").select(F.col("n_nationkey").alias("team"), (F.col("n_regionkey") != 2).alias("counts"), (F.col("n_nationkey") % 7 == 3).alias("exhibition"))
    rows = table(spark, root, "orders").select("o_custkey", "o_orderkey", "o_totalprice", (F.col("o_orderkey") % 30).cast("int").alias("team"), F.when(F.col("o_orderpriority").startswith("1"), " FBS").otherwise("fcs").alias("division"), (F.col("o_orderstatus") == "F").alias("active"))
    return rosters.eligible(rows, teams, "o_custkey", "team", F.col("division"), [F.desc("active"), F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "team")


@register(
    "finished_box",
    """SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""",
)
def finished_box(spark: SparkSession, root: str) -> DataFrame:
    schedule = table(spark, root, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "F", "STATUS_FINAL").otherwise("open").alias("status"))
    box = rosters.finished(table(spark, root, "lineitem"), schedule, "l_orderkey", "status")
    return box.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@register(
    "roster_statistics",
    """WITH s AS (SELECT id, 'name' || (id // 2) AS key, sum(l_quantity) AS q FROM (SELECT CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey ELSE l_suppkey + 1000000000 END AS id, l_quantity FROM lineitem) GROUP BY 1, 2),
       u AS (SELECT key, min(id) AS id FROM s GROUP BY 1 HAVING count(*) = 1),
       r AS (SELECT s_suppkey AS player, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey END AS id, 'name' || (s_suppkey // 2) AS key FROM supplier),
       m AS (SELECT player, coalesce(a.id, u.id) AS stats_of, CASE WHEN a.id IS NOT NULL THEN 'id' WHEN u.id IS NOT NULL THEN 'key' END AS method, r.key, r.id AS rid FROM r LEFT JOIN s a ON a.id = r.id LEFT JOIN u ON u.key = r.key),
       c AS (SELECT *, row_number() OVER (PARTITION BY stats_of ORDER BY CASE method WHEN 'id' THEN 0 ELSE 1 END, rid NULLS FIRST, key) AS place FROM m)
       SELECT player, CASE WHEN place = 1 OR stats_of IS NULL THEN stats_of END AS stats_of, CASE WHEN place = 1 AND stats_of IS NOT NULL THEN method END AS stats_of_method FROM c
       UNION ALL SELECT -id, id, 'orphan' FROM s WHERE id NOT IN (SELECT player FROM r)""",
)
def roster_statistics(spark: SparkSession, root: str) -> DataFrame:
    key = lambda c: F.concat(F.lit("name"), F.floor(F.col(c) / 2))
    # A third of the suppliers have their statistics under an id that no roster knows.
    known = F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey")).otherwise(F.col("l_suppkey") + 1000000000)
    stats = table(spark, root, "lineitem").groupBy(known.alias("id")).agg(F.sum("l_quantity").alias("q")).withColumn("key", key("id")).withColumn("value", F.col("id"))
    players = table(spark, root, "supplier").select(F.col("s_suppkey").alias("player"), F.when(F.col("s_suppkey") % 4 > 0, F.col("s_suppkey")).alias("id"), key("s_suppkey").alias("key"))
    matched = rosters.with_statistics(players, stats, ["id", "key"], "value").select("player", "stats_of", "stats_of_method")
    left = rosters.orphans(stats, players.select(F.col("player").alias("id")), "id")
    return matched.unionByName(left.select((-F.col("id")).alias("player"), F.col("id").alias("stats_of"), F.lit("orphan").alias("stats_of_method")))


@register(
    "discovery_board",
    """WITH v AS (SELECT l_partkey, sum(l_quantity) AS quantity, round(avg(l_discount), 6) AS discount, CASE WHEN count(*) > 3 THEN max(l_tax) END AS tax FROM lineitem GROUP BY 1),
       p AS (SELECT p_partkey, p_brand, p_name, CASE WHEN p_partkey % 11 > 0 THEN quantity END AS quantity, CASE WHEN p_partkey % 11 > 0 THEN discount END AS discount, CASE WHEN p_partkey % 11 > 0 THEN tax END AS tax,
                    ([1.0, 2.5, 4.0, NULL])[CAST(p_partkey % 4 AS INTEGER) + 1] AS class, CASE WHEN p_size > 10 THEN 1 END AS h, CASE WHEN p_size % 2 = 0 THEN 1 END AS w FROM part LEFT JOIN v ON l_partkey = p_partkey),
       u AS (SELECT p_partkey, p_brand, 'quantity' AS m, quantity AS x FROM p WHERE quantity IS NOT NULL UNION ALL SELECT p_partkey, p_brand, 'discount', discount FROM p WHERE discount IS NOT NULL UNION ALL SELECT p_partkey, p_brand, 'tax', tax FROM p WHERE tax IS NOT NULL),
       r AS (SELECT *, 100.0 * (rank() OVER (PARTITION BY p_brand, m ORDER BY x) - 1 + 0.5 * count(*) OVER (PARTITION BY p_brand, m, x)) / count(*) OVER (PARTITION BY p_brand, m) AS s FROM u),
       a AS (SELECT p_partkey, sum(round(CASE WHEN m = 'discount' THEN 100 - s ELSE s END, 3)) / count(*) AS s, count(*) AS n FROM r GROUP BY 1),
       f AS (SELECT p.p_partkey, p.p_brand, p.p_name, coalesce(a.n, 0) AS metric_count, CASE WHEN a.n > 0 THEN 'production' ELSE 'roster_only' END AS tier,
                    coalesce(round(a.s, 3), round(0.8 * CASE class WHEN 1.0 THEN 0 WHEN 2.5 THEN 40 WHEN 4.0 THEN 82 ELSE 0 END + 10 * (CASE WHEN h IS NULL THEN 0 ELSE 1 END + CASE WHEN w IS NULL THEN 0 ELSE 1 END), 3)) AS score FROM p LEFT JOIN a ON a.p_partkey = p.p_partkey)
       SELECT p_partkey, metric_count, tier, score, row_number() OVER (ORDER BY tier = 'production' DESC, score DESC, metric_count DESC, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g'), p_partkey) AS rank,
              row_number() OVER (PARTITION BY p_brand ORDER BY tier = 'production' DESC, score DESC, metric_count DESC, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g'), p_partkey) AS position_rank FROM f""",
)
def discovery_board(spark: SparkSession, root: str) -> DataFrame:
    discount = F.round(F.round(F.avg("l_discount"), 12), 6)  # averages in the middle round up in whatever order they were added up
    stats = table(spark, root, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("quantity"), discount.alias("discount"), F.when(F.count("*") > 3, F.max("l_tax")).alias("tax"))
    seen = F.col("p_partkey") % 11 > 0
    players = table(spark, root, "part").join(stats, F.col("l_partkey") == F.col("p_partkey"), "left").select(
        "p_partkey", "p_brand", "p_name", *[F.when(seen, F.col(m)).alias(m) for m in ("quantity", "discount", "tax")],
        F.element_at(F.array(F.lit("Fr"), F.lit("RS So").substr(5, 2), F.lit("senior"), F.lit("?")), (F.col("p_partkey") % 4 + 1).cast("int")).alias("class"),
        F.when(F.col("p_size") > 10, 1).alias("h"), F.when(F.col("p_size") % 2 == 0, 1).alias("w"),
    )
    players = players.withColumn("class", F.when(F.col("p_partkey") % 4 == 1, "rso").otherwise(F.col("class")))
    ranked = rosters.discovery(players, "p_partkey", "p_brand", {"quantity": False, "discount": True, "tax": False}, "class", ["h", "w"], "p_name")
    return ranked.select("p_partkey", "metric_count", "tier", "score", "rank", "position_rank")


@register(
    "recruiting_evidence",
    """WITH r AS (SELECT p_partkey AS id, p_partkey % 900 AS athlete, 2010 + p_size % 9 AS year, p_retailprice / 2000 AS rating, p_size % 7 AS stars FROM part),
       k AS (SELECT * FROM r WHERE rating BETWEEN 0 AND 1 AND stars BETWEEN 0 AND 5),
       p AS (SELECT c_custkey, 2012 + c_custkey % 6 AS season, [c_custkey, c_custkey * 2 + 1] AS ids FROM customer),
       m AS (SELECT c_custkey, season, k.*, 0 AS way FROM (SELECT c_custkey, season, unnest(ids) AS i FROM p) q JOIN k ON k.id = q.i UNION ALL SELECT c_custkey, season, k.*, 1 FROM p JOIN k ON k.athlete = c_custkey)
       SELECT c_custkey, id, year, rating, stars FROM m WHERE year <= season QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY year DESC, rating DESC, stars DESC, way, id) = 1""",
)
def recruiting_evidence(spark: SparkSession, root: str) -> DataFrame:
    recruits = table(spark, root, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 900).alias("athlete_id"), (2010 + F.col("p_size") % 9).alias("year"), (F.col("p_retailprice") / 2000).alias("rating"), (F.col("p_size") % 7).alias("stars"))
    players = table(spark, root, "customer").select("c_custkey", (2012 + F.col("c_custkey") % 6).alias("season"), F.array(F.col("c_custkey"), F.col("c_custkey") * 2 + 1).alias("ids"), F.col("c_custkey").alias("athlete"))
    return rosters.recruiting_evidence(players, recruits, "c_custkey", "ids", "athlete", "season")


@register(
    "depth_starters",
    """WITH d AS (SELECT p_partkey, p_brand AS team, (['WR', 'TE', 'QB'])[CAST(p_partkey % 3 AS INTEGER) + 1] AS position, CASE WHEN p_size % 5 > 0 THEN p_size % 5 END AS rank, CASE WHEN p_size % 4 = 0 THEN '3WR 1TE' WHEN p_size % 4 = 1 THEN 'base 2 te' ELSE 'nickel' END AS scheme FROM part),
       w AS (SELECT team, position, max(try_cast(regexp_extract(scheme, '(?i)(\\d+)\\s*(WR|TE)\\b', 1) AS INTEGER)) AS wanted FROM d WHERE upper(regexp_extract(scheme, '(?i)\\d+\\s*(WR|TE)\\b', 1)) = position GROUP BY 1, 2)
       SELECT d.p_partkey, d.team, d.position FROM d LEFT JOIN w ON w.team = d.team AND w.position = d.position
       QUALIFY CASE WHEN wanted IS NOT NULL THEN row_number() OVER (PARTITION BY d.team, d.position ORDER BY rank NULLS LAST, p_partkey) <= wanted ELSE coalesce(rank = 1, false) END""",
)
def depth_starters(spark: SparkSession, root: str) -> DataFrame:
    size = F.col("p_size")
    depth = table(spark, root, "part").select(
        "p_partkey", F.col("p_brand").alias("team"), F.element_at(F.array(F.lit("WR"), F.lit("TE"), F.lit("QB")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("position"),
        F.when(size % 5 > 0, size % 5).alias("rank"), F.when(size % 4 == 0, "3WR 1TE").when(size % 4 == 1, "base 2 te").otherwise("nickel").alias("scheme"),
    )
    return rosters.starters(depth, "team", "position", "rank", "scheme", F.col("p_partkey")).select("p_partkey", "team", "position")


SPECS = [("quantity", "production", 1.0), ("discount", "production", 0.5), ("tax", "physical", 0.75), ("price", "physical", 1.3), ("flag", "skills", 0.6)]
WEIGHTS = {"production": 0.5, "physical": 0.3, "skills": 0.2}
_SPECS = "(VALUES " + ", ".join(f"('{m}', '{c}', {w})" for m, c, w in SPECS) + ") s(metric, category, weight)"


def _values(spark: SparkSession, root: str) -> DataFrame:
    stats = table(spark, root, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.max("l_tax").alias("tax"), F.when(F.col("l_partkey") % 3 > 0, F.max("l_extendedprice")).alias("price"))
    long = stats.unpivot("l_partkey", ["quantity", "discount", "tax", "price"], "metric", "value")
    score = F.when(F.col("metric") == "quantity", F.least(F.lit(100.0), F.col("value") / 5)).when(F.col("metric") == "discount", F.col("value") * 1000).when((F.col("metric") == "tax") & (F.col("l_partkey") % 2 == 0), F.col("value") * 1000)
    return long.withColumn("score", score)


_CATEGORIES = f"""WITH v AS (SELECT l_partkey, sum(l_quantity) AS quantity, avg(l_discount) AS discount, max(l_tax) AS tax, CASE WHEN l_partkey % 3 > 0 THEN max(l_extendedprice) END AS price FROM lineitem GROUP BY 1),
       u AS (SELECT l_partkey, 'quantity' AS metric, quantity AS value, least(100.0, quantity / 5) AS score FROM v UNION ALL SELECT l_partkey, 'discount', discount, discount * 1000 FROM v
             UNION ALL SELECT l_partkey, 'tax', tax, CASE WHEN l_partkey % 2 = 0 THEN tax * 1000 END FROM v UNION ALL SELECT l_partkey, 'price', price, NULL FROM v),
       a AS (SELECT category AS c, sum(weight) AS w, count(*) AS expected FROM {_SPECS} GROUP BY 1),
       g AS (SELECT l_partkey, category, sum(CASE WHEN score IS NOT NULL THEN weight * score END) / sum(CASE WHEN score IS NOT NULL THEN weight END) AS score, sum(weight) / any_value(w) AS coverage, count(*) AS observed, any_value(expected) AS expected
             FROM u JOIN {_SPECS} ON s.metric = u.metric JOIN a ON c = category WHERE value IS NOT NULL GROUP BY 1, 2)"""


@register("category_scores", _CATEGORIES + " SELECT * FROM g", rounded=["score", "coverage"], digits=6)
def category_scores(spark: SparkSession, root: str) -> DataFrame:
    return B.category_scores(_values(spark, root), spark.createDataFrame(SPECS, "metric string, category string, weight double"), "l_partkey")


@register(
    "profile_scores",
    _CATEGORIES
    + """, w AS (SELECT *, CASE category WHEN 'production' THEN 0.5 WHEN 'physical' THEN 0.3 ELSE 0.2 END AS share FROM g WHERE score IS NOT NULL),
       e AS (SELECT l_partkey, sum(share * score) / sum(share) AS raw, sum(share * coverage) AS evidence FROM w GROUP BY 1)
       SELECT l_partkey, 50 + (raw - 50) * least(1.0, evidence / 0.75) AS profile, evidence FROM e""",
    rounded=["profile", "evidence"], digits=6
)
def profile_scores(spark: SparkSession, root: str) -> DataFrame:
    categories = B.category_scores(_values(spark, root), spark.createDataFrame(SPECS, "metric string, category string, weight double"), "l_partkey")
    return B.profile_scores(categories, "l_partkey", WEIGHTS)


@register(
    "out_of_distribution",
    """WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 9 > 0 THEN CAST(p_size AS DOUBLE) END AS size, p_retailprice AS price FROM part),
       c AS (SELECT p_brand, median(size) AS m1, median(price) AS m2, CASE WHEN 1.4826 * mad(size) > 1e-9 THEN 1.4826 * mad(size) WHEN stddev_pop(size) > 1e-9 THEN stddev_pop(size) ELSE 1 END AS s1, CASE WHEN 1.4826 * mad(price) > 1e-9 THEN 1.4826 * mad(price) WHEN stddev_pop(price) > 1e-9 THEN stddev_pop(price) ELSE 1 END AS s2 FROM p GROUP BY 1)
       SELECT p_partkey, sqrt((coalesce(power((size - m1) / s1, 2), 0) + power((price - m2) / s2, 2)) / CASE WHEN size IS NULL THEN 1 ELSE 2 END) AS out_of_distribution FROM p JOIN c ON c.p_brand = p.p_brand""",
    rounded=["out_of_distribution"], digits=6
)
def out_of_distribution(spark: SparkSession, root: str) -> DataFrame:
    pool = table(spark, root, "part").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 9 > 0, F.col("p_size").cast("double")).alias("size"), F.col("p_retailprice").alias("price"))
    middles = pool.groupBy("p_brand").agg(F.median("size").alias("m_size"), F.median("price").alias("m_price"))
    centres = middles.join(robust_scale(pool, ["p_brand"], {"size": "s_size", "price": "s_price"}), "p_brand")
    return B.distance_from_training(pool, centres, ["size", "price"], ["p_brand"]).select("p_partkey", "out_of_distribution")


_BOARD = """SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN round(abs(c_acctbal) / {0}, 4) END AS likelihood, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey % {1} AS DOUBLE) END AS profile, CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE '{2}' END AS scope, c_nationkey = 3 AS stale FROM customer"""


@register(
    "board_movement",
    f"""WITH a AS ({_BOARD.format(20000, 97, "y")}), b AS ({_BOARD.format(15000, 89, "x")}),
       t AS (SELECT *, row_number() OVER (ORDER BY likelihood DESC NULLS LAST, profile DESC NULLS LAST, c_custkey) AS place FROM a WHERE NOT stale), o AS (SELECT *, row_number() OVER (ORDER BY likelihood DESC NULLS LAST, profile DESC NULLS LAST, c_custkey) AS place FROM b WHERE NOT stale)
       SELECT t.c_custkey, t.place, CASE WHEN o.place IS NULL THEN 'new' WHEN t.scope <> o.scope THEN 'other_scope' ELSE 'compared' END AS movement, CASE WHEN t.scope = o.scope THEN o.place - t.place END AS place_change, round(CASE WHEN t.scope = o.scope THEN t.likelihood - o.likelihood END, 6) AS likelihood_change
       FROM (SELECT * FROM t WHERE place <= 100) t LEFT JOIN (SELECT * FROM o WHERE place <= 120) o ON o.c_custkey = t.c_custkey""",
)
def board_movement(spark: SparkSession, root: str) -> DataFrame:
    key = F.col("c_custkey")

    def rows(by: int, modulus: int, scope: str) -> DataFrame:
        return table(spark, root, "customer").select(
            "c_custkey", F.when(key % 4 > 0, F.round(F.abs("c_acctbal") / by, 4)).alias("likelihood"), F.when(key % 3 > 0, (key % modulus).cast("double")).alias("profile"), F.when(key % 5 == 0, "x").otherwise(scope).alias("scope"), (F.col("c_nationkey") == 3).alias("stale")
        )

    now = B.board(rows(20000, 97, "y"), "likelihood", "profile", F.col("stale"), [key], 100)
    before = B.board(rows(15000, 89, "x"), "likelihood", "profile", F.col("stale"), [key], 120)
    moved = B.movement(now, before, ["c_custkey"], "place", ["likelihood"], "scope")
    return moved.select("c_custkey", "place", "movement", "place_change", F.round("likelihood_change", 6).alias("likelihood_change"))


@register(
    "largest_differences",
    """WITH d AS (SELECT p_partkey, unnest([{'d': abs(p_size - 25.0), 'n': 'size'}, {'d': abs(p_retailprice - 1000) / 40, 'n': 'price'}, {'d': CASE WHEN p_partkey % 3 > 0 THEN CAST(p_partkey % 17 AS DOUBLE) END, 'n': 'key'}, {'d': 3.25, 'n': 'fixed'}]) AS x FROM part)
       SELECT p_partkey, array_to_string(list(x.n ORDER BY x.d DESC, x.n DESC)[1:3], ',') AS names FROM d WHERE x.d IS NOT NULL GROUP BY 1""",
)
def largest_differences(spark: SparkSession, root: str) -> DataFrame:
    names = B.largest_differences({"size": F.col("p_size") - 25.0, "price": (F.col("p_retailprice") - 1000) / 40, "key": F.when(F.col("p_partkey") % 3 > 0, (F.col("p_partkey") % 17).cast("double")), "fixed": F.lit(3.25)})
    return table(spark, root, "part").select("p_partkey", F.array_join(names, ",").alias("names"))


@register(
    "selectable_features",
    """WITH r AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_quantity AS a, CASE WHEN l_returnflag = 'R' OR l_linenumber = 1 THEN l_tax END AS b, CASE WHEN l_linenumber = 9 THEN 1.0 END AS c, 7.0 AS d FROM lineitem),
       u AS (SELECT y, unnest(['a', 'b', 'c', 'd']) AS feature, unnest([a, b, c, d]) AS v FROM r),
       g AS (SELECT feature, count(v) / count(*) AS observed, count(v) FILTER (y = 1) / count(*) FILTER (y = 1) AS positive, count(v) FILTER (y = 0) / count(*) FILTER (y = 0) AS negative, stddev_pop(v) AS spread FROM u GROUP BY 1)
       SELECT *, coalesce(observed >= 0.25 AND least(positive, negative) >= 0.1 AND abs(positive - negative) <= 0.65 AND spread >= 1e-8, false) AS selected FROM g""",
    rounded=["observed", "positive", "negative", "spread"], digits=9
)
def selectable_features(spark: SparkSession, root: str) -> DataFrame:
    back = F.col("l_returnflag") == "R"
    rows = table(spark, root, "lineitem").select(
        F.when(back, 1).otherwise(0).alias("y"), F.col("l_quantity").alias("a"), F.when(back | (F.col("l_linenumber") == 1), F.col("l_tax")).alias("b"), F.when(F.col("l_linenumber") == 9, 1.0).alias("c"), F.lit(7.0).alias("d")
    )
    return B.selectable_features(rows, ["a", "b", "c", "d"], "y")


@register(
    "evidence_gate",
    """SELECT p_partkey, n AS observed, n / 8.0 AS share, n >= 3 AND n / 8.0 >= 0.3 AS enough FROM (SELECT p_partkey, CAST(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 4 ELSE 0 END AS INTEGER) AS n FROM part)""",
)
def evidence_gate(spark: SparkSession, root: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    flags = [key % 2 == 0, key % 3 == 0, key % 5 == 0, size % 2 == 0, *[size % 3 == 0] * 4]
    rows = table(spark, root, "part").select("p_partkey", *[F.when(f, 1).alias(f"f{i}") for i, f in enumerate(flags)])
    observed, share, enough = B.evidence_gate([f"f{i}" for i in range(8)])
    return rows.select("p_partkey", observed.alias("observed"), share.alias("share"), enough.alias("enough"))


@register(
    "outcome_states",
    """WITH p AS (SELECT c_custkey, 1994 + c_custkey % 7 AS drafted FROM customer), g AS (SELECT o_custkey, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2),
       s AS (SELECT c_custkey, unnest(range(drafted, drafted + 3)) AS y FROM p),
       t AS (SELECT s.c_custkey, max(s.y) AS last, bool_and(s.y IN (1995, 1996, 1997, 1998, 2000, 2001)) AS whole, coalesce(sum(v), 0) AS total FROM s LEFT JOIN g ON o_custkey = c_custkey AND g.y = s.y GROUP BY 1)
       SELECT c_custkey, CASE WHEN last > 2001 THEN 'right_censored' WHEN NOT whole THEN 'incomplete' WHEN total >= 200000 THEN 'contributor' WHEN total > 0 THEN 'below' ELSE 'zero' END AS state, total FROM t""",
    rounded=["total"], digits=2
)
def outcome_states(spark: SparkSession, root: str) -> DataFrame:
    players = table(spark, root, "customer").select("c_custkey", (1994 + F.col("c_custkey") % 7).cast("int").alias("drafted"))
    games = table(spark, root, "orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("season"), "o_totalprice")
    whole = spark.createDataFrame([(y,) for y in (1995, 1996, 1997, 1998, 2000, 2001)], "season int")
    return B.outcome_states(players, games, whole, "c_custkey", "drafted", "season", F.col("o_totalprice"), 2001, least=200000.0)


@register(
    "latest_release",
    """SELECT p_brand, p_type, p_partkey, n FROM (SELECT p_brand, p_type, p_partkey, p_size, count(*) OVER (PARTITION BY p_brand, p_type) AS n FROM part) QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size DESC, p_partkey DESC) = 1""",
)
def latest_release(spark: SparkSession, root: str) -> DataFrame:
    parts = table(spark, root, "part").select("p_brand", "p_type", "p_partkey", "p_size")
    counts = parts.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return B.latest_per_key(parts, ["p_brand", "p_type"], [F.desc("p_size"), F.desc("p_partkey")]).drop("p_size").join(counts, ["p_brand", "p_type"])


@register(
    "last_classes",
    """WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders ORDER BY 1 DESC LIMIT 3) SELECT year(o_orderdate) AS year, count(*) AS n, sum(CASE WHEN o_totalprice IS NULL THEN 1 ELSE 0 END) AS unpriced, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS open FROM orders WHERE year(o_orderdate) IN (SELECT y FROM y) GROUP BY 1""",
)
def last_classes(spark: SparkSession, root: str) -> DataFrame:
    orders = table(spark, root, "orders").withColumn("year", F.year("o_orderdate").cast("long"))
    last = orders.select("year").distinct().orderBy(F.desc("year")).limit(3)
    counted = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).alias(name)
    return orders.join(F.broadcast(last), "year", "left_semi").groupBy("year").agg(F.count("*").alias("n"), counted(F.col("o_totalprice").isNull(), "unpriced"), counted(F.col("o_orderstatus") == "O", "open"))


@register(
    "most_opportunities",
    """SELECT l_partkey, l_suppkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_suppkey DESC) = 1""",
)
def most_opportunities(spark: SparkSession, root: str) -> DataFrame:
    return best_rows(table(spark, root, "lineitem").select("l_partkey", "l_suppkey", "l_quantity"), ["l_partkey"], [F.desc("l_quantity"), F.desc("l_suppkey")])


@register(
    "stage_averages",
    """WITH r AS (SELECT p_type, p_brand, p_size, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_size DESC, p_partkey DESC) = 1)
       SELECT p_type, count(*) AS releases, avg(p_size) AS size, avg(p_retailprice) AS price FROM r GROUP BY 1""",
    rounded=["size", "price"], digits=6
)
def stage_averages(spark: SparkSession, root: str) -> DataFrame:
    latest = B.latest_per_key(table(spark, root, "part"), ["p_type", "p_brand"], [F.desc("p_size"), F.desc("p_partkey")])
    return latest.groupBy("p_type").agg(F.count("*").alias("releases"), F.avg("p_size").alias("size"), F.avg("p_retailprice").alias("price"))
