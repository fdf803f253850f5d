"""Queries of production from long statistics and of typed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectra.operators import production as P
from prospectra.plans.catalog import register
from prospectra.sources.tables import table

#: What the lines stand for: a category and a statistic for each number of 28.
STATS = [
    ("Passing", "ATT"), ("passing", "Yds"), ("passing", "cmp"), ("passing", "TD"), ("Rushing", "car"), ("rushing", "yds"), ("rushing", "td"), ("receiving", "REC"), ("receiving", "yds"),
    ("defensive", "SACKS"), ("defensive", "TFL"), ("defensive", "Tot"), ("defensive", "PD"), ("interceptions", "int"), ("defensive", "int"), ("kicking", "FGA"), ("kicking", "FGM"), ("kicking", "PCT"),
    ("punting", "NO"), ("punting", "yds"), ("punting", "In 20"), ("kickReturns", "no"), ("kick returns", "yds"), ("puntReturns", "avg"), ("passing", "C/ATT"), ("passing", "int"), ("defensive", "ff"), ("kicking", "LONG"),
]
SHOWN = ["pass_attempts", "pass_completions", "completion_pct", "yards_per_attempt", "interception_rate", "scrimmage_yards", "touchdowns", "yards_per_touch", "sacks_per_game", "takeaways_per_game", "field_goal_pct", "yards_per_punt", "punts_inside_20", "yards_per_kick_return", "yards_per_punt_return", "interceptions", "kicking_long"]


def _pair(i: int) -> str:
    return "([" + ", ".join(f"'{s[i]}'" for s in STATS) + "])[k + 1]"


def _slug(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


_WIDE = ", ".join(f"arg_min(x, o_{k} * 1e9 + x) FILTER (o_{k} IS NOT NULL) AS {k}" for k in P.COUNTS)
_ORDERS = ", ".join(f"CASE WHEN c IN ({', '.join(repr(x) for x in cs)}) AND s IN ({', '.join(repr(x) for x in ss)}) THEN list_position([{', '.join(repr(x) for x in cs)}], c) * 100 + list_position([{', '.join(repr(x) for x in ss)}], s) END AS o_{k}" for k, (cs, ss) in P.COUNTS.items())


@register(
    "college_production",
    f"""WITH l AS (SELECT l_suppkey, CAST((l_partkey * 7 + l_linenumber) % 28 AS INTEGER) AS k, l_quantity AS x, l_quantity AS q, l_linenumber AS n FROM lineitem),
       t AS (SELECT l_suppkey, {_slug(_pair(0))} AS c, {_slug(_pair(1))} AS s, x, CASE WHEN k = 24 THEN CAST(CAST(q AS BIGINT) AS VARCHAR) || '/' || (CAST(q AS BIGINT) + n) END AS slash FROM l),
       o AS (SELECT *, {_ORDERS} FROM t),
       w AS (SELECT l_suppkey, {_WIDE}, min(slash) AS slash, 12.0 AS games FROM o GROUP BY 1),
       a AS (SELECT * REPLACE (CASE WHEN slash IS NOT NULL THEN CAST(split_part(slash, '/', 1) AS DOUBLE) ELSE pass_completions END AS pass_completions, CASE WHEN slash IS NOT NULL THEN CAST(split_part(slash, '/', 2) AS DOUBLE) ELSE pass_attempts END AS pass_attempts) FROM w),
       b AS (SELECT *, CASE WHEN coalesce(rush_yards, receiving_yards) IS NOT NULL THEN coalesce(rush_yards, 0) + coalesce(receiving_yards, 0) END AS scrimmage_yards, coalesce(carries, 0) + coalesce(receptions, 0) AS touches FROM a)
       SELECT l_suppkey, pass_attempts AS prod_pass_attempts, pass_completions AS prod_pass_completions, CASE WHEN pass_attempts > 0 THEN (pass_completions + 15) / (pass_attempts + 25) END AS prod_completion_pct, CASE WHEN pass_attempts > 0 THEN (pass_yards + 175) / (pass_attempts + 25) END AS prod_yards_per_attempt,
              CASE WHEN pass_attempts > 0 THEN (pass_interceptions + 0.625) / (pass_attempts + 25) END AS prod_interception_rate, scrimmage_yards AS prod_scrimmage_yards, CASE WHEN coalesce(rush_tds, receiving_tds) IS NOT NULL THEN coalesce(rush_tds, 0) + coalesce(receiving_tds, 0) END AS prod_touchdowns,
              CASE WHEN touches > 0 THEN (scrimmage_yards + 82.5) / (touches + 15) END AS prod_yards_per_touch, sacks / games AS prod_sacks_per_game, CASE WHEN coalesce(interceptions, forced_fumbles) IS NOT NULL THEN (coalesce(interceptions, 0) + coalesce(forced_fumbles, 0)) / games END AS prod_takeaways_per_game,
              coalesce(CASE WHEN field_goal_attempts > 0 THEN field_goals_made / field_goal_attempts END, CASE WHEN field_goal_share > 1 THEN field_goal_share / 100 ELSE field_goal_share END) AS prod_field_goal_pct, coalesce(punt_average, CASE WHEN punts > 0 THEN punt_yards / punts END) AS prod_yards_per_punt,
              punts_inside_20 AS prod_punts_inside_20, coalesce(kick_return_average, CASE WHEN kick_returns > 0 THEN kick_return_yards / kick_returns END) AS prod_yards_per_kick_return, coalesce(punt_return_average, CASE WHEN punt_returns > 0 THEN punt_return_yards / punt_returns END) AS prod_yards_per_punt_return,
              interceptions AS prod_interceptions, kicking_long AS prod_kicking_long, CASE WHEN carries > 0 THEN rush_yards / carries END AS observed_yards_per_carry FROM b""",
    rounded=["prod_completion_pct", "prod_yards_per_attempt", "prod_interception_rate", "prod_yards_per_touch", "prod_sacks_per_game", "prod_takeaways_per_game", "prod_field_goal_pct", "prod_yards_per_punt", "prod_yards_per_kick_return", "observed_yards_per_carry"], digits=9
)
def college_production(spark: SparkSession, root: str) -> DataFrame:
    kind = ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 28).cast("int")
    name = lambda i: F.element_at(F.array(*[F.lit(s[i]) for s in STATS]), kind + 1)
    whole = F.col("l_quantity").cast("long")
    value = F.when(kind == 24, F.concat_ws("/", whole.cast("string"), (whole + F.col("l_linenumber")).cast("string"))).otherwise(F.col("l_quantity").cast("string"))
    rows = table(spark, root, "lineitem").select("l_suppkey", name(0).alias("category"), name(1).alias("stat"), value.alias("value"), F.lit(12.0).alias("games"))
    made = P.production(rows, "l_suppkey", "category", "stat", "value", "games")
    return made.select("l_suppkey", *[f"prod_{c}" for c in SHOWN], "observed_yards_per_carry")


@register(
    "normalized_records",
    """WITH r AS (SELECT p_partkey, p_size, p_brand FROM part)
       SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 4 > 0 THEN p_brand END AS name, CASE WHEN p_partkey % 3 = 0 THEN 'RB' WHEN p_partkey % 3 = 1 THEN 'OT' END AS position, CASE WHEN p_partkey % 3 = 0 THEN 'hb' WHEN p_partkey % 3 = 1 THEN 'OT/G' END AS position_raw,
              72.0 + p_size % 5 AS height_in, CAST(200 + p_size AS DOUBLE) AS weight_lb, CASE WHEN p_size % 2 = 0 THEN 4.5 END AS forty_s, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS drafted, CASE WHEN p_size % 4 = 0 THEN 1234.0 WHEN p_size % 4 = 1 THEN 0.25 END AS prod_yards,
              round(703.0 * (200 + p_size) / power(72.0 + p_size % 5, 2), 4) AS bmi, CASE WHEN p_size % 2 = 0 THEN round((200 + p_size) * 200 / power(4.5, 4), 4) END AS speed_score, CAST(NULL AS DOUBLE) AS explosion_index FROM r""",
)
def normalized_records(spark: SparkSession, root: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    raw = table(spark, root, "part").select(
        key.cast("string").alias("id"),
        F.when(key % 4 > 0, F.concat(F.lit(" "), F.col("p_brand"), F.lit(" "))).otherwise("n/a").alias("player_name"),
        F.when(key % 3 == 0, "hb").when(key % 3 == 1, "OT/G").otherwise("").alias("pos"),
        F.concat(F.lit("6-"), (size % 5).cast("string")).alias("ht"),
        (200 + size).cast("string").alias("wt"),
        F.when(size % 2 == 0, "4.50").otherwise("-").alias("forty"),
        F.when(size % 3 == 0, "Yes").when(size % 3 == 1, "undrafted").otherwise("unknown").alias("drafted"),
        F.when(size % 4 == 0, "1,234").when(size % 4 == 1, "25%").otherwise("NA").alias("prod_yards"),
    )
    return P.normalized(raw)
