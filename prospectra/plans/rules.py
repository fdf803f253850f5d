"""Queries of the domain's single-row rules."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectra.functions import rules as R
from prospectra.functions import scalars as S
from prospectra.plans.catalog import register
from prospectra.sources.tables import table

PLACES = ["QB", " hb", "OT/G", "ol", "DE-LB", "xx", "SAF", "fs ", "K", "", "Long P", "cb,s"]
WORDS = ["Fr.", "R-So", "junior", "Redshirt Senior", "grad", "4", "2.5", "unknown", "other"]
STATES = ["STATUS_FINAL", "Final", "in progress", "Completed!", "scheduled", ""]
CODES = ["act", "RES ", "CUT", "pup", "", "RET"]
UNITS = ["cm", "m", "in", "ft", "kg", "ell"]


def _pick(choices: list[str], by: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in choices]), (by % len(choices) + 1).cast("int"))


def _sql_pick(choices: list[str], by: str) -> str:
    return "([" + ", ".join(f"'{x}'" for x in choices) + f"])[CAST({by} % {len(choices)} AS INTEGER) + 1]"


def _sql_map(pairs: Mapping[str, object], key: str) -> str:
    shown = ", ".join(f"'{k}': {v!r}" for k, v in pairs.items())
    return f"(MAP {{{shown}}})[{key}]"


@register(
    "position_group",
    f"""WITH r AS (SELECT p_partkey, upper(trim({_sql_pick(PLACES, "p_partkey")})) AS raw FROM part),
       t AS (SELECT *, list_filter(list_transform(regexp_split_to_array(raw, '[/\\- ,]+'), lambda x: {_sql_map(R.POSITIONS, "x")}), lambda x: x IS NOT NULL) AS parts FROM r)
       SELECT p_partkey, coalesce({_sql_map(R.POSITIONS, "raw")}, parts[1], raw) AS position FROM t""",
)
def position_group(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "part").select("p_partkey", R.position_group(_pick(PLACES, F.col("p_partkey"))).alias("position"))


@register(
    "class_number",
    f"""WITH r AS (SELECT p_partkey, {_sql_pick(WORDS, "p_partkey")} AS w FROM part),
       n AS (SELECT p_partkey, coalesce(try_cast(w AS DOUBLE), {_sql_map(R.CLASSES, "regexp_replace(lower(w), '[^a-z0-9]', '', 'g')")}) AS class FROM r)
       SELECT p_partkey, class, CASE WHEN class IS NULL THEN 0.0 WHEN class <= 1 THEN 0.0 WHEN class <= 2 THEN (class - 1) * 25 WHEN class <= 3 THEN 25 + (class - 2) * 30
              WHEN class <= 4 THEN 55 + (class - 3) * 27 WHEN class <= 5 THEN 82 + (class - 4) * 18 ELSE 100 END AS readiness FROM n""",
    rounded=["readiness"], digits=9
)
def class_number(spark: SparkSession, root: str) -> DataFrame:
    word = _pick(WORDS, F.col("p_partkey"))
    return table(spark, root, "part").select("p_partkey", R.class_number(word).alias("class"), R.class_readiness(word).alias("readiness"))


@register(
    "status_flags",
    f"""SELECT o_orderkey, regexp_replace(upper({_sql_pick(STATES, "o_orderkey")}), '[^A-Z]', '', 'g') IN {tuple(R.FINAL)} AS complete,
              upper(trim({_sql_pick(CODES, "o_custkey")})) IN {tuple(R.ACTIVE)} AS active FROM orders""",
)
def status_flags(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "orders").select("o_orderkey", R.game_complete(_pick(STATES, F.col("o_orderkey"))).alias("complete"), R.active(_pick(CODES, F.col("o_custkey"))).alias("active"))


@register(
    "unit_convert",
    f"""SELECT p_partkey, p_retailprice * {_sql_map(R.INCHES, _sql_pick(UNITS, "p_partkey"))} AS inches, p_retailprice * {_sql_map(R.POUNDS, _sql_pick(UNITS, "p_partkey"))} AS pounds FROM part""",
    rounded=["inches", "pounds"], digits=6
)
def unit_convert(spark: SparkSession, root: str) -> DataFrame:
    unit = _pick(UNITS, F.col("p_partkey"))
    return table(spark, root, "part").select("p_partkey", R.converted(F.col("p_retailprice"), unit, R.INCHES).alias("inches"), R.converted(F.col("p_retailprice"), unit, R.POUNDS).alias("pounds"))


@register(
    "plausible_range",
    """SELECT p_partkey, CASE WHEN v BETWEEN 10 AND 40 THEN v END AS value, coalesce(v BETWEEN 10 AND 40, true) AS fit
       FROM (SELECT p_partkey, CASE WHEN p_partkey % 6 > 0 THEN CAST(p_size AS DOUBLE) END AS v FROM part)""",
)
def plausible_range(spark: SparkSession, root: str) -> DataFrame:
    value, fit = R.plausible(F.when(F.col("p_partkey") % 6 > 0, F.col("p_size").cast("double")), 10.0, 40.0)
    return table(spark, root, "part").select("p_partkey", value.alias("value"), fit.alias("fit"))


@register(
    "derived_measures",
    """WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 7 > 0 THEN 60.0 + p_size / 4.0 END AS h, 150.0 + p_size * 3 AS w, CASE WHEN p_partkey % 5 > 0 THEN 4.2 + p_size / 40.0 END AS f,
                         CASE WHEN p_partkey % 3 > 0 THEN 20.0 + p_size / 3.0 END AS v, 90.0 + p_size AS b FROM part)
       SELECT p_partkey, 703.0 * w / (h * h) AS bmi, w * 200.0 / power(f, 4) AS speed_score, v + b / 4.0 AS explosion_index FROM r""",
    rounded=["bmi", "speed_score", "explosion_index"], digits=4
)
def derived_measures(spark: SparkSession, root: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    made = R.derived_measures(F.when(key % 7 > 0, 60.0 + size / 4.0), 150.0 + size * 3, F.when(key % 5 > 0, 4.2 + size / 40.0), F.when(key % 3 > 0, 20.0 + size / 3.0), 90.0 + size)
    return table(spark, root, "part").select("p_partkey", *[c.alias(k) for k, c in made.items()])


@register(
    "success_rate",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 = 0 THEN l_discount WHEN l_quantity > 5 THEN l_tax / l_quantity END AS rate FROM lineitem""",
    rounded=["rate"], digits=9
)
def success_rate(spark: SparkSession, root: str) -> DataFrame:
    rate = R.success_rate(F.when(F.col("l_linenumber") % 3 == 0, F.col("l_discount")), F.col("l_tax"), F.when(F.col("l_quantity") > 5, F.col("l_quantity")))
    return table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rate.alias("rate"))


@register(
    "career_elite",
    """SELECT p_partkey, CASE WHEN h IS NULL AND a IS NULL AND b IS NULL THEN NULL ELSE coalesce(h, false) OR coalesce(a >= 1, false) OR coalesce(b >= 3, false) END AS elite
       FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_size > 45 END AS h, CASE WHEN p_partkey % 3 = 0 THEN p_size % 3 END AS a, CASE WHEN p_partkey % 5 = 0 THEN p_size % 6 END AS b FROM part)""",
)
def career_elite(spark: SparkSession, root: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    return table(spark, root, "part").select("p_partkey", R.career_elite(F.when(key % 4 == 0, size > 45), F.when(key % 3 == 0, size % 3), F.when(key % 5 == 0, size % 6)).alias("elite"))


@register(
    "production_per_game",
    """WITH r AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS g, sum(l_quantity) AS q, count(*) AS n, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS back FROM lineitem GROUP BY 1),
       s AS (SELECT *, (['QB', 'RB', 'TE', 'LB', 'K', 'P', 'LS'])[CAST(l_partkey % 7 AS INTEGER) + 1] AS position, coalesce(back, 0) AS b FROM r)
       SELECT l_partkey, position, greatest(0.0, CASE position WHEN 'QB' THEN q / 25 + 4.0 * n - 3.0 * b WHEN 'RB' THEN (q + b) / 10 + 0.5 * n WHEN 'TE' THEN b / 10 + 0.5 * n
              WHEN 'LB' THEN n + b WHEN 'K' THEN 3.0 * n - greatest(0.0, q - n) WHEN 'P' THEN q + 0.5 * n END / g) AS points FROM s WHERE position <> 'LS'
       UNION ALL SELECT l_partkey, position, NULL FROM s WHERE position = 'LS'""",
    rounded=["points"], digits=6
)
def production_per_game(spark: SparkSession, root: str) -> DataFrame:
    per = table(spark, root, "lineitem").groupBy("l_partkey").agg(
        F.count_distinct("l_orderkey").alias("g"), F.sum("l_quantity").alias("q"), F.count("*").cast("double").alias("n"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("back")
    )
    q, n, back = F.col("q"), F.col("n"), F.col("back")
    stats = {"passing_yards": q, "passing_tds": n, "passing_interceptions": back, "receiving_yards": back, "receptions": n, "def_tackles_solo": n, "def_tackle_assists": back, "fg_made": n, "fg_att": q, "pt_att": q, "pt_inside_20": n}
    position = _pick(["QB", "RB", "TE", "LB", "K", "P", "LS"], F.col("l_partkey"))
    rows = per.withColumn("position", position)
    points = R.production_per_game(F.col("position"), F.col("g"), stats | {"rushing_yards": F.when(F.col("position") == "RB", q)})
    return rows.select("l_partkey", "position", points.alias("points"))


@register(
    "blend_evidence",
    """WITH r AS (SELECT p_partkey, p_size % 12 AS week, CASE WHEN p_partkey % 3 > 0 THEN p_retailprice / 100 END AS cur, CASE WHEN p_partkey % 4 > 0 THEN p_size / 2.0 END AS prior FROM part)
       SELECT p_partkey, CASE WHEN cur IS NOT NULL AND prior IS NOT NULL THEN least(0.75, greatest(0.15, week / 8.0)) * cur + (1 - least(0.75, greatest(0.15, week / 8.0))) * prior ELSE coalesce(cur, prior) END AS blend,
              CASE WHEN cur IS NOT NULL THEN 0.35 + 0.65 * least(1.0, week / 8.0) WHEN prior IS NOT NULL THEN 0.9 ELSE 0.0 END AS maturity FROM r""",
    rounded=["blend", "maturity"], digits=9
)
def blend_evidence(spark: SparkSession, root: str) -> DataFrame:
    key, week = F.col("p_partkey"), F.col("p_size") % 12
    now, prior = F.when(key % 3 > 0, F.col("p_retailprice") / 100), F.when(key % 4 > 0, F.col("p_size") / 2.0)
    return table(spark, root, "part").select("p_partkey", R.blended(now, prior, week).alias("blend"), R.evidence_maturity(now, prior, week).alias("maturity"))


@register(
    "contract_urgency",
    """SELECT p_partkey, CASE WHEN years > 0 THEN CASE WHEN signed + years - 1 <= 2024 THEN 100.0 WHEN signed + years - 1 = 2025 THEN 65.0 WHEN signed + years - 1 = 2026 THEN 25.0 ELSE 0.0 END END AS urgency,
              coalesce(try_cast(substr(trim(as_of), 1, 4) AS INTEGER) < 2023, true) AS stale
       FROM (SELECT p_partkey, 2018 + p_size % 8 AS signed, p_partkey % 5 AS years, CASE p_partkey % 3 WHEN 0 THEN '2022-05-01' WHEN 1 THEN ' 2024' ELSE 'never' END AS as_of FROM part)""",
)
def contract_urgency(spark: SparkSession, root: str) -> DataFrame:
    key = F.col("p_partkey")
    as_of = F.when(key % 3 == 0, "2022-05-01").when(key % 3 == 1, " 2024").otherwise("never")
    return table(spark, root, "part").select("p_partkey", R.contract_urgency(2018 + F.col("p_size") % 8, key % 5, 2024).alias("urgency"), R.source_is_stale(as_of, 2024).alias("stale"))


ALIASES, OUTSIDE = {"HB": "RB", "LT": "OT"}, ["H", "KR", "PR"]
CHART = ["LDE", "slb", "KR", "HB", "lt", "NT", "WR", ""]


@register(
    "depth_position",
    f"""WITH r AS (SELECT p_partkey, upper(trim({_sql_pick(CHART, "p_partkey")})) AS place, CASE WHEN p_size % 2 = 0 THEN 'Base 3-4 D' ELSE '3WR' END AS scheme FROM part)
       SELECT p_partkey, CASE WHEN place IN ('H', 'KR', 'PR') THEN '' WHEN contains(scheme, '3-4') AND place IN ('LDE', 'RDE') THEN 'IDL' WHEN contains(scheme, '3-4') AND place IN ('SLB', 'WLB') THEN 'EDGE'
              ELSE coalesce({_sql_map(ALIASES, "place")}, {_sql_map(R.POSITIONS, "place")}, place) END AS position,
              CASE p_partkey % 3 WHEN 0 THEN 'SF' WHEN 1 THEN 'KC' ELSE '' END AS team FROM r""",
)
def depth_position(spark: SparkSession, root: str) -> DataFrame:
    scheme = F.when(F.col("p_size") % 2 == 0, "Base 3-4 D").otherwise("3WR")
    team = R.team_code(_pick(["49ers", "kc", "Elsewhere"], F.col("p_partkey")), {"49ERS": "SF"})
    return table(spark, root, "part").select("p_partkey", R.depth_position(_pick(CHART, F.col("p_partkey")), scheme, ALIASES, OUTSIDE).alias("position"), team.alias("team"))


@register(
    "value_with_source",
    """SELECT p_partkey, coalesce(a, b, c) AS value, CASE WHEN a IS NOT NULL THEN 'combine' WHEN b IS NOT NULL THEN 'registry' WHEN c IS NOT NULL THEN 'other' END AS source, coalesce(nullif(trim(t), ''), 'none') AS word
       FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS a, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 END AS b, CASE WHEN p_partkey % 5 = 0 THEN p_size + 2 END AS c, CASE WHEN p_partkey % 2 = 0 THEN '  ' ELSE p_brand END AS t FROM part)""",
)
def value_with_source(spark: SparkSession, root: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    value, source = R.with_source(combine=F.when(key % 2 == 0, size), registry=F.when(key % 3 == 0, size + 1), other=F.when(key % 5 == 0, size + 2))
    word = S.first_present(F.when(key % 2 == 0, "  ").otherwise(F.col("p_brand")), F.lit("none"))
    return table(spark, root, "part").select("p_partkey", value.alias("value"), source.alias("source"), word.alias("word"))


@register(
    "entry_probability",
    """WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN (p_size % 6) / 4.0 END AS e, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS d, CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS g FROM part),
       c AS (SELECT *, e IS NOT NULL AND e NOT BETWEEN 0 AND 1 AS wrong, coalesce(d, false) AS yes, NOT coalesce(g, true) AS no FROM r),
       k AS (SELECT *, (yes AND no) OR (yes AND coalesce(e <> 1, false)) OR (NOT yes AND no AND coalesce(e <> 0, false)) AS clash FROM c)
       SELECT p_partkey, CASE WHEN wrong OR clash THEN NULL WHEN yes THEN 1.0 WHEN no THEN 0.0 ELSE e END AS probability,
              CASE WHEN wrong THEN 'invalid' WHEN clash THEN 'contradictory' WHEN yes THEN 'declared' WHEN no THEN 'ineligible' WHEN e IS NOT NULL THEN 'supplied' ELSE 'unknown' END AS basis FROM k""",
)
def entry_probability(spark: SparkSession, root: str) -> DataFrame:
    key = F.col("p_partkey")
    flag = lambda n: F.when(key % n == 0, F.lit(True)).when(key % n == 1, F.lit(False))
    value, basis = R.entry_probability(F.when(key % 4 > 0, (F.col("p_size") % 6) / 4.0), flag(3), flag(5))
    return table(spark, root, "part").select("p_partkey", value.alias("probability"), basis.alias("basis"))


@register(
    "model_stage",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'given' WHEN p_partkey % 4 = 1 THEN 'college_precombine' WHEN p_partkey % 4 = 2 THEN 'combine' ELSE 'custom' END AS stage FROM part""",
)
def model_stage(spark: SparkSession, root: str) -> DataFrame:
    kind = F.col("p_partkey") % 4
    stage = R.model_stage(F.when(kind == 0, " Given "), F.when(kind == 1, "Unconditional_next_draft"), F.when(kind == 1, "all FBS roster rows").when(kind == 2, "the combine"))
    return table(spark, root, "part").select("p_partkey", stage.alias("stage"))


@register(
    "publication_gates",
    """WITH m AS (SELECT l_suppkey, count(*) AS n, avg(l_discount) AS brier, avg(l_tax) * 1.25 AS base, 0.5 + avg(l_tax) AS auc, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS pos, count(DISTINCT year(l_shipdate)) AS years FROM lineitem GROUP BY 1)
       SELECT l_suppkey, n >= 50 AND brier < base * 0.995 AND auc >= 0.55 AND 0.35 >= pos * 1.0 / n + 0.02 AS publishes, years >= 4 AND pos >= 30 AND n - pos >= 100 AND l_suppkey % 3 > 0 AS stage,
              list_filter([CASE WHEN n < 60 THEN 'few_rows' END, CASE WHEN brier >= base THEN 'worse_than_base' END, CASE WHEN years < 7 THEN 'few_years' END], lambda x: x IS NOT NULL)::VARCHAR AS reasons,
              CASE WHEN 0.3 + pos * 1.5 / n >= 0.75 AND auc + 0.26 >= 0.8 THEN 'strong' WHEN (0.3 + pos * 1.5 / n) * (auc + 0.26) >= 0.4 THEN 'moderate' ELSE 'limited' END AS label FROM m""",
)
def publication_gates(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "lineitem")
    years = rows.select(F.col("l_suppkey").alias("__key"), F.year("l_shipdate").alias("__year")).distinct().groupBy("__key").agg(F.count("__year").alias("years"))
    # Beside a distinct count Spark adds up averages year by year, and labels hang on the last digits of sums in the table's order.
    means = rows.groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.avg("l_discount").alias("brier"), (F.avg("l_tax") * 1.25).alias("base"), (0.5 + F.avg("l_tax")).alias("auc"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("pos")
    )
    m = means.join(years, F.col("l_suppkey").eqNullSafe(F.col("__key")))
    n, pos = F.col("n"), F.col("pos")
    held = R.reasons(few_rows=n < 60, worse_than_base=F.col("brier") >= F.col("base"), few_years=F.col("years") < 7)
    return m.select(
        "l_suppkey",
        R.passes_publication(n, F.col("brier"), F.col("base"), F.col("auc"), F.lit(0.35), pos / n).alias("publishes"),
        R.passes_stage(F.col("years"), pos, n - pos, F.col("l_suppkey") % 3 > 0).alias("stage"),
        F.concat(F.lit("["), F.array_join(held, ", "), F.lit("]")).alias("reasons"),
        R.confidence_label(0.3 + pos * 1.5 / n, F.col("auc") + 0.26).alias("label"),
    )


@register(
    "surname_key",
    """SELECT s_suppkey, lower(regexp_extract(s_name, '[0-9]+$')) AS surname FROM supplier""",
)
def surname_key(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "supplier").select("s_suppkey", S.surname(F.concat(F.regexp_replace("s_name", "#", " "), F.lit(" Jr."))).alias("surname"))
