"""Scalar and join rules on small tables with missing values and ties."""

from pyspark.sql import functions as F

from prospectra.functions import scalars as S
from prospectra.operators import joins, robust, windows


def test_typed_text(spark):
    df = spark.createDataFrame([("1,234.5",), ("12%",), (" N/A ",), ("-",), (None,), ("x",), ("6-1",), ("6'1\"",), ("Yes",), ("undrafted",)], "t string")
    got = df.select(S.number(F.col("t")).alias("n"), S.height_inches(F.col("t")).alias("h"), S.boolean(F.col("t")).alias("b")).collect()
    assert [r.n for r in got] == [1234.5, 0.12, None, None, None, None, None, None, None, None]
    assert [r.h for r in got][6:8] == [73.0, 73.0] and [r.b for r in got][8:] == [True, False]


def test_piecewise_and_weights(spark):
    df = spark.createDataFrame([(0.0,), (1.5,), (9.0,), (None,)], "x double")
    assert [r[0] for r in df.select(S.piecewise(F.col("x"), [(1, 0), (2, 25), (3, 55)])).collect()] == [0.0, 12.5, 55.0, None]
    one = df.select(S.weighted_mean([(F.col("x"), F.lit(1.0)), (F.lit(3.0), F.lit(1.0)), (F.lit(9.0), F.lit(0.0))])).collect()
    assert [r[0] for r in one] == [1.5, 2.25, 6.0, 3.0]


def test_cascade_prefers_earlier_keys_and_drops_shared_ones(spark):
    right = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "b", "z"), (4, None, "x")], "id int, k1 string, k2 string")
    left = spark.createDataFrame([(10, "a", "y"), (11, "b", "z"), (12, None, "x"), (13, "a", None)], "row int, k1 string, k2 string")
    got = {r.row: (r.hit, r.hit_method, r.hit_conflict) for r in joins.match_cascade(left, right, ["k1", "k2"], "id", "hit").collect()}
    assert got == {10: (1, "k1", True), 11: (3, "k2", False), 12: (None, None, False), 13: (1, "k1", False)}


def test_gaps_overlay_and_scale(spark):
    df = spark.createDataFrame([("a", 2), ("a", 5), ("b", 1)], "g string, n int")
    assert sorted(map(tuple, joins.missing_numbers(df, ["g"], "n").collect())) == [("a", 1), ("a", 3), ("a", 4)]
    flat = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 1.0), ("b", 7.0)], "g string, x double")
    assert {r.g: r.s for r in robust.robust_scale(flat, ["g"], {"x": "s"}).collect()}["a"] == 1.0
    both = joins.overlay(df.where("g = 'a'").groupBy("g").agg(F.max("n").alias("n")), spark.createDataFrame([("a", None), ("c", 3)], "g string, n int"), ["g"], ["n"])
    assert sorted(map(tuple, both.collect())) == [("a", 5, "both"), ("c", 3, "other")]


def test_checkpoint_at_or_before(spark):
    df = spark.createDataFrame([(1, 1, 100, True), (1, 2, 101, False), (1, 3, 102, True), (1, 3, 103, False), (2, 1, 104, False)], "u int, t int, id int, c boolean")
    got = {r.id: r.at for r in windows.latest_before(df, ["u"], ["t", "id"], F.col("c"), "id", "at").collect()}
    assert got == {100: 100, 101: 100, 102: 102, 103: 102, 104: None}


def test_midrank_ties_and_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 3.0), ("a", None), ("a", float("nan")), (None, 2.0)], "g string, x double")
    got = sorted((str(r.g), str(r.x), r.m) for r in windows.peer_midrank(df, ["g"], "x", "m").collect())
    assert [m for g, x, m in got if g == "a" and x == "1.0"] == [100 / 3, 100 / 3] and [m for g, x, m in got if x in ("None", "nan")] == [None, None]


def test_overlay_of_keys_that_one_side_lacks(spark):
    from prospectra.operators import joins

    base, other = spark.createDataFrame([(1, 10), (2, 20)], "k int, v int"), spark.createDataFrame([(2, None), (3, 30)], "k int, v int")
    assert sorted(map(tuple, joins.overlay(base, other, ["k"], ["v"]).collect())) == [(1, 10, "base"), (2, 20, "both"), (3, 30, "other")]


def test_whole_queries_take_every_id(spark):
    from prospectra.plans import matching

    root = "/root/testdata/sf0.001"
    assert {r.candidate for r in matching.comparables_topk_whole(spark, root).select("candidate").distinct().collect()} == {r.p_partkey for r in spark.read.parquet(f"{root}/part.parquet").collect()}
    assert {r.k for r in matching.overlay_full_outer_whole(spark, root).collect()} == {r[0] for f, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey")) for r in spark.read.parquet(f"{root}/{f}.parquet").select(c).distinct().collect()}
