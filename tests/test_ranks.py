"""Ranges and prefix sums against sorting in Python, with nulls, ties and one large group."""

import random
import re

import pytest
from pyspark.sql import functions as F

from prospectra.operators import audits, metrics, ranks, robust


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    made = [(i, "hot" if r.random() < 0.6 else r.choice(["a", "b", None]), r.choice([None, 1.0, 2.0, float("nan"), r.random(), r.random() * 9])) for i in range(900)]
    return [*made, *[(900 + i, "hot", 5.0) for i in range(300)]]


def test_competition_ranks(spark, rows):
    df = spark.createDataFrame(rows, "id int, g string, v double").repartition(5)
    got = {x.id: x.place for x in ranks.competition(df, ["g"], "v", "place").collect()}
    sound = lambda v: v is not None and v == v
    assert len(got) == len(rows)
    for i, g, v in rows:
        assert got[i] == (1 + sum(h == g and sound(w) and w > v for _, h, w in rows) if sound(v) else None)
    assert ranks.competition(df.limit(0), ["g"], "v", "place").count() == 0


def test_numbers_and_sums_in_any_number_of_ranges(spark, rows):
    df = spark.createDataFrame(rows, "id int, g string, v double").repartition(5)
    sound = df.where("v IS NOT NULL")
    for groups in (["g"], []):
        got = {x.id: (x.n, x.before, x.all_before) for x in ranks.running(ranks.numbered(sound, groups, [F.desc("v"), F.asc("id")], "n"), groups, [F.asc("id")], {"before": "id"}).collect()}
        key = lambda x: (x[2] == x[2], -x[2] if x[2] == x[2] else 0, x[0])  # noqa: E731 NaN is the largest
        for i, g, v in [x for x in rows if x[2] is not None]:
            same = [x for x in rows if x[2] is not None and (not groups or x[1] == g)]
            place = 1 + sum(key(x) < key((i, g, v)) for x in same)
            assert got[i] == (place, sum(x[0] for x in same if x[0] < i), sum(x[0] for x in same))


def test_no_window_takes_a_whole_group_of_rows(spark, rows):
    df = spark.createDataFrame(rows, "id int, g string, v double").repartition(5)
    plan = ranks.numbered(df, ["g"], [F.desc("v"), F.asc("id")], "n")._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"Window \[.*?\], \[(.*?)\], \[.*?\]", plan)
    assert windows and any("__part" in w for w in windows)
    # The windows over groups alone stand above an aggregate with one row per range.
    for line in re.split(r"\n", plan):
        if "Window" in line and "__part#" not in line.split("], [")[1]:
            assert "__s_" in line or "__b_" in line or "all_" in line


def test_average_precision_and_quantiles_of_a_hot_group(spark, rows):
    data = [(i, g, 0.0 if v is None or v != v else v, int(i % 3 == 0)) for i, g, v in rows]
    df = spark.createDataFrame(data, "id int, g string, v double, y int").repartition(7)
    ap = {x.g: x.ap for x in metrics.average_precision(df, ["g"], "v", "y", "id").collect()}
    middle = {x.g: x.m for x in robust.counted_quantiles(df, ["g"], "v", {"m": 0.3}, ranged=True).collect()}
    plain = {x.g: x.m for x in robust.counted_quantiles(df, ["g"], "v", {"m": 0.3}).collect()}
    assert middle == plain
    for g in ap:
        ordered = sorted([x for x in data if x[1] == g], key=lambda x: (-x[2], x[0]))
        hits, parts = 0, []
        for at, x in enumerate(ordered, 1):
            hits += x[3]
            if x[3]:
                parts.append(hits / at)
        assert ap[g] == pytest.approx(sum(parts) / len(parts))


def test_rates_without_a_group_or_company(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 0), (3, None, 1), (4, "b", 1)], "id int, g string, y int")
    got = {x.id: x.r for x in audits.encode_left_out(df, "g", "y", 2.0, "r").collect()}
    assert got == pytest.approx({1: (0 + 2 * 2 / 3) / 3, 2: (1 + 2 * 1) / 3, 3: 2 / 3, 4: (0 + 2 * 2 / 3) / 2})
    assert [x.r for x in audits.encode_left_out(df.where("id = 1"), "g", "y", 2.0, "r").collect()] == [None]
    assert audits.encode_left_out(df.limit(0), "g", "y", 2.0, "r").count() == 0
