"""Numbers that groups lack."""

import random

import pytest
from conftest import DATA

from prospectra.operators import joins
from prospectra.plans import catalog


@pytest.mark.parametrize("run", [1, 3, 65_536])
def test_missing_numbers(spark, run):
    rng = random.Random(run)
    rows = [(g, rng.choice([None, rng.randrange(-9, 60), rng.randrange(1, 9)])) for g in "abcdef" for _ in range(14)] + [("g", None), ("h", -4), ("h", 3), ("i", 40)]
    got = joins.missing_numbers(spark.createDataFrame(rows, "g string, n int"), ["g"], "n", run).collect()
    held = {g: {n for h, n in rows if h == g and n is not None} for g, _ in rows}
    assert sorted(map(tuple, got)) == sorted((g, n) for g, numbers in held.items() for n in range(1, max(numbers, default=0)) if n not in numbers)


@pytest.mark.parametrize("name", ["missing_seq", "missing_seq_whole"])
def test_rows_are_shuffled_once(spark, name):
    plan = catalog.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
