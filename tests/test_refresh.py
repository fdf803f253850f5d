"""Refreshes by the rules, and versions that are seen whole or not at all."""

import pytest
from pyspark.sql import functions as F

from prospectra.operators import refresh
from prospectra.sources import shared, snapshots

RULES = refresh.Rules(keep=["notes"], measures=["weight"], owned=["size"])


def test_what_people_entered_stays(spark):
    tracked = [
        (1, "mine", "fast", 70.0, "school_roster", None, 5.0, 3, "old", 9),
        (2, " ", None, 71.0, "pro day", None, 6.0, 4, "old", 9),
        (3, None, "slow", 72.0, None, "yes", None, 4, "old", 9),
        (4, "left", "x", 73.0, "", None, 8.0, 4, "old", 9),
        (None, "no key", None, None, None, None, None, None, None, None),
    ]
    found = [(1, "theirs", 80.0, None, "new"), (2, "theirs", 81.0, 2.0, "new"), (3, "theirs", None, None, "new"), (5, "fresh", 85.0, 1.0, "new")]
    old = spark.createDataFrame(tracked, "id long, notes string, trait_speed string, weight double, measurement_source string, measurements_verified string, prod_total double, as_of_week int, cfbd_x string, size int")
    new = spark.createDataFrame(found, "id long, notes string, weight double, prod_total double, cfbd_x string")
    got = {r.id: r for r in refresh.refreshed(new, old, "id", 4, RULES).collect()}
    assert len(got) == 6 and got[None].origin == "tracked" and got[None].notes == "no key"
    show = {k: (r.notes, r.trait_speed, r.weight, r.measurement_source, r.prod_total, r.cfbd_x, r["size"], r.origin) for k, r in got.items() if k}
    assert show == {
        1: ("mine", "fast", 80.0, None, None, "new", None, "refreshed"),
        2: ("theirs", None, 71.0, "pro day", 2.0, "new", None, "refreshed"),
        3: ("theirs", "slow", 72.0, None, None, "new", None, "refreshed"),
        4: ("left", "x", 73.0, None, 8.0, None, None, "tracked"),
        5: ("fresh", None, 85.0, None, 1.0, "new", None, "discovered"),
    }
    assert refresh.refreshed(new.limit(0), old.limit(0), "id", 4, RULES).count() == 0


def test_versions_are_whole(spark, tmp_path, monkeypatch):
    kept = snapshots.Snapshots(spark, f"file://{tmp_path}/board")
    kept.prepare()
    assert kept.read() is None and kept.read(3) is None
    one = spark.range(5).withColumn("v", F.lit("a"))
    kept.publish(one, 1)
    kept.publish(spark.range(7).withColumn("w", F.lit(2)), 3)
    assert (kept.read(1).count(), kept.read(2).columns, kept.read(3).columns, kept.read().count(), kept.read(0)) == (5, ["id", "v"], ["id", "w"], 7, None)
    # A task that fails while rows are written shows nothing.
    broken = one.select("id", F.when(F.col("id") < 3, F.col("v")).otherwise(F.raise_error(F.lit("lost"))).alias("v"))
    with pytest.raises(Exception, match="lost"):
        kept.publish(broken, 4)
    assert kept.read(4).count() == 7
    # A driver that stops between writing and showing leaves the last version, and a second run shows its own.
    with monkeypatch.context() as m:
        m.setattr(snapshots.time, "time_ns", lambda: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            kept.publish(spark.range(50).withColumn("v", F.lit("b")), 1)
    assert kept.read(1).count() == 5
    kept.prepare()
    kept.publish(spark.range(50).withColumn("v", F.lit("b")), 1)
    assert kept.read(2).count() == 50 and [(r.week, r.rows) for r in kept.versions().orderBy("week").collect()] == [(1, 50), (3, 7)]


def test_a_shelf_empties_what_it_stored(spark):
    with shared.Shelf(spark) as shelf:
        table = shelf.put(spark.range(10))
        assert table.count() == 10
        path = table.inputFiles()[0].rsplit("/", 1)[0]
    assert spark.read.schema("id long").parquet(path).count() == 0
