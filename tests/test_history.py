"""Histories against plain sums, and a drained stream of two sources against the tables."""

import datetime as dt
import random

from pyspark.sql import functions as F

from prospectra.operators import history
from prospectra.streaming import history as stream


def test_verdicts_and_totals_to_date(spark):
    box = spark.createDataFrame([("a", 1, 2), ("a", 1, 3), ("a", 2, 5), ("a", 3, 7), ("b", 9, 1), ("b", None, 1), (None, 3, 4), ("b", 4, 6)], "p string, game int, v int")
    schedule = spark.createDataFrame([(1, 2001, "final"), (2, 2002, "final"), (3, 2004, "final"), (3, 2004, "open"), (4, 2002, None), (None, 1, "final")], "game int, season int, status string")
    rows = history.judged_rows(box, schedule, "game", F.col("status") == "final")
    assert rows.count() == 8 and {(x.season, x.kept, x.unfinished, x.unknown_game, x.no_game) for x in history.drop_counts(rows, ["season"]).collect()} == {(2001, 2, 0, 0, 0), (2002, 1, 1, 0, 0), (2004, 2, 0, 0, 0), (None, 0, 0, 1, 1)}
    points = history.checkpoints(rows.where("verdict = 'kept'"), ["p"], "season", {"v": F.col("v")})
    assert {tuple(x) for x in points.collect()} == {("a", 2001, 5, 5), ("a", 2002, 5, 10), ("a", 2004, 7, 17), (None, 2004, 4, 4)}
    assert {(x.p, x.season, x.v_to_date) for x in history.as_of(points, ["p"], "season", 2003).collect()} == {("a", 2002, 10)}
    assert history.checkpoints(rows.limit(0), ["p"], "season", {"v": F.col("v")}).count() == 0


def test_a_drained_stream_of_both_sides_gives_the_tables_totals(spark, tmp_path):
    r = random.Random(9)
    start = dt.datetime(2024, 1, 1)
    games = [(g, start + dt.timedelta(hours=r.randrange(24 * 70))) for g in range(120)]
    box = [(r.choice("abcd"), g, at + dt.timedelta(hours=r.randrange(-200, 200)), r.randrange(9)) for g, at in games for _ in range(6)]
    # Far later rows on both sides, so that all weeks before them are closed.
    end = start + dt.timedelta(days=400)
    flush = [(900, end), (901, end + dt.timedelta(days=90)), (902, end + dt.timedelta(days=180))]
    for k, part in enumerate((0, 1)):
        spark.createDataFrame([x for x in games if x[0] % 2 == part], "game int, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/games/{k}")
        spark.createDataFrame([x for x in box if x[3] % 2 == part], "p string, game int, t timestamp, v int").coalesce(1).write.parquet(f"{tmp_path}/box/{k}")
    for k, (g, at) in enumerate(flush):
        spark.createDataFrame([(g, at)], "game int, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/games/{k + 2}")
        spark.createDataFrame([("z", g, at, 1)], "p string, game int, t timestamp, v int").coalesce(1).write.parquet(f"{tmp_path}/box/{k + 2}")
    made = lambda b, g: stream.weekly_totals(b, g, "game", "p", "t", "at", {"v": F.col("v"), "n": F.lit(1)}, late="100 days")
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/{name}/*")
    query = made(read("box", "p string, game int, t timestamp, v int"), read("games", "game int, at timestamp")).writeStream.format("memory").queryName("weeks").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(200)
    got = {tuple(x) for x in spark.table("weeks").where("p <> 'z'").collect()}
    whole = made(spark.read.parquet(f"file://{tmp_path}/box/*"), spark.read.parquet(f"file://{tmp_path}/games/*"))
    assert got == {tuple(x) for x in whole.where("p <> 'z'").collect()} and len(got) > 30
    at = dict(games)
    assert sum(x[3] for x in got) == sum(abs((t - at[g]).total_seconds()) <= 7 * 86400 for _, g, t, _ in box)
