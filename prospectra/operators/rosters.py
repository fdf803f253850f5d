"""Rosters and their evidence: who is eligible, whose statistics are whose, and how they rank before any model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prospectra.functions import rules as R
from prospectra.functions import scalars as S
from prospectra.operators import joins, ranks, windows


def eligible(roster: DataFrame, teams: DataFrame, player: str, team: str, division: Column, order: Sequence[Column]) -> DataFrame:
    """One row per player: the first in `order` among rows of teams that count.

    `teams` has `team`, `counts` and `exhibition`. A row of a team that is not there counts by its own `division`.
    """
    known = teams.select(F.col(team).alias("__t"), F.col("counts").alias("__counts"), F.col("exhibition").alias("__show"))
    joined = roster.where(F.col(player).isNotNull()).join(known, F.col(team) == F.col("__t"), "left")
    inside = F.coalesce(F.col("__counts") & ~F.col("__show"), F.lower(F.trim(division)) == "fbs", F.lit(False))
    return windows.best_rows(joined.where(inside).drop("__t", "__counts", "__show"), [player], order)


def finished(box: DataFrame, schedule: DataFrame, game: str, status: str) -> DataFrame:
    """The rows of games that are over. An empty schedule says nothing about any game: all rows stay."""
    if schedule.isEmpty():
        return box
    return box.join(schedule.where(R.game_complete(F.col(status))).select(game).distinct(), game, "left_semi")


def with_statistics(roster: DataFrame, stats: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The roster with `value` of the statistics' row that its id or else its unique name finds; each row of statistics goes to one player only, the first by key and then id."""
    matched = joins.match_cascade(roster, stats, keys, value, "stats_of").drop("stats_of_conflict")
    first = Window.partitionBy("stats_of").orderBy(*[F.when(F.col("stats_of_method") == k, i).otherwise(len(keys)) for i, k in enumerate(keys)], *[F.col(k) for k in keys])
    claimed = matched.where("stats_of is not null").withColumn("__claim", F.row_number().over(first))
    kept = claimed.withColumn("stats_of", F.when(F.col("__claim") == 1, F.col("stats_of"))).withColumn("stats_of_method", F.when(F.col("__claim") == 1, F.col("stats_of_method"))).drop("__claim")
    return kept.unionByName(matched.where("stats_of is null"))


def orphans(stats: DataFrame, roster: DataFrame, key: str) -> DataFrame:
    """Statistics of players who are on no roster."""
    return stats.join(roster.select(key), key, "left_anti")


def counted_rank(df: DataFrame, groups: Sequence[str], scores: Sequence[str], ties: Sequence[Column], out: str) -> DataFrame:
    """Adds the row's number in its group by `scores`, highest first and nulls last, and then by `ties`."""
    return ranks.numbered(df, groups, [*[F.desc_nulls_last(s) for s in scores], *ties], out)


def discovery(df: DataFrame, key: str, position: str, metrics: Mapping[str, bool], class_year: str, measures: Sequence[str], name: str) -> DataFrame:
    """Adds score, metric_count, tier, rank and position_rank.

    The score is the mean of a player's percentiles among the position's players, of the metrics that
    there are (`metrics` says for each whether less is better); a player without any is scored by the
    class and by how many of the `measures` are known, and ranks after all others.
    """
    long = df.unpivot([key, position], list(metrics), "metric", "value").where("value is not null and not isnan(value)")
    lower = [m for m, less in metrics.items() if less]
    ranked = windows.peer_midrank(long, [position, "metric"], "value", "share")
    share = F.round(F.when(F.col("metric").isin(lower), 100 - F.col("share")).otherwise(F.col("share")), 3)
    per_player = ranked.groupBy(F.col(key).alias("__key")).agg(F.sum(share).alias("__sum"), F.count("*").alias("__n"))
    known = sum((F.when(F.col(m).isNotNull(), 1.0).otherwise(0.0) for m in measures), F.lit(0.0)) / len(measures)
    joined = df.join(per_player, F.col(key) == F.col("__key"), "left")
    scored = joined.withColumns(
        {
            "metric_count": F.coalesce("__n", F.lit(0)),
            "tier": F.when(F.col("__n") > 0, "production").otherwise("roster_only"),
            "score": F.coalesce(F.round(F.col("__sum") / F.col("__n"), 3), F.round(0.8 * R.class_readiness(F.col(class_year)) + 0.2 * 100 * known, 3)),
        }
    ).drop("__key", "__sum", "__n")
    by, ties = ["tier_first", "score", "metric_count"], [S.name_key(F.col(name)), F.col(key)]
    first = scored.withColumn("tier_first", (F.col("tier") == "production").cast("int"))
    overall = counted_rank(first, [], by, ties, "rank")
    return counted_rank(overall, [position], by, ties, "position_rank").drop("tier_first")


def recruiting_evidence(players: DataFrame, recruits: DataFrame, player: str, ids: str, athlete: str, season: str) -> DataFrame:
    """The best recruiting row of each player: by recruit id or athlete id, never by name; of no later year, with a rating from 0 to 1 and stars from 0 to 5.

    `recruits` has id, athlete_id, year, rating, stars.
    """
    sound = recruits.where(F.col("rating").between(0, 1) & F.col("stars").between(0, 5))
    by_id = players.select(player, season, F.explode(ids).alias("id")).join(sound, "id").withColumn("by", F.lit(0))
    by_athlete = players.select(player, season, F.col(athlete).alias("athlete_id")).join(sound, "athlete_id").withColumn("by", F.lit(1))
    rows = by_id.select(player, season, "id", "year", "rating", "stars", "by").unionByName(by_athlete.select(player, season, "id", "year", "rating", "stars", "by"))
    usable = rows.where(F.col("year") <= F.col(season))
    return windows.best_rows(usable, [player], [F.desc("year"), F.desc("rating"), F.desc("stars"), F.asc("by"), F.asc("id")]).select(player, "id", "year", "rating", "stars")


def starters(depth: DataFrame, team: str, position: str, rank: str, scheme: str, name: Column) -> DataFrame:
    """The first of each place; of receivers and tight ends as many as the team's schemes call for (`3WR`), where they do."""
    wanted = F.max(F.regexp_extract(F.col(scheme), r"(?i)(\d+)\s*(WR|TE)\b", 1).try_cast("int"))
    called = depth.where(F.col(position).isin("WR", "TE")).where(F.upper(F.regexp_extract(F.col(scheme), r"(?i)\d+\s*(WR|TE)\b", 1)) == F.col(position))
    counts = called.groupBy(F.col(team).alias("__t"), F.col(position).alias("__p")).agg(wanted.alias("__wanted"))
    joined = depth.join(counts, (F.col(team) == F.col("__t")) & (F.col(position) == F.col("__p")), "left")
    place = F.row_number().over(Window.partitionBy(team, position).orderBy(F.asc_nulls_last(rank), name))
    return joined.withColumn("__place", place).where(F.when(F.col("__wanted").isNotNull(), F.col("__place") <= F.col("__wanted")).otherwise(F.col(rank) == 1)).drop("__t", "__p", "__wanted", "__place")
