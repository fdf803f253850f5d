"""Position rooms of teams: what they hold, and how much a team needs at each position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectra.functions import scalars as S
from prospectra.operators import windows

#: Weight and confidence of the three pressures, and weights of what makes up the second.
PRESSURES = {"depth_pressure": (0.40, 0.78), "transition_pressure": (0.30, 0.72), "lack_investment": (0.30, 0.95)}
TRANSITION = {"average_age": 0.45, "average_experience": 0.35, "veteran_share": 0.20}


def room_profiles(grid: DataFrame, players: DataFrame, picks: DataFrame, keys: Sequence[str], veteran: float = 5.0) -> DataFrame:
    """A row per room of the whole grid: count, average_age, average_experience, their coverage, veteran_share and draft_capital.

    `players` has the keys, age and experience, `picks` the keys and the number of the pick.
    """
    known = F.count("experience")
    held = players.groupBy(*keys).agg(
        F.count("*").alias("count"),
        F.avg("age").alias("average_age"),
        F.avg("experience").alias("average_experience"),
        (F.count("age") / F.count("*")).alias("age_coverage"),
        (known / F.count("*")).alias("experience_coverage"),
        F.try_divide(F.sum(F.when(F.col("experience") >= veteran, 1).otherwise(0)), known).alias("veteran_share"),
    )
    capital = picks.groupBy(*keys).agg(F.sum(F.exp(-(F.col("pick") - 1) / 80.0)).alias("draft_capital"))
    joined = grid.join(held, list(keys), "left").join(capital, list(keys), "left")
    return joined.fillna(0, ["count", "age_coverage", "experience_coverage"]).fillna(0.0, ["draft_capital"])


def needs(rooms: DataFrame, position: str, roster_coverage: float, draft_coverage: float) -> DataFrame:
    """Adds the three pressures, need, need_evidence and need_confidence; teams are compared within a position.

    A thin, old or neglected room presses: by the share of teams whose room is fuller, younger,
    or got more picks. A pressure counts by its weight and by how much of its evidence is there.
    """
    rated = rooms
    for column in ("count", *TRANSITION, "draft_capital"):
        rated = windows.peer_midrank(rated, [position], column, f"__{column}")
    share = F.lit(roster_coverage) * (0.5 * F.col("age_coverage") + 0.5 * F.col("experience_coverage"))
    rated = rated.withColumns(
        {
            "depth_pressure": 100 - F.col("__count"),
            "transition_pressure": S.weighted_mean([(F.col(f"__{c}"), F.lit(w)) for c, w in TRANSITION.items()]),
            "lack_investment": 100 - F.col("__draft_capital"),
        }
    ).drop(*[f"__{c}" for c in ("count", *TRANSITION, "draft_capital")])
    coverage = {"depth_pressure": F.lit(roster_coverage), "transition_pressure": share, "lack_investment": F.lit(draft_coverage)}
    weight = {k: w * coverage[k] for k, (w, _) in PRESSURES.items()}
    there = lambda k, c: F.when(F.col(k).isNotNull(), c)
    return rated.withColumns(
        {
            "need": S.weighted_mean([(F.col(k), weight[k]) for k in PRESSURES]),
            "need_evidence": sum((F.coalesce(there(k, weight[k]), F.lit(0.0)) for k in PRESSURES), F.lit(0.0)),
            "need_confidence": S.weighted_mean([(there(k, F.lit(c)), weight[k]) for k, (_, c) in PRESSURES.items()]),
        }
    )
