"""A player's production from long statistics, and records typed by their columns' names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectra.functions import rules as R
from prospectra.functions import scalars as S

#: What is counted, from which category, under which names, the first that there is.
COUNTS: dict[str, tuple[list[str], list[str]]] = {
    "pass_completions": (["passing"], ["completions", "cmp"]),
    "pass_attempts": (["passing"], ["att", "attempts", "passing_attempts"]),
    "pass_yards": (["passing"], ["yds", "yards", "passing_yards"]),
    "pass_tds": (["passing"], ["td", "touchdowns", "passing_touchdowns"]),
    "pass_interceptions": (["passing"], ["int", "interceptions"]),
    "carries": (["rushing"], ["car", "att", "attempts", "carries"]),
    "rush_yards": (["rushing"], ["yds", "yards", "rushing_yards"]),
    "rush_tds": (["rushing"], ["td", "touchdowns", "rushing_touchdowns"]),
    "receptions": (["receiving"], ["rec", "receptions"]),
    "receiving_yards": (["receiving"], ["yds", "yards", "receiving_yards"]),
    "receiving_tds": (["receiving"], ["td", "touchdowns", "receiving_touchdowns"]),
    "sacks": (["defensive"], ["sacks", "sack", "sk"]),
    "tackles_for_loss": (["defensive"], ["tfl", "tackles_for_loss"]),
    "tackles": (["defensive"], ["tot", "total", "tackles", "total_tackles"]),
    "solo_tackles": (["defensive"], ["solo"]),
    "passes_defended": (["defensive"], ["pd", "passes_defended", "pass_breakups"]),
    "qb_hurries": (["defensive"], ["qb_hur", "hurries"]),
    "forced_fumbles": (["defensive"], ["ff", "forced_fumbles"]),
    "interceptions": (["interceptions", "defensive"], ["int", "interceptions"]),
    "field_goal_attempts": (["kicking"], ["fga"]),
    "field_goals_made": (["kicking"], ["fgm"]),
    "field_goal_share": (["kicking"], ["pct"]),
    "extra_point_attempts": (["kicking"], ["xpa"]),
    "extra_points_made": (["kicking"], ["xpm"]),
    "kicking_points": (["kicking"], ["pts", "points"]),
    "kicking_long": (["kicking"], ["long"]),
    "punts": (["punting"], ["no", "punts"]),
    "punt_yards": (["punting"], ["yds", "yards"]),
    "punt_average": (["punting"], ["ypp", "avg"]),
    "punts_inside_20": (["punting"], ["in_20", "inside_20"]),
    "punt_touchbacks": (["punting"], ["tb", "touchbacks"]),
    "kick_returns": (["kickreturns", "kick_returns"], ["no", "returns"]),
    "kick_return_yards": (["kickreturns", "kick_returns"], ["yds", "yards"]),
    "kick_return_tds": (["kickreturns", "kick_returns"], ["td", "touchdowns"]),
    "kick_return_average": (["kickreturns", "kick_returns"], ["avg"]),
    "punt_returns": (["puntreturns", "punt_returns"], ["no", "returns"]),
    "punt_return_yards": (["puntreturns", "punt_returns"], ["yds", "yards"]),
    "punt_return_tds": (["puntreturns", "punt_returns"], ["td", "touchdowns"]),
    "punt_return_average": (["puntreturns", "punt_returns"], ["avg"]),
}
#: Completions and attempts in one text.
COMBINED = ["c_att", "cmp_att", "completions_attempts"]
#: Rates as numerator, denominator, the rate before any evidence, and how many tries that is worth.
RATES: dict[str, tuple[str, str, float, float]] = {
    "completion_pct": ("pass_completions", "pass_attempts", 0.60, 25.0),
    "yards_per_attempt": ("pass_yards", "pass_attempts", 7.0, 25.0),
    "td_rate": ("pass_tds", "pass_attempts", 0.045, 25.0),
    "interception_rate": ("pass_interceptions", "pass_attempts", 0.025, 25.0),
    "yards_per_carry": ("rush_yards", "carries", 4.5, 20.0),
    "yards_per_reception": ("receiving_yards", "receptions", 12.0, 8.0),
    "yards_per_touch": ("scrimmage_yards", "touches", 5.5, 15.0),
}
#: What is divided by games.
PER_GAME = {"sacks_per_game": "sacks", "tfl_per_game": "tackles_for_loss", "takeaways_per_game": "takeaways", "passes_defended_per_game": "passes_defended"}
#: Counts that only help others.
INNER = ["forced_fumbles", "field_goal_share", "punt_average", "kick_return_average", "punt_return_average"]


def _either(a: str, b: str) -> Column:
    """The sum, in which one may be missing but not both."""
    return F.when(F.col(a).isNotNull() | F.col(b).isNotNull(), F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))


def production(stats: DataFrame, key: str, category: str, stat: str, value: str, games: str | None = None) -> DataFrame:
    """One row per player: prod_ counts, rates drawn to their usual level by few tries, and the observed_ rates.

    `stats` is long: a row per player, category and statistic, of which the value may be text; names
    are compared as slugs. `games` names a column that repeats the player's games. A statistic in
    several rows has the smallest value of its first name.
    """
    named = stats.withColumns({"__c": S.slug(F.col(category)), "__s": S.slug(F.col(stat)), "__x": S.first_number(F.col(value).cast("string")), "__text": F.col(value).cast("string")})

    def first(categories: Sequence[str], names: Sequence[str]) -> Column:
        order = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col("__c")) * 100 + F.array_position(F.array(*[F.lit(s) for s in names]), F.col("__s"))
        found = F.col("__c").isin(*categories) & F.col("__s").isin(*names) & F.col("__x").isNotNull()
        return F.min(F.when(found, F.struct(order.alias("o"), F.col("__x").alias("x"))))["x"]

    both = F.min(F.when((F.col("__c") == "passing") & F.col("__s").isin(*COMBINED) & F.col("__text").contains("/"), F.col("__text")))
    counted = named.groupBy(key).agg(*[first(*where).alias(k) for k, where in COUNTS.items()], both.alias("__both"), (F.max(games) if games else F.lit(None).cast("double")).alias("__games"))
    made, tried = (S.first_number(F.split("__both", "/", 2)[i]) for i in (0, 1))
    counted = counted.withColumns({"pass_completions": F.when(F.col("__both").isNotNull(), made).otherwise(F.col("pass_completions")), "pass_attempts": F.when(F.col("__both").isNotNull(), tried).otherwise(F.col("pass_attempts"))})
    share = F.when(F.col("field_goal_share") > 1, F.col("field_goal_share") / 100).otherwise(F.col("field_goal_share"))
    mean = lambda given, top, bottom: F.coalesce(F.col(given), F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)))
    summed = counted.withColumns(
        {
            "scrimmage_yards": _either("rush_yards", "receiving_yards"),
            "touchdowns": _either("rush_tds", "receiving_tds"),
            "touches": F.coalesce("carries", F.lit(0.0)) + F.coalesce("receptions", F.lit(0.0)),
            "takeaways": _either("interceptions", "forced_fumbles"),
            "field_goal_pct": F.coalesce(F.when(F.col("field_goal_attempts") > 0, F.col("field_goals_made") / F.col("field_goal_attempts")), share),
            "yards_per_punt": mean("punt_average", "punt_yards", "punts"),
            "yards_per_kick_return": mean("kick_return_average", "kick_return_yards", "kick_returns"),
            "yards_per_punt_return": mean("punt_return_average", "punt_return_yards", "punt_returns"),
        }
    )
    plain = [k for k in COUNTS if k not in INNER] + ["scrimmage_yards", "touchdowns", "field_goal_pct", "yards_per_punt", "yards_per_kick_return", "yards_per_punt_return"]
    smoothed = {f"prod_{k}": S.smoothed_rate(F.col(a), F.col(b), prior, strength) for k, (a, b, prior, strength) in RATES.items()}
    observed = {f"observed_{k}": F.when(F.col(b) > 0, F.col(a) / F.col(b)) for k, (a, b, _, _) in RATES.items()}
    per_game = {f"prod_{k}": F.when(F.col("__games") > 0, F.col(c) / F.col("__games")) for k, c in PER_GAME.items()}
    return summed.select(key, *[F.col(k).alias(f"prod_{k}") for k in plain], *[c.alias(k) for k, c in {**smoothed, **observed, **per_game}.items()])


#: What columns of records are also called.
ALIASES = {
    "player_name": "name", "pos": "position", "school_name": "school", "college": "school", "ht": "height_in", "wt": "weight_lb", "forty": "forty_s",
    "bench": "bench_reps", "vertical": "vertical_in", "broad_jump": "broad_jump_in", "cone": "three_cone_s", "shuttle": "shuttle_s",
}
#: Columns that hold a flag.
FLAGS = ["drafted", "elite", "draft_declared", "draft_eligible", "data_stale"]
#: Columns that hold a number, besides those of the prefixes below.
NUMBERS = [
    "weight_lb", "forty_s", "ten_split_s", "bench_reps", "vertical_in", "broad_jump_in", "three_cone_s", "shuttle_s", "arm_length_in", "hand_size_in", "wingspan_in",
    "draft_year", "draft_ovr", "draft_round", "season", "as_of_week", "age_at_draft", "draft_entry_probability",
]
PREFIXES = ("prod_", "trait_")


def normalized(df: DataFrame, aliases: Mapping[str, str] = ALIASES) -> DataFrame:
    """Records with their usual names, trimmed and typed by name: flags, heights, numbers, else text; positions by group, with derived measures.

    Of several columns with one name after renaming, the first that has a value counts. Texts that
    stand for a missing value are null; position_raw keeps what a position was called.
    """
    by_name: dict[str, list[Column]] = {}
    for c in df.columns:
        by_name.setdefault(aliases.get(c.strip(), c.strip()), []).append(S.present(F.col(f"`{c}`")))
    out = {}
    for name, columns in by_name.items():
        text = F.coalesce(*columns)
        numeric = name in NUMBERS or name.startswith(PREFIXES)
        out[name] = S.height_inches(text) if name == "height_in" else S.boolean(text) if name in FLAGS else S.number(text) if numeric else text
    if "position" in out:
        out["position_raw"] = F.coalesce(out["position_raw"], out["position"]) if "position_raw" in out else out["position"]
        out["position"] = F.when(out["position"].isNotNull(), R.position_group(out["position"]))
    rows = df.select(*[c.alias(k) for k, c in out.items()])
    measures = ["height_in", "weight_lb", "forty_s", "vertical_in", "broad_jump_in"]
    made = R.derived_measures(*[F.col(m) if m in out else F.lit(None).cast("double") for m in measures])
    return rows.withColumns({k: F.coalesce(c, F.col(k)) if k in out else c for k, c in made.items()})
