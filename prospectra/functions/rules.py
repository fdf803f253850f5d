"""Rules of the domain on single rows as column expressions: positions, classes, production, contracts, gates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from prospectra.functions import scalars as S

#: What positions are called, and the group that each belongs to.
POSITIONS = {
    "QB": "QB", "RB": "RB", "HB": "RB", "TB": "RB", "FB": "RB", "WR": "WR", "SE": "WR", "FL": "WR", "TE": "TE",
    "OT": "OT", "T": "OT", "LT": "OT", "RT": "OT", "OL": "IOL", "IOL": "IOL", "OG": "IOL", "G": "IOL", "LG": "IOL", "RG": "IOL", "C": "IOL", "OC": "IOL",
    "EDGE": "EDGE", "DE": "EDGE", "OLB": "EDGE", "IDL": "IDL", "DL": "IDL", "DT": "IDL", "NT": "IDL",
    "LB": "LB", "ILB": "LB", "MLB": "LB", "WLB": "LB", "SLB": "LB", "CB": "CB", "DB": "S", "S": "S", "SAF": "S", "FS": "S", "SS": "S",
    "K": "K", "PK": "K", "P": "P", "LS": "LS",
}
#: Class years in words.
CLASSES = {
    "fr": 1.0, "freshman": 1.0, "rfr": 1.5, "redshirtfreshman": 1.5, "so": 2.0, "sophomore": 2.0, "rso": 2.5, "redshirtsophomore": 2.5,
    "jr": 3.0, "junior": 3.0, "rjr": 3.5, "redshirtjunior": 3.5, "sr": 4.0, "senior": 4.0, "rsr": 4.5, "redshirtsenior": 4.5,
    "gr": 5.0, "grad": 5.0, "graduate": 5.0,
}
#: Statuses of games that are over, and of players on a roster.
FINAL = ["FINAL", "STATUSFINAL", "COMPLETE", "STATUSCOMPLETE", "COMPLETED", "STATUSCOMPLETED"]
ACTIVE = ["ACT", "RES", "E14", "INA", "PUP", "SUS", "EXE", "DEV"]
#: Units of length in inches, of weight in pounds.
INCHES = {"cm": 1 / 2.54, "m": 39.37007874, "in": 1.0, "ft": 12.0}
POUNDS = {"kg": 2.2046226218, "lb": 1.0}
#: Readiness for the draft by class year.
READINESS = [(1, 0), (2, 25), (3, 55), (4, 82), (5, 100)]


def position_group(c: Column) -> Column:
    """The group of a position's name, else that of its first known part, else the name itself in capitals."""
    raw = F.upper(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    parts = F.filter(F.transform(F.split(raw, r"[/\- ,]+"), lambda x: S.lookup(x, POSITIONS)), lambda x: x.isNotNull())
    return F.coalesce(S.lookup(raw, POSITIONS), F.try_element_at(parts, F.lit(1)), raw)


def class_number(c: Column) -> Column:
    """1 to 5, halves for redshirts; null for other words."""
    return F.coalesce(S.number(c), S.lookup(F.regexp_replace(F.lower(S.ascii_text(c)), "[^a-z0-9]", ""), CLASSES))


def class_readiness(c: Column) -> Column:
    return F.coalesce(S.piecewise(class_number(c), READINESS), F.lit(0.0))


def game_complete(status: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(status, F.lit(""))), "[^A-Z]", "").isin(FINAL)


def active(status: Column) -> Column:
    return F.coalesce(F.upper(F.trim(status)).isin(ACTIVE), F.lit(False))


def converted(value: Column, unit: Column, factors: Mapping[str, float]) -> Column:
    """Null for other units."""
    return S.number(value) * S.lookup(unit, factors)


def plausible(value: Column, low: float, high: float) -> tuple[Column, Column]:
    """The value where it lies in the range, and whether it is fit for use: a missing one is."""
    inside = value.between(low, high)
    return F.when(inside, value), F.coalesce(inside, F.lit(True))


def derived_measures(height: Column, weight: Column, forty: Column, vertical: Column, broad: Column) -> dict[str, Column]:
    return {
        "bmi": F.when((height != 0) & (weight != 0), F.round(703.0 * weight / (height * height), 4)),
        "speed_score": F.when((weight != 0) & (forty > 0), F.round(weight * 200.0 / F.pow(forty, 4), 4)),
        "explosion_index": F.round(vertical + broad / 4.0, 4),
    }


def success_rate(rate: Column, successes: Column, plays: Column) -> Column:
    return F.coalesce(rate, F.when(plays > 0, successes / plays))


def career_elite(hall: Column, all_pro: Column, bowls: Column) -> Column:
    """Of the hall of fame, an all-pro, or three bowls; null where nothing is known."""
    known = hall.isNotNull() | all_pro.isNotNull() | bowls.isNotNull()
    return F.when(known, F.coalesce(hall, F.lit(False)) | F.coalesce(all_pro >= 1, F.lit(False)) | F.coalesce(bowls >= 3, F.lit(False)))


def production_per_game(position: Column, games: Column, stats: Mapping[str, Column]) -> Column:
    """Points for a game by what counts at a position, 0 at least; null without games or for other positions."""
    n = lambda name: F.coalesce(stats[name], F.lit(0.0)) if name in stats else F.lit(0.0)
    total = lambda **weights: sum((w * n(k) for k, w in weights.items()), F.lit(0.0))
    by_position = {
        ("QB",): total(passing_yards=0.04, passing_tds=4.0, passing_interceptions=-3.0, rushing_yards=0.1, rushing_tds=6.0),
        ("RB",): total(rushing_yards=0.1, receiving_yards=0.1, rushing_tds=6.0, receiving_tds=6.0, receptions=0.5),
        ("WR", "TE"): total(receiving_yards=0.1, receiving_tds=6.0, receptions=0.5),
        ("EDGE", "IDL", "LB", "CB", "S"): F.greatest(n("def_tackle_assists"), n("def_tackles_with_assist"))
        + total(def_tackles_solo=1.0, def_sacks=4.0, def_tackles_for_loss=3.0, def_interceptions=5.0, def_pass_defended=1.5, def_qb_hits=1.5),
        ("K",): total(fg_made=3.0, pat_made=1.0) - F.greatest(F.lit(0.0), n("fg_att") - n("fg_made")),
        ("P",): total(pt_att=1.0, pt_inside_20=0.5),
    }
    value = F.lit(None).cast("double")
    for positions, points in by_position.items():
        value = F.when(position.isin(*positions), points).otherwise(value)
    return F.when((games > 0) & value.isNotNull(), F.greatest(F.lit(0.0), value / games))


def blended(current: Column, prior: Column, week: Column) -> Column:
    """Both seasons' values by how far the season is, or the one that there is."""
    w = S.clamp(week / 8.0, 0.15, 0.75)
    return F.coalesce(w * current + (1 - w) * prior, current, prior)


def evidence_maturity(current: Column, prior: Column, week: Column) -> Column:
    """By the week where the current season has evidence; 0.9 with the prior season's alone."""
    return F.when(current.isNotNull(), 0.35 + 0.65 * F.least(F.lit(1.0), F.greatest(F.lit(0), week) / 8.0)).when(prior.isNotNull(), 0.9).otherwise(0.0)


def contract_urgency(signed: Column, years: Column, season: Column | int) -> Column:
    """100, 65, 25 or 0 for a contract that ends this season, the next, the one after or later."""
    left = (signed + years - 1).cast("int") - season
    return F.when(signed.isNotNull() & (years > 0), F.when(left <= 0, 100.0).when(left == 1, 65.0).when(left == 2, 25.0).otherwise(0.0))


def source_is_stale(as_of: Column, season: int) -> Column:
    """Whether a source is from before last season, or doesn't say."""
    return F.coalesce(F.substring(F.trim(as_of), 1, 4).try_cast("int") < season - 1, F.lit(True))


def entry_probability(explicit: Column, declared: Column, eligible: Column) -> tuple[Column, Column]:
    """The chance that a player enters the draft, and what it rests on."""
    said_no, said_yes = explicit.isNotNull() & (explicit != 0), explicit.isNotNull() & (explicit != 1)
    wrong = explicit.isNotNull() & ~explicit.between(0.0, 1.0)
    yes, no = F.coalesce(declared, F.lit(False)), ~F.coalesce(eligible, F.lit(True))
    clash = (yes & no) | (yes & said_yes) | (~yes & no & said_no)
    value = F.when(wrong | clash, F.lit(None)).when(yes, 1.0).when(no, 0.0).otherwise(explicit)
    basis = F.when(wrong, "invalid").when(clash, "contradictory").when(yes, "declared").when(no, "ineligible").when(explicit.isNotNull(), "supplied").otherwise("unknown")
    return value, basis


def model_stage(explicit: Column, kind: Column, population: Column) -> Column:
    said, kind, population = F.lower(F.trim(F.coalesce(explicit, F.lit("")))), F.lower(F.coalesce(kind, F.lit(""))), F.lower(F.coalesce(population, F.lit("")))
    college = (kind == "unconditional_next_draft") & population.contains("fbs roster")
    combine = (kind == "conditional_on_combine_invitation") | population.contains("combine")
    return F.when(said != "", said).when(college, "college_precombine").when(combine, "combine").otherwise("custom")


def depth_position(raw: Column, scheme: Column, aliases: Mapping[str, str], outside: list[str]) -> Column:
    """The group of a place on a depth chart, empty for places `outside` of all groups; in a 3-4 scheme ends are inside and outer linebackers are edges."""
    place = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    odd = scheme.contains("3-4")
    return (
        F.when(place.isin(outside), "")
        .when(odd & place.isin("LDE", "RDE"), "IDL")
        .when(odd & place.isin("SLB", "WLB"), "EDGE")
        .otherwise(F.coalesce(S.lookup(place, aliases), position_group(place)))
    )


def team_code(c: Column, aliases: Mapping[str, str]) -> Column:
    """The code of a team's name, a code of two or three letters itself, else empty."""
    raw = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return F.coalesce(S.lookup(raw, aliases), F.when(F.length(raw).between(2, 3), raw), F.lit(""))


def with_source(**sources: Column) -> tuple[Column, Column]:
    """The first value that there is, and the name of its source."""
    value = F.coalesce(*sources.values())
    named = F.coalesce(*[F.when(c.isNotNull(), F.lit(k)) for k, c in sources.items()])
    return value, named


def reasons(**failed: Column) -> Column:
    """The names of the conditions that hold, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in failed.items()]), lambda x: x.isNotNull())


def passes_publication(rows: Column, brier: Column, base: Column, auc: Column, precision: Column, prevalence: Column) -> Column:
    ok = (rows >= 50) & (brier < base * 0.995) & (auc >= 0.55) & (precision >= prevalence + 0.02)
    return F.coalesce(ok, F.lit(False))


def passes_stage(years: Column, positives: Column, negatives: Column, calibrated: Column) -> Column:
    return F.coalesce((years >= 4) & (positives >= 30) & (negatives >= 100) & calibrated, F.lit(False))


def confidence_label(coverage: Column, confidence: Column) -> Column:
    return F.when((coverage >= 0.75) & (confidence >= 0.8), "strong").when(coverage * confidence >= 0.4, "moderate").otherwise("limited")
