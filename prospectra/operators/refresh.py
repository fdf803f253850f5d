"""Discovered rows taken into tracked ones: what is owned by the source is refreshed, what people entered stays."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Rules:
    """Which columns of tracked rows survive a refresh. Prefixes name groups of columns."""

    keep: Collection[str] = ()
    keep_prefixes: Sequence[str] = ("trait_",)
    #: Measurements: kept where verified or from another source than `weak_sources`, else only where the discovered row has none.
    measures: Collection[str] = ()
    measure_details: Collection[str] = ("measurement_source", "measurement_date", "measurements_verified")
    weak_sources: Collection[str] = ("", "school_roster")
    #: Totals of a week: kept where the discovered row has none and the tracked one is of the same week.
    totals_prefixes: Sequence[str] = ("prod_",)
    #: Columns of the source itself, emptied before a refresh so that an earlier state does not leak into it.
    owned_prefixes: Sequence[str] = ("cfbd_", "observed_")
    owned: Collection[str] = field(default_factory=tuple)


def _starts(name: str, prefixes: Sequence[str]) -> bool:
    return any(name.startswith(p) for p in prefixes)


def _filled(column: Column, kind: str) -> Column:
    return F.when(F.trim(column) != "", column) if kind == "string" else column


def cleared(rows: DataFrame, rules: Rules) -> DataFrame:
    """`rows` with what the source owns emptied."""
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in rows.dtypes if c in rules.owned or _starts(c, rules.owned_prefixes)})


def refreshed(discovered: DataFrame, tracked: DataFrame, key: str, week: int, rules: Rules, as_of: str = "as_of_week") -> DataFrame:
    """One row per key of either side, with the columns of both and `origin` (refreshed, discovered, tracked).

    A key is expected once on each side; null keys match nothing. Of a key on both sides the
    discovered values count, but what `rules` keep; blank text is empty, and an empty value never
    replaces another. A tracked row that was not discovered stays, without what the source owns.
    """
    a, b = dict(discovered.dtypes), dict(tracked.dtypes)
    names = [*a, *[c for c in b if c not in a]]
    new = discovered.select(*[F.col(c).alias(f"n_{c}") for c in a], F.lit(True).alias("__new"))
    old = cleared(tracked, rules).select(*[F.col(c).alias(f"o_{c}") for c in b], F.lit(True).alias("__old"))
    both = new.join(old, F.col(f"n_{key}") == F.col(f"o_{key}"), "full_outer")
    has = lambda c: c in b
    source = F.lower(F.trim(F.coalesce(F.col("o_measurement_source").cast("string"), F.lit("")))) if has("measurement_source") else F.lit("")
    verified = F.coalesce(F.lower(F.col("o_measurements_verified").cast("string")).isin("true", "1", "yes", "y"), F.lit(False)) if has("measurements_verified") else F.lit(False)
    strong = verified | ~source.isin(*rules.weak_sources)
    same_week = F.coalesce(F.col(f"o_{as_of}").cast("double").cast("bigint") == week, F.lit(False)) if has(as_of) else F.lit(False)

    def value(c: str) -> Column:
        n = _filled(F.col(f"n_{c}"), a[c]) if c in a else F.lit(None).cast(b[c])
        if c not in b:
            return n
        o = _filled(F.col(f"o_{c}").cast(a.get(c, b[c])), a.get(c, b[c]))
        if c in rules.keep or _starts(c, rules.keep_prefixes):
            merged = F.coalesce(o, n)
        elif c in rules.measures:
            merged = F.when(strong, F.coalesce(o, n)).otherwise(F.coalesce(n, o))
        elif c in rules.measure_details:
            merged = F.when(strong, F.coalesce(o, n)).otherwise(n)
        elif _starts(c, rules.totals_prefixes):
            merged = F.when(same_week, F.coalesce(n, o)).otherwise(n)
        else:
            merged = n
        return F.when(F.col("__new").isNull(), o).otherwise(F.when(F.col("__old").isNull(), n).otherwise(merged))

    origin = F.when(F.col("__new") & F.col("__old"), "refreshed").when(F.col("__new"), "discovered").otherwise("tracked")
    return both.select(*[(F.coalesce(f"n_{c}", f"o_{c}") if c == key else value(c)).alias(c) for c in names], origin.alias("origin"))
