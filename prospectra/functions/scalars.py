"""Scalar rules on text and numbers as column expressions: keys, parsing, typing, interpolation, clamps."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing value, and for true and false.
MISSING = ["", "na", "n/a", "nan", "none", "null", "unknown", "-"]
TRUE = ["1", "1.0", "true", "yes", "y", "drafted", "verified"]
FALSE = ["0", "0.0", "false", "no", "n", "undrafted", "unverified"]
#: Generational suffixes that a name key drops.
SUFFIXES = ["jr", "sr", "ii", "iii", "iv"]


def present(c: Column) -> Column:
    """The trimmed text, or null where it stands for a missing value."""
    text = F.trim(c.cast("string"))
    return F.when(~F.lower(text).isin(MISSING), text)


def number(c: Column) -> Column:
    """A finite number: commas dropped, a percent sign divides by 100; null for missing or other text."""
    text = F.replace(present(c), F.lit(","), F.lit(""))
    percent = text.endswith("%")
    digits = F.regexp_replace(text, "%$", "")
    value = F.when(digits.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), digits.try_cast("double"))
    return F.when(percent, value / 100).otherwise(value)


def boolean(c: Column) -> Column:
    text = F.lower(present(c))
    return F.when(text.isin(TRUE), F.lit(True)).when(text.isin(FALSE), F.lit(False))


def height_inches(c: Column) -> Column:
    """`6-1`, `6'1"` or `6 1 in` as inches; else the number itself."""
    shape = r"^\s*(\d+)\s*(?:-|'|\s)\s*(\d+(?:\.\d+)?)\s*(?:\"|in)?\s*$"
    feet, inches = F.regexp_extract(c, shape, 1), F.regexp_extract(c, shape, 2)
    return F.when(feet != "", feet.cast("double") * 12 + inches.cast("double")).otherwise(number(c))


@functools.lru_cache(maxsize=1)
def _folds() -> tuple[str, str, dict[str, str]]:
    """All characters whose compatibility decomposition leaves one ASCII character, those characters, and what leaves several."""
    composed = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.decomposition(chr(c))]
    left = {c: unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() for c in composed}
    single = {c: t for c, t in left.items() if len(t) == 1}
    return "".join(single), "".join(single.values()), {c: t for c, t in left.items() if len(t) > 1}


def ascii_text(c: Column) -> Column:
    """The text without accents and ligatures; characters that have no ASCII form are dropped."""
    singles, plain, several = _folds()
    text = F.translate(c.cast("string"), singles, plain)
    # Ligatures and the like are rare: most texts skip this.
    table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    apart = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    spelled = F.array_join(F.transform(apart, lambda x: F.coalesce(F.element_at(table, x), x)), "")
    return F.regexp_replace(F.when(text.rlike(r"[^\x00-\x7F]"), spelled).otherwise(text), r"[^\x00-\x7F]", "")


def name_key(c: Column) -> Column:
    """A lower-case key of letters and digits, without accents and generational suffixes."""
    words = F.regexp_replace(F.lower(ascii_text(c)), rf"\b({'|'.join(SUFFIXES)})\b", "")
    return F.regexp_replace(words, "[^a-z0-9]", "")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(ascii_text(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def lookup(c: Column, table: Mapping[str, object]) -> Column:
    """The table's value, null for other keys."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c)


def first_present(*columns: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c.cast("string")) != "", c) for c in columns])


def surname(c: Column) -> Column:
    """The key of the last word that is not a generational suffix; an empty text without one."""
    tokens = F.regexp_extract_all(ascii_text(c), F.lit(r"([A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*)"))
    keys = F.filter(F.transform(tokens, name_key), lambda t: t != "")
    return F.coalesce(F.try_element_at(keys, F.lit(-1)), F.lit(""))


def first_number(c: Column) -> Column:
    found = F.regexp_extract(c, r"(-?\d+(?:\.\d+)?)", 1)
    return F.when(found != "", found.cast("double"))


def ratio_parts(c: Column, separator: str = "/") -> tuple[Column, Column]:
    """Both numbers of text like `20/30`."""
    parts = F.split(c, separator)
    return parts.getItem(0).try_cast("double"), parts.getItem(1).try_cast("double")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def piecewise(c: Column, anchors: Sequence[tuple[float, float]]) -> Column:
    """Linear between anchors (x, y) in order of x, constant beyond them."""
    out = F.when(c <= anchors[0][0], F.lit(float(anchors[0][1])))
    for (x0, y0), (x1, y1) in zip(anchors, anchors[1:]):
        out = out.when(c <= x1, y0 + (c - x0) * ((y1 - y0) / (x1 - x0)))
    return out.when(c > anchors[-1][0], F.lit(float(anchors[-1][1])))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-clamp(c, -700.0, 700.0)))


def logit(p: Column) -> Column:
    q = clamp(p, 1e-9, 1 - 1e-9)
    return F.log(q / (1 - q))


def smoothed_rate(x: Column, n: Column, prior: float, strength: float) -> Column:
    """(x + prior * strength) / (n + strength) where n is positive and x is known."""
    return F.when((n > 0) & x.isNotNull(), (x + prior * strength) / (n + strength))


def target_score(x: Column, target: Column, scale: Column, width: float = 1.75) -> Column:
    """100 at the target, falling as a bell with the distance in scales."""
    z = (x - target) / scale
    return 100 * F.exp(-0.5 * (z / width) * (z / width))


def interval_score(low: Column, middle: Column, high: Column, other_low: Column, other_high: Column, per_unit: float = 2.5) -> Column:
    """100 if ranges overlap and the middle lies inside the other one, 80 if they only overlap, else 100 less what the gap costs. The other range's ends may come in either order."""
    first, last = F.least(other_low, other_high), F.greatest(other_low, other_high)
    gap = F.greatest(first - high, low - last)
    score = F.when(gap > 0, F.greatest(F.lit(0.0), 100 - per_unit * gap)).when((middle >= first) & (middle <= last), 100.0).otherwise(80.0)
    return F.when(other_low.isNotNull() & other_high.isNotNull() & low.isNotNull() & middle.isNotNull() & high.isNotNull(), score)


def weighted_mean(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """Of (value, weight) columns in a row; null values and weights of zero or less are left out."""
    use = [v.isNotNull() & (w > 0) for v, w in pairs]
    top = sum((F.when(u, v * w).otherwise(0.0) for u, (v, w) in zip(use, pairs, strict=True)), F.lit(0.0))
    return F.try_divide(top, sum((F.when(u, w).otherwise(0.0) for u, (_, w) in zip(use, pairs, strict=True)), F.lit(0.0)))
