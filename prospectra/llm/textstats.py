"""Word counts of whole texts as DataFrame expressions. A word is `[^\\x20\\x09-\\x0D]+`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
_GAP = r"[\x20\x09-\x0D]+"


def word_array(text: Column) -> Column:
    """The words in order; null or empty texts have none."""
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), _GAP), lambda w: w != "")


def word_count(text: Column) -> Column:
    """The number of words as a long."""
    return F.size(word_array(text)).cast("long")
