"""Phrases found in texts: leftmost, longest, without overlaps, by one automaton over all phrases."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def pattern(phrases: list[str]) -> str:
    """A pattern that takes the longest of the phrases at a place: a trie of their characters, deeper branches first."""
    root: dict = {}
    for phrase in phrases:
        node = root
        for c in phrase:
            node = node.setdefault(c, {})
        node[""] = {}

    def walk(node: dict) -> str:
        tails = [re.escape(c) + walk(below) for c, below in sorted(node.items()) if c]
        if not tails:
            return ""
        inner = tails[0] if len(tails) == 1 and "" not in node else "(?:" + "|".join(tails) + ")"
        return inner + "?" if "" in node else inner

    return r"(?<![\p{L}\p{N}_])" + walk(root) + r"(?![\p{L}\p{N}_])"


def folded(text: Column) -> Column:
    """Lower case, hyphens as spaces, white space as single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "-", " "), r"\s+", " "))


def found_phrases(text: Column, phrases: Mapping[str, str]) -> Column:
    """The phrases of a text in order, as they stand in the folded text; of those that overlap the leftmost, of those that begin together the longest. Null for null."""
    if not phrases or "" in phrases:
        raise ValueError("phrases must be given and not be empty")
    return F.regexp_extract_all(folded(text), F.lit(pattern(list(phrases))), F.lit(0))


def phrase_values(text: Column, phrases: Mapping[str, str]) -> Column:
    """What the phrases of a text stand for, each value once, in the order in which they are found first."""
    table = F.create_map(*[F.lit(x) for pair in sorted(phrases.items()) for x in pair])
    return F.array_distinct(F.transform(found_phrases(text, phrases), lambda p: F.element_at(table, p)))
