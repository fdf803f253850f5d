"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every source's documents are put in a shuffled order that depends on their keys alone, and again
for each repetition. A copy's virtual finish time is the number of its source's words up to and
including it, divided by the source's weight. All copies are then ordered by finish time and the
order is cut where the running number of words would pass the total budget. A source that has
given all its repetitions drops out, and the others share on by weight, so what each source gives
comes within about a document of its water-filling target.

Running sums never put a source into one task: documents fall into buckets by the leading digits
of their shuffle key, small enough for a window each, and only bucket totals are summed along a
source. The cut is found by narrowing histograms of the finish time.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prospectra.llm import rows as places
from prospectra.llm import scratch, textstats

#: Documents of one source that share a bucket, about.
BUCKET_ROWS = 4096
#: Bins of a histogram of finish times.
BINS = 1024


def shuffle_key(key: Column, text: Column, seed: int = 0) -> Column:
    """32 hexadecimal digits that look random; where the key is null they come from the text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.concat(F.lit("~"), F.xxhash64(text.cast("string")).cast("string")))))


def source_targets(sizes: DataFrame, source: str, cycle: tuple[int, ...] = (1, 2, 3), repeats: int = 3) -> DataFrame:
    """One row per source: source_size, weight, rate and target, from columns `source` and __size.

    Sources by code point, null last, weigh as `cycle` says, again and again. They share the total
    of all sizes by weight; a target stops at `repeats` times its source's size and the excess is
    shared anew. The windows here run over one row per source.
    """
    per_source = sizes.groupBy(source).agg(F.sum("__size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    weighed = per_source.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in cycle]), (place % len(cycle) + 1).cast("int")).cast("long"))
    filled = Window.orderBy(F.col("source_size") / F.col("weight"), F.col(source).asc_nulls_last())
    before, after = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rest = F.sum("source_size").over(Window.partitionBy()) - repeats * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rated = weighed.withColumn("__rate", rest / F.sum("weight").over(after))
    below = F.when(F.col("__rate") * F.col("weight") < repeats * F.col("source_size"), F.col("__rate"))
    level = F.first(below, ignorenulls=True).over(filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rated.select(source, "source_size", "weight", F.least((repeats * F.col("source_size")).cast("double"), level * F.col("weight")).alias("target"))


@dataclass
class Plan:
    """What decides over every document: the sources' targets, their buckets' first words and the last finish time."""

    targets: DataFrame
    bases: DataFrame
    digits: int
    last: float
    repeats: int


def _prepared(df: DataFrame, key: str, text: str, source: str, seed: int) -> DataFrame:
    return df.withColumns(
        {
            "__source": F.col(source),
            "__size": textstats.word_count(F.col(text)),
            "__tie": F.xxhash64(F.col(text).cast("string")),
            "__at": shuffle_key(F.col(key), F.col(text), seed),
            "__key": F.col(key),
        }
    )


def _queued(rows: DataFrame, targets: DataFrame, bases: DataFrame, digits: int) -> DataFrame:
    """Adds __upto, the words of the row's source up to and including it, and the source's row of `targets`."""
    dealt = rows.withColumn("__bucket", F.substring("__at", 1, digits))
    inside = Window.partitionBy("__source", "__bucket").orderBy("__at", "__key", "__size", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = dealt.withColumn("__upto", F.sum("__size").over(inside))
    named = bases.select(F.col("__source").alias("__s"), F.col("__bucket").alias("__b"), "__base")
    based = running.join(named, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b"))).drop("__s", "__b")
    return based.withColumn("__upto", F.col("__upto") + F.col("__base")).join(targets.withColumnRenamed("__source", "__s"), F.col("__source").eqNullSafe(F.col("__s"))).drop("__s")


def _finish(turn: Column | int) -> Column:
    return (turn * F.col("source_size") + F.col("__upto")) / F.col("weight")


def last_finish(copies: DataFrame, budget: int) -> float:
    """The largest __finish up to which all __size together are at most `budget`; -1 if there is none.

    Histograms of at most BINS + 1 rows come to the driver, each inside one bin of the one before.
    """
    ends = copies.agg(F.min("__finish"), F.max("__finish")).first()
    if ends[0] is None:
        return -1.0
    last, before, (low, high) = -1.0, 0, ends
    while True:
        width = (high - low) / BINS
        bin_of = F.floor((F.col("__finish") - low) / width) if width > 0 else F.lit(0)
        inside = copies.where((F.col("__finish") >= low) & (F.col("__finish") <= high))
        bins = inside.groupBy(bin_of.alias("bin")).agg(F.sum("__size").alias("n"), F.min("__finish").alias("low"), F.max("__finish").alias("high")).collect()
        for b in sorted(bins, key=lambda b: b["bin"]):
            if before + b["n"] > budget:
                break
            last, before = b["high"], before + b["n"]
        else:
            return last
        if b["low"] == b["high"]:
            return last
        low, high = b["low"], b["high"]


def plan(rows: DataFrame, cycle: Sequence[int] = (1, 2, 3), repeats: int = 3) -> Plan:
    """The plan for prepared rows; reads only their __ columns, several times."""
    targets = scratch.stored(source_targets(rows, "__source", cycle, repeats))
    largest = rows.groupBy("__source").count().agg(F.max("count")).first()[0] or 0
    digits = max(1, math.ceil(math.log(max(1, largest / BUCKET_ROWS), 16)))
    totals = rows.groupBy("__source", F.substring("__at", 1, digits).alias("__bucket")).agg(F.sum("__size").alias("__sum"))
    along = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = scratch.stored(totals.select("__source", "__bucket", F.coalesce(F.sum("__sum").over(along), F.lit(0)).alias("__base")))
    budget = targets.agg(F.sum("source_size")).first()[0] or 0
    queued = scratch.stored(_queued(rows, targets, bases, digits).select("__size", "__upto", "source_size", "weight"))
    turn = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    copies = queued.where("__size > 0").select("*", turn.alias("__turn")).select("__size", _finish(F.col("__turn")).alias("__finish"))
    return Plan(targets, bases, digits, last_finish(copies, budget), repeats)


def _decided(df: DataFrame, key: str, text: str, source: str, keep: Sequence[str], cycle: Sequence[int], repeats: int, seed: int) -> DataFrame:
    """The columns in `keep` as __c0, __c1 and so on, with __size, source_size, target and __copies."""
    prepared = _prepared(df, key, text, source, seed)
    inner = ["__source", "__size", "__tie", "__at", "__key"]
    kept = [f"__c{i}" for i in range(len(keep))]
    wide = prepared.select(*[F.col(c).alias(n) for c, n in zip(keep, kept, strict=True)], *inner)
    if set(keep) <= {key, source}:
        narrow = scratch.stored(prepared.select(*inner))
        wide = narrow.select("*", *[F.col("__key" if c == key else "__source").alias(n) for c, n in zip(keep, kept, strict=True)])
    elif text in keep:
        narrow = scratch.stored(prepared.select(*inner))
    else:
        narrow = wide = scratch.stored(wide)
    how = plan(narrow, cycle, repeats)
    done = _queued(wide, how.targets, how.bases, how.digits)
    copies = sum((F.when((F.col("__size") > 0) & (_finish(t) <= how.last), 1).otherwise(0) for t in range(how.repeats)), F.lit(0))
    return done.select(*kept, "__size", "source_size", "target", copies.alias("__copies"))


def mix(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    keep: Sequence[str] | None = None,
    cycle: Sequence[int] = (1, 2, 3),
    repeats: int = 3,
    seed: int = 0,
) -> DataFrame:
    """One row per row of `df`: its columns (or those named in `keep`), size, source_size, target, taken and copies.

    copies is how often the mix takes the document (0 to `repeats`), taken the words of those.
    Sizes are numbers of words, a null text's 0; documents without words are never taken. Null
    sources are one source, the last. Rows with equal keys are ordered by size and text, and equal
    rows get the same numbers of copies in any order; reruns take the same. A column of `df` called
    like one of the new ones gives way to it. An empty table gives no rows.
    """
    new = ["size", "source_size", "target", "taken", "copies"]
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    done = _decided(df, key, text, source, kept, cycle, repeats, seed)
    names = [F.col(f"__c{i}").alias(c) for i, c in enumerate(kept)]
    size, copies = F.col("__size"), F.col("__copies")
    return done.select(*names, size.alias("size"), "source_size", "target", (copies * size).alias("taken"), copies.alias("copies"))


def mixed_rows(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", cycle: Sequence[int] = (1, 2, 3), repeats: int = 3, seed: int = 0) -> DataFrame:
    """The rows of `df` that `mix` takes, each as often as it does, with all their columns, whatever their names."""
    placed = places.numbered(df)
    done = _decided(placed, key, text, source, ["__row"], cycle, repeats, seed).where("__copies > 0")
    return places.taken(placed, done.select(F.col("__c0").alias("__row"), F.col("__copies").alias("__times")), repeats)
