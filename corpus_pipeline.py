"""A training corpus from documents: toxicity, quality rules, near duplicates, mixing, packing.

Each stage takes what the one before has kept, is written as Parquet in the shared folder and read
again for the next. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectra.llm import mixing, near_join, packing, quality_rules, registry, rows, scratch, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not predicted to be toxic, judged row by row. Null and empty texts are scored as texts without known terms; other columns may have any name."""
    registry.importable(spark)
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, judged row by row. Null and empty texts go, as texts of under 50 words do; null languages and sources are groups of their own; other columns may have any name."""
    placed = rows.numbered(docs)
    kept = quality_rules.quality_rules(placed, key="__row").where("kept").select("__row", F.lit(1).alias("__times"))
    return rows.taken(placed, kept)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones: that with the smallest id, or without an id if none has one.

    Of equal rows one stays. Null, empty and blank texts link with nothing and are kept. Other columns may have any name.
    """
    registry.importable(spark)
    placed = rows.numbered(docs)
    groups = near_join.near_join(placed, key="__row", n=5, percent=80).select("__row", "component_id")
    named = placed.select("__row", "doc_id").join(groups, "__row")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("first"))
    return rows.taken(placed, first.select("first.__row", F.lit(1).alias("__times")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it does. Null and empty texts have no size and are never taken; null sources are one source; other columns may have any name."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences, as op4 returns them: each row of `docs` gives its own. A null or empty text is one piece of one token; other columns are not read."""
    registry.importable(spark)
    return packing.pack_documents(docs, keep_ids=False)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality rules", apply_quality_rules),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]

#: Trained and iterative stages have no SQL; tests/llm/test_pipeline.py holds each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the `documents` of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
