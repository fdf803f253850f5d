"""The registered queries of this subpackage: one per numbered operator."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectra.llm import alignment, bpe, chat, language_model, mixing, near_join, oracles, packing, quality_model, quality_rules, token_counts, toxicity, vector_codes, vector_dedup

Query = Callable[[SparkSession, str], DataFrame]
_ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package from where the driver has it.

    On a cluster the package is installed or sent with --py-files, and this changes nothing there.
    """
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, known)])


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, root: str) -> DataFrame:
    return near_join.near_join(_table(spark, root, "documents"))


def op2_lm_scoring(spark: SparkSession, root: str) -> DataFrame:
    return language_model.score_texts(_table(spark, root, "documents"))


def op3_toxicity(spark: SparkSession, root: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, root, "documents"), _table(spark, root, "labels"))


def op4_best_fit_packing(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack_documents(_table(spark, root, "documents"), keep_ids=False)


def op5_token_counts(spark: SparkSession, root: str) -> DataFrame:
    counted = token_counts.count_tokens(_table(spark, root, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op6_quality_classifier(spark: SparkSession, root: str) -> DataFrame:
    return quality_model.quality(_table(spark, root, "documents"), _table(spark, root, "labels"))


def op7_embedding_near_dedup(spark: SparkSession, root: str) -> DataFrame:
    return vector_dedup.near_vectors(_table(spark, root, "embeddings"))


def shown_spans(rotated: DataFrame) -> DataFrame:
    """Perspectives with their spans as text."""
    return rotated.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ","))


def op8_chat_formatting(spark: SparkSession, root: str) -> DataFrame:
    return shown_spans(chat.perspectives(_table(spark, root, "conversations")))


def op9_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, root, "documents"))


def op10_mixing(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(_table(spark, root, "documents"), keep=["doc_id"]).drop("copies")


def op11_vector_codes(spark: SparkSession, root: str) -> DataFrame:
    made = vector_codes.compress(_table(spark, root, "embeddings"))
    digest = hashlib.sha256(vector_codes.books_text(made.books).encode()).hexdigest()
    code = F.concat_ws("", F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    rows = vector_codes.label_errors(made.rows)
    return rows.select(F.col("key").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_token_alignment(spark: SparkSession, root: str) -> DataFrame:
    aligned = alignment.align(_table(spark, root, "documents"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return alignment.weigh_links(aligned.withColumn("groups_sha256", digest).drop("groups"))


def op13_bpe_round_trip(spark: SparkSession, root: str) -> DataFrame:
    coded = bpe.encode_texts(_table(spark, root, "documents"), packed=True, decode=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Query]:
    found = [op1_ngram_jaccard_join, op2_lm_scoring, op3_toxicity, op4_best_fit_packing, op5_token_counts, op6_quality_classifier, op7_embedding_near_dedup, op8_chat_formatting, op9_quality_rules, op10_mixing, op11_vector_codes, op12_token_alignment, op13_bpe_round_trip]
    return {q.__name__: q for q in found}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
