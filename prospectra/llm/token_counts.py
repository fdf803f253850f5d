"""Token counts of whole texts.

Batches are encoded inside Arrow functions that return lengths only. Texts are split at white
space, which this kind of vocabulary drops and never joins across, so a text's count is the sum
of its words' counts; words that a task has met before are not encoded again. What has to be
encoded goes to the tokenizer in batches of about the same number of bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectra.llm import vocabularies, words

ENCODE_BYTES = 64_000
#: Words that a task remembers, and the longest that it does.
REMEMBERED, LONGEST = 400_000, 64


def byte_batches(texts: Iterable[bytes], limit: int = ENCODE_BYTES) -> Iterator[list[bytes]]:
    """The texts in runs of about `limit` bytes; a longer text is alone."""
    run: list[bytes] = []
    size = 0
    for text in texts:
        if run and size + len(text) > limit:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text) + 16
    if run:
        yield run


def splits_at_space(tokenizer) -> bool:
    """Whether a tokenizer drops white space and never joins across it, on words that common vocabularies treat apart."""
    ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    words_of = ["the", "a", "Don't", "12", "é", "x_y", "."]
    joined = "".join(w + s for w, s in zip(words_of, [" ", "\t", "\n", "  ", "\r\n", " \n", "\x0b"], strict=True))
    return ids(joined) == [i for w in words_of for i in ids(w)] and ids(" \n ") == []


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """One row per row of `df`: the key, n_bytes (UTF-8) and n_tokens of the whole text.

    The vocabulary must drop white space, else tasks fail with a ValueError. No begin, end or
    other special tokens are added; special strings inside texts count as the library's default
    does. Null and empty texts have 0 bytes and 0 tokens; the key may be null or repeated; other
    columns of `df` are not read, whatever their names. An empty table gives no rows.
    """
    kind = df.schema[key].dataType.simpleString()

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = vocabularies.fast_tokenizer(vocabulary)
        if not splits_at_space(tokenizer):
            raise ValueError(f"the counts of words do not add up for the vocabulary {vocabulary}")
        known: dict[bytes, int] = {}

        def encode(new: Iterable[bytes], into: dict[bytes, int]) -> None:
            for run in byte_batches(new):
                for word, code in zip(run, tokenizer.encode_batch_fast([w.decode() for w in run], add_special_tokens=False), strict=True):
                    into[word] = len(code.ids)

        for batch in words.slices(batches, "__text"):
            texts = batch.column("__text").cast(pa.large_binary()).fill_null(b"")
            split = [t.split() for t in texts.to_pylist()]
            new = {w for ws in split for w in ws if w not in known}
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = {w for ws in split for w in ws}
            long = [w for w in new if len(w) > LONGEST]
            encode(new, known)
            counts = [sum(map(known.__getitem__, ws)) for ws in split]
            for w in long:
                del known[w]
            yield pa.RecordBatch.from_arrays(
                [batch.column("__key"), pc.binary_length(texts).cast(pa.int64()), pa.array(counts, pa.int64())], ["__key", "n_bytes", "n_tokens"]
            )

    narrow = df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    return narrow.mapInArrow(lengths, f"__key {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("__key", key)
