"""Bounded samples of labelled rows, and features of whole texts, for the trained classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectra.llm import words


def fold(key: Column, n: int = 5) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def sample(labels: DataFrame, key: str, label: str, most: int) -> DataFrame:
    """Up to `most` rows of each class, as __id and __y, and each class's __share of all labelled rows.

    Rows are taken in the order of a hash of their key; a key with several labels has the larger.
    The result has at most 2 * `most` rows.
    """
    y = F.when(F.col(label) > 0, 1).otherwise(0)
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__id")).agg(F.max(y).alias("__y"))
    counts = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}
    total = max(1, sum(counts.values()))
    taken = [known.where(F.col("__y") == c).orderBy(F.xxhash64("__id"), "__id").limit(most).withColumn("__share", F.lit(counts.get(c, 0) / total)) for c in (0, 1)]
    return taken[0].unionByName(taken[1])


def term_hashes(texts: pa.Array, prefixes: tuple[int, ...] = (4, 5, 6)) -> tuple[np.ndarray, np.ndarray, int]:
    """(term hash, document) of every whole lower-cased word and of its first bytes, and the number of documents."""
    w = words.split(texts)
    size = w.ends - w.starts
    doc = w.document()
    terms, docs = [w.hashes()], [doc]
    padded = np.concatenate([w.data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    head = eights[w.starts] if len(w.starts) else np.zeros(0, np.uint64)
    for n in prefixes:
        long = size >= n
        terms.append(words.mix((head[long] & np.uint64((1 << (8 * n)) - 1)) + np.uint64(n << 56)))
        docs.append(doc[long])
    return np.concatenate(terms), np.concatenate(docs), len(texts)


#: What text_shape() measures of a text.
SHAPE = ["words", "word_size", "upper", "digit", "symbol", "shout", "lone", "again", "again_2", "line", "beyond_ascii", "stop"]
_CLASS = {
    "upper": bytes(range(65, 91)),
    "digit": b"0123456789",
    "symbol": b"#*$%&|<>@^~=+{}[]\\_",
    "shout": b"!?",
    "line": b"\n",
    "beyond_ascii": bytes(range(0xC2, 0xF5)),
    "stop": b".,;:",
}


def text_shape(texts: pa.Array) -> np.ndarray:
    """A row per text, a column per name in SHAPE: counts as shares of bytes or words, sizes as logarithms."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    w = words.split(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    buffer = texts.buffers()[2]
    raw = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and n else np.zeros(0, np.uint8)
    at = offsets - offsets[0]
    size = np.maximum(np.diff(at), 1)
    count, doc, h = np.diff(w.first), w.document(), w.hashes()
    per_word = np.maximum(count, 1)
    length = w.ends - w.starts

    def share(bytes_of: bytes) -> np.ndarray:
        table = np.zeros(256, bool)
        table[list(bytes_of)] = True
        places = np.flatnonzero(table[raw])
        return np.diff(np.searchsorted(places, at)) / size

    def equal(lag: int) -> np.ndarray:
        same = (h[lag:] == h[:-lag]) & (doc[lag:] == doc[:-lag]) if len(h) > lag else np.zeros(0, bool)
        return np.bincount(doc[lag:][same], minlength=n) / per_word if len(same) else np.zeros(n)

    columns = {
        "words": np.log1p(count),
        "word_size": np.log1p(np.bincount(doc, length, n) / per_word),
        "lone": np.bincount(doc, length == 1, n) / per_word,
        "again": equal(1),
        "again_2": equal(2),
    } | {k: share(v) for k, v in _CLASS.items()}
    return np.column_stack([columns[k] for k in SHAPE]) if n else np.zeros((0, len(SHAPE)))
