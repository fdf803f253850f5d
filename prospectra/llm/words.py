"""Whole-array word splitting and hashing of Arrow text columns, used inside Spark tasks.

A word is `[^\\x20\\x09-\\x0D]+`; A-Z are lower-cased, other letters are left as they are.
Everything works on slices of whole texts of about `SLICE` bytes, so memory follows the slice
and the longest text, never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 2_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """The words of a slice of texts: word i is data[starts[i]:ends[i]]; text d has words first[d] to first[d + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, from eight bytes at a time."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eights = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
        size = self.ends - self.starts
        h = size.astype(np.uint64) * _M3
        todo, at = np.arange(len(size)), 0
        while len(todo):
            left = size[todo] - at
            chunk = eights[self.starts[todo] + at] & _MASKS[np.minimum(left, 8)]
            h[todo] = mix(h[todo] ^ chunk) + _M3
            todo, at = todo[left > 8], at + 8
        return mix(h)

    def document(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split(texts: pa.Array) -> Words:
    """Null texts have no words."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(texts) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = ~_SPACE[data]
    begins = np.ones(len(data) + 1, bool)
    begins[1:-1] = ~inside[:-1]
    begins[offsets] = True  # a text's end is the next one's beginning
    starts = np.flatnonzero(inside & begins[:-1])
    stops = np.ones(len(data), bool)
    if len(data):
        stops[:-1] = ~inside[1:]
        stops[offsets[offsets > 0] - 1] = True
    ends = np.flatnonzero(inside & stops) + 1
    return Words(_LOWER[data], starts, ends, np.searchsorted(starts, offsets))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text; a longer text is alone in its batch."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(size + 16)
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position; the last n - 1 positions are left out."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    h = hashes[: len(hashes) - n + 1]
    for k in range(1, n):
        h = mix(h * _M3 + hashes[k : len(hashes) - n + 1 + k])
    return h
