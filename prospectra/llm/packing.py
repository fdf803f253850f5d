"""Packing of tokenised documents into sequences of fixed capacity.

Each text is tokenised once, cut into pieces of at most `capacity` tokens, and the pieces are
dealt to blocks of bounded size that pack independently: best fit first, then a swap-based local
search that moves or exchanges pieces between underfull sequences, each step increasing the sum
of squared fills, until sequences empty. A block leaves at most a little more than one sequence
of slack, so the loss against packing everything together is about one sequence per block.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectra.llm import vocabularies, words

CAPACITY = 2048
#: Pieces that pack together; bounds a task's memory.
BLOCK = 65_536


def _encoder(vocabulary: str, ranks: str | None):
    """Text to ids as the `tokenizers` library gives them.

    Texts of Latin-1 characters without special strings take the rank form of the same
    vocabulary, whose ids are the same there (a test sweeps every such character); any other
    text goes to the library itself.
    """
    library = vocabularies.fast_tokenizer(vocabulary)
    special = [t.content for t in library.get_added_tokens_decoder().values()]
    fast = vocabularies.rank_encoding(ranks) if ranks else None

    def ids(text: str) -> np.ndarray:
        if fast is not None and not any(s in text for s in special):
            try:
                text.encode("latin-1")
                return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")
            except UnicodeEncodeError:
                pass
        return np.asarray(library.encode(text, add_special_tokens=False).ids, dtype="<u4")

    return ids


def token_pieces(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    vocabulary: str = "byte_bpe_50k.json",
    ranks: str | None = "byte_bpe_50k.tiktoken",
    end_id: int = 0,
    capacity: int = CAPACITY,
    keep_ids: bool = True,
) -> DataFrame:
    """The pieces of each text: key, piece (from 0), start, length, ids_crc32 and, if kept, ids.

    A document is the ids of its whole text and then `end_id`; a null text is empty. One that is
    longer than `capacity` is cut into pieces of `capacity`, of which the first may be shorter.
    ids_crc32 is over little-endian unsigned 32-bit ids. Rows with the same or a null key stay
    apart: each row gives its own pieces. Other columns are not read.
    """
    kind = df.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary, ranks)
        for batch in words.slices(batches, "__text"):
            owner, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, content in enumerate(batch.column("__text").to_pylist()):
                got = np.append(encode(content or ""), np.uint32(end_id)).astype("<u4")
                at, k = 0, 0
                while at < len(got):
                    upto = at + ((len(got) % capacity or capacity) if k == 0 else capacity)
                    owner.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(upto - at)
                    crc.append(zlib.crc32(got[at:upto].tobytes()))
                    if keep_ids:
                        ids.append(got[at:upto].astype(np.int32))
                    at, k = upto, k + 1
            columns = [batch.column("__key").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []), names)

    names = ["__key", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    schema = f"__key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    narrow = df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    return narrow.mapInArrow(cut, schema).withColumnRenamed("__key", key)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Longest first, each into the fullest sequence that still holds it."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []  # (slack, sequence) of underfull ones, in order
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        at = bisect_left(free, (size, -1))
        if at == len(free):
            bins.append([int(i)])
            slack, b = capacity - size, len(bins) - 1
        else:
            slack, b = free.pop(at)
            bins[b].append(int(i))
            slack -= size
        if slack:
            insort(free, (slack, b))
    return bins


class _Underfull:
    """Underfull sequences, and what could leave them: each piece, and nothing, by the size that may come in for it."""

    def __init__(self, size: list[int], bins: list[list[int]], capacity: int):
        self.size, self.bins, self.capacity = size, bins, capacity
        self.fill = [sum(size[i] for i in b) for b in bins]
        self.offers: list[tuple[int, int, int, int]] = []  # (slack + size of the piece, size of the piece, sequence, piece or -1)
        for b in range(len(bins)):
            self.offers += self._of(b)
        self.offers.sort()

    def _of(self, b: int) -> list[tuple[int, int, int, int]]:
        slack = self.capacity - self.fill[b]
        return [(slack, 0, b, -1), *((slack + self.size[i], self.size[i], b, i) for i in self.bins[b])] if slack and self.bins[b] else []

    def take_out(self, b: int) -> None:
        for offer in self._of(b):
            del self.offers[bisect_left(self.offers, offer)]

    def put_in(self, b: int) -> None:
        for offer in self._of(b):
            insort(self.offers, offer)

    def step(self, donor: int) -> bool:
        """The move or exchange that leaves another sequence fullest, if one gives it more than it gives back."""
        mine, size, best = self.bins[donor], self.size, None
        outs = {size[i]: [i] for i in mine}
        outs |= {size[i] + size[j]: [i, j] for k, i in enumerate(mine) for j in mine[k + 1 :] if size[i] + size[j] not in outs and size[i] + size[j] <= self.capacity}
        for total in sorted(outs, reverse=True):
            for at in range(bisect_left(self.offers, (total,)), len(self.offers)):
                upto, back, target, piece = self.offers[at]
                if best is not None and upto - total >= best[0]:
                    break
                if back < total and target != donor and self.fill[target] >= self.fill[donor]:
                    best = (upto - total, target, outs[total], piece)
                    break
            if best is not None and best[0] == 0:
                break
        if best is None:
            return False
        _, target, out, piece = best
        back = [piece] if piece >= 0 else []
        moved = sum(size[i] for i in out) - sum(size[i] for i in back)
        for b, leave, come, change in ((donor, out, back, -moved), (target, back, out, moved)):
            self.take_out(b)
            self.bins[b] = [i for i in self.bins[b] if i not in leave] + come
            self.fill[b] += change
            self.put_in(b)
        return True


def local_search(lengths: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Empties the least filled sequences by moves and one-for-one or two-for-one exchanges.

    Every step gives a sequence that is no less full more tokens than it gives back, so the sum of
    squared fills rises with each and the search ends: when no sequence has a step left, or when
    no arrangement could have fewer sequences.
    """
    size = [int(x) for x in lengths]
    state = _Underfull(size, [list(b) for b in bins], capacity)
    least = math.ceil(sum(size) / capacity)
    live, moved = sum(1 for b in bins if b), True
    while moved and live > least:
        moved = False
        for donor in sorted(range(len(bins)), key=lambda b: (state.fill[b], b)):
            if not state.bins[donor] or state.fill[donor] == capacity:
                continue
            while state.bins[donor] and state.step(donor):
                moved = True
            live -= not state.bins[donor]
            if live <= least:
                break
    return [b for b in state.bins if b]


def pack_pieces(pieces: DataFrame, rows: int, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Adds sequence_id and offset (the piece's place in its sequence, gapless from 0).

    `rows` is about the number of pieces and only sets how many blocks there are. Pieces of
    `capacity` tokens fill a sequence each. No length may be over `capacity` or under 1.
    """
    names = pieces.columns

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for at in range(0, len(batch), block):
                part = batch.iloc[at : at + block]
                if held and size + len(part) > block:
                    done = _packed(pd.concat(held, ignore_index=True), base, capacity)
                    base = int(done["sequence_id"].max()) + 1
                    yield done
                    held, size = [], 0
                held.append(part)
                size += len(part)
        if size:
            yield _packed(pd.concat(held, ignore_index=True), base, capacity)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    dealt = pieces.repartition(max(1, math.ceil(rows / block)))
    return dealt.mapInPandas(pack, f"{fields}, sequence_id bigint, offset bigint").select(*names, "sequence_id", "offset")


def _packed(pieces: pd.DataFrame, base: int, capacity: int) -> pd.DataFrame:
    lengths = pieces["length"].to_numpy(np.int64)
    bins = local_search(lengths, best_fit(lengths, capacity), capacity)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, members in enumerate(bins):
        place = 0
        for i in members:
            sequence[i], offset[i] = base + b, place
            place += int(lengths[i])
    return pieces.assign(sequence_id=sequence, offset=offset)


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, keep_ids: bool = True, **vocabulary: str) -> DataFrame:
    """Tokenises, cuts and packs whole documents; see `token_pieces` for the columns.

    A null or empty text is one piece of one token. An empty table gives no rows.
    """
    pieces = token_pieces(df, key, text, capacity=capacity, keep_ids=keep_ids, **vocabulary)
    return pack_pieces(pieces, df.count(), capacity)
