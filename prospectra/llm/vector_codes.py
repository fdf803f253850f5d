"""Vectors as short codes: one codebook per part of the vector, fitted by Lloyd rounds with heaps.

Components become integers, so sums and distances are exact. Rows live in blocks, each a row of a
stored table: its parts, the entry of each, the sums per entry, and a heap per part and entry. A
part's key in the heap of its entry is the distance to the next best entry minus that to its own,
plus the drift that the heap had when it was pushed. After each round entries move, and a heap's
drift grows by its own entry's step and the longest step of the others. As long as a key exceeds
the drift, no other entry can be nearer; the parts that it no longer exceeds are popped off the top
of the heap, measured exactly against all entries, and pushed again. The driver sees sums per entry
only, which Spark adds up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectra.llm import scratch

#: Vectors and bytes of a block, at most; what a key must exceed the drift by, far above the rounding of roots.
BLOCK_ROWS, BLOCK_BYTES, MARGIN = 4096, 8_000_000, 1e-3
#: Distinct labels whose sums are broadcast; more are joined in so many shares of each label.
BROADCAST_LABELS, SHARES = 1_000_000, 16


@dataclass
class Compressed:
    """`rows`: key, label, code (one entry per part) and error, stored. `books`: part x entry x component."""

    rows: DataFrame
    books: np.ndarray


def below(heap: np.ndarray, limit: float) -> np.ndarray:
    """The places of all keys of a heap up to a limit: the top of the tree, level by level, looking at nothing beneath a larger key."""
    found, level = [np.zeros(0, np.int64)], np.zeros(min(1, len(heap)), np.int64)
    while len(level):
        hit = level[heap[level] <= limit]
        found.append(hit)
        level = np.concatenate([2 * hit + 1, 2 * hit + 2])
        level = level[level < len(heap)]
    return np.concatenate(found)


def measured(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For parts: the nearest entry (the first of equals), its squared distance, and how much farther the next one is."""
    squares = np.stack([((x - entry) ** 2).sum(1) for entry in book], 1)
    entry = squares.argmin(1)
    rows = np.arange(len(x))
    best = squares[rows, entry]
    if len(book) == 1:
        return entry, best, np.full(len(x), np.inf)
    squares[rows, entry] = np.iinfo(np.int64).max
    return entry, best, np.sqrt(squares.min(1).astype(float)) - np.sqrt(best.astype(float))


class Block:
    """The parts of some vectors and what is known of them."""

    def __init__(self, points: np.ndarray, entries: int):
        n, parts, width = points.shape
        self.points, self.entry = points, np.full((n, parts), -1, np.int64)
        self.keys = [[np.zeros(0)] * entries for _ in range(parts)]
        self.rows = [[np.zeros(0, np.int64)] * entries for _ in range(parts)]
        self.sums = np.zeros((parts, entries, width + 1), np.int64)

    def push(self, part: int, rows: np.ndarray, book: np.ndarray, drift: np.ndarray) -> None:
        """Measures parts exactly, moves them to their entries' sums, and puts them on these entries' heaps."""
        x = self.points[rows, part].astype(np.int64)
        entry, _, slack = measured(x, book)
        before = self.entry[rows, part]
        moved = before != entry
        full = np.column_stack([x, np.ones(len(x), np.int64)])[moved]
        np.add.at(self.sums[part], entry[moved], full)
        known = before[moved] >= 0
        np.subtract.at(self.sums[part], before[moved][known], full[known])
        self.entry[rows, part] = entry
        key = slack + drift[entry]
        order = np.argsort(entry, kind="stable")
        cuts = np.searchsorted(entry[order], np.arange(len(book) + 1))
        for e in range(len(book)):
            new = order[cuts[e] : cuts[e + 1]]
            if len(new):
                keys, owners = np.concatenate([self.keys[part][e], key[new]]), np.concatenate([self.rows[part][e], rows[new]])
                laid = np.argsort(keys, kind="stable")  # an ascending row is a heap
                self.keys[part][e], self.rows[part][e] = keys[laid], owners[laid]

    def pop(self, part: int, drift: np.ndarray) -> np.ndarray:
        """Takes the parts whose bounds the drift has violated off their heaps."""
        out = []
        for e, heap in enumerate(self.keys[part]):
            gone = below(heap, drift[e] + MARGIN)
            if len(gone):
                out.append(self.rows[part][e][gone])
                keys, rows = np.delete(heap, gone), np.delete(self.rows[part][e], gone)
                laid = np.argsort(keys, kind="stable")
                self.keys[part][e], self.rows[part][e] = keys[laid], rows[laid]
        return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)

    def advance(self, books: np.ndarray, drift: np.ndarray) -> int:
        """One assignment to moved entries; returns how many parts were measured."""
        looked = 0
        for part in range(books.shape[0]):
            rows = np.arange(len(self.points)) if len(self.entry) and self.entry[0, part] < 0 else self.pop(part, drift[part])
            if len(rows):
                self.push(part, rows, books[part], drift[part])
            looked += len(rows)
        return looked

    def errors(self, books: np.ndarray) -> np.ndarray:
        """Squared distances of all parts to their entries, summed per vector."""
        total = np.zeros(len(self.points), np.int64)
        for part in range(books.shape[0]):
            total += ((self.points[:, part].astype(np.int64) - books[part][self.entry[:, part]]) ** 2).sum(1)
        return total

    def packed(self) -> list[bytes]:
        sizes = np.array([[len(k) for k in ks] for ks in self.keys], "<i4")
        flat = lambda lists, kind: np.concatenate([x for xs in lists for x in xs]).astype(kind).tobytes()
        return [self.points.astype("<i4").tobytes(), self.entry.astype(np.uint16).tobytes(), sizes.tobytes(), flat(self.keys, "<f8"), flat(self.rows, "<i4")]

    @classmethod
    def unpacked(cls, packed: list[bytes], sums: np.ndarray, parts: int, entries: int, width: int) -> Block:
        points, entry, sizes, keys, rows = packed
        block = cls(np.frombuffer(points, "<i4").reshape(-1, parts, width), entries)
        block.entry = np.frombuffer(entry, np.uint16).reshape(-1, parts).astype(np.int64)
        cuts = np.cumsum(np.frombuffer(sizes, "<i4"))[:-1]
        all_keys, all_rows = np.split(np.frombuffer(keys, "<f8"), cuts), np.split(np.frombuffer(rows, "<i4").astype(np.int64), cuts)
        block.keys = [all_keys[p * entries : (p + 1) * entries] for p in range(parts)]
        block.rows = [all_rows[p * entries : (p + 1) * entries] for p in range(parts)]
        block.sums = sums.reshape(parts, entries, width + 1).copy()
        return block


_STATE = "points binary, entry binary, sizes binary, heaps binary, owners binary, sums array<bigint>, looked bigint"
_PACKED = ["points", "entry", "sizes", "heaps", "owners"]


def integers(vectors: list, bound: int, length: int, scale: int) -> np.ndarray:
    """Rows of floor(scale * x), shorter vectors filled up with zeros, components beyond the bound at the bound."""
    out = np.zeros((len(vectors), length), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = np.clip(np.floor(scale * np.asarray(v, float)), -bound, bound)
    return out


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Compressed:
    """Codes of the vectors of `df` by codebooks of `entries` entries for each of `parts` equal parts.

    Rows whose vector is null or holds null or non-finite components are dropped. A component x is
    floor(scale * x); the codebooks start as the vectors of the smallest keys (null keys last, equal
    keys by their vectors), fewer if there are fewer rows. A round assigns each part to its nearest
    entry, ties to the lower one, and replaces each entry by the floor of its parts' mean; entries
    without parts stay. Parts are assigned once more at the end. Vectors of different lengths are
    filled up with zeros to the longest, and that to a multiple of `parts`, itself at least; components saturate where
    squared distances would leave 63 bits (beyond 2**28 for parts of 8). Keys may be null or
    repeated, labels null; other columns are not read. An empty table gives no rows and no entries.
    """
    spark = df.sparkSession
    kinds = [df.schema[c].dataType.simpleString() for c in (key, label)]
    v = F.col("v")
    rows = df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(v.isNotNull() & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    longest = rows.agg(F.max(F.size("v"))).collect()[0][0] or 0
    width = max(1, math.ceil(longest / parts))
    length, bound = width * parts, math.isqrt(2**62 // max(width, 1)) // 2
    first = integers([r.v for r in rows.orderBy(F.asc_nulls_last("key"), "v").limit(entries).select("v").collect()], bound, length, scale)
    coded = f"key {kinds[0]}, label {kinds[1]}, code array<int>, error bigint"
    if not len(first):
        return Compressed(spark.createDataFrame([], coded), np.zeros((parts, 0, width), np.int64))
    books = first.reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    entries = len(first)
    drift = np.zeros((parts, entries))
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(1, 4 * length)))

    def state(block: Block, looked: int, keys: pa.Array, labels: pa.Array) -> pa.RecordBatch:
        whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        columns = [whole(keys), whole(labels), *[pa.array([p], pa.binary()) for p in block.packed()], pa.array([block.sums.ravel()], pa.list_(pa.int64())), pa.array([looked])]
        return pa.RecordBatch.from_arrays(columns, ["keys", "labels", *_PACKED, "sums", "looked"])

    def begin(books: np.ndarray, drift: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, most):
                    piece = batch.slice(at, most)
                    lists = piece.column("v")
                    sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
                    if (sizes == length).all():
                        points = np.clip(np.floor(scale * flat), -bound, bound).astype(np.int64).reshape(-1, length)
                    else:
                        points = integers(np.split(flat, np.cumsum(sizes)[:-1]), bound, length, scale)
                    block = Block(points.reshape(-1, parts, width), entries)
                    yield state(block, block.advance(books, drift), pa.concat_arrays([piece.column("key")]), pa.concat_arrays([piece.column("label")]))

        return run

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, dict]]:
        for batch in batches:
            for at in range(batch.num_rows):
                held = {c: batch.column(c)[at] for c in batch.schema.names}
                sums = held["sums"].values.to_numpy()
                yield Block.unpacked([held[c].as_py() for c in _PACKED], sums, parts, entries, width), held

    def go_on(books: np.ndarray, drift: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, held in blocks(batches):
                yield state(block, block.advance(books, drift), held["keys"].values, held["labels"].values)

        return run

    def end(books: np.ndarray, drift: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, held in blocks(batches):
                block.advance(books, drift)
                n = len(block.points)
                code = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * parts, pa.int32()), pa.array(block.entry.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([held["keys"].values, held["labels"].values, code, pa.array(block.errors(books))], ["key", "label", "code", "error"])

        return run

    schema = f"keys array<{kinds[0]}>, labels array<{kinds[1]}>, {_STATE}"
    current = scratch.stored(rows.mapInArrow(begin(books, drift), schema))
    for done in range(rounds):
        # One sum per number of the codebooks; counts of any corpus fit a decimal.
        summed = current.select(F.posexplode("sums")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("total")).collect()
        totals = np.zeros(parts * entries * (width + 1), object)
        for r in summed:
            totals[r["pos"]] = int(r["total"])
        totals = totals.reshape(parts, entries, width + 1)
        new = books.copy()
        used = totals[:, :, -1] > 0
        new[used] = (totals[used][:, :-1] // totals[used][:, -1:]).astype(np.int64)
        step = np.sqrt(((new - books).astype(float) ** 2).sum(2))
        others = np.array([[max(np.delete(s, e), default=0.0) for e in range(entries)] for s in step])
        books, drift = new, drift + step + others
        before = current
        if done < rounds - 1:
            current = scratch.stored(current.mapInArrow(go_on(books, drift), schema))
        else:
            current = scratch.stored(current.mapInArrow(end(books, drift), coded))
        scratch.drop(before)
    if rounds == 0:
        current = scratch.stored(current.mapInArrow(end(books, drift), coded))
    return Compressed(current, books)


def label_errors(rows: DataFrame, broadcast_labels: int = BROADCAST_LABELS) -> DataFrame:
    """`rows` with label_error, the sum of `error` over the rows of the same label; nulls are one label."""
    sums = scratch.stored(rows.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error")))
    same = F.col("label").eqNullSafe(F.col("__label"))
    if sums.count() <= broadcast_labels:
        return rows.join(F.broadcast(sums), same).drop("__label")
    shared = rows.withColumn("__share", F.pmod(F.xxhash64("key", "code"), F.lit(SHARES)).cast("int"))
    copies = sums.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return shared.join(copies, same & (F.col("__share") == F.col("__copy"))).drop("__label", "__share", "__copy")


def books_text(books: np.ndarray) -> str:
    """All entries' components in decimal by part, entry and position, joined by commas."""
    return ",".join(map(str, books.ravel().tolist()))
