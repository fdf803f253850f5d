"""Alignment of two tokenizers' tokens over the same bytes, and how often ids are linked in a corpus.

The ends of both sides' tokens cut a text's bytes into elementary intervals, each inside one token
of either side: one overlap. Where both sides end a token, a group closes; each token of a group is
linked with each of the other side. Texts are cut before single spaces, where neither side joins,
and a task aligns each distinct part once; its groups are sums over parts.

A document's links are kept as distinct id pairs with their times. Pairs are counted by documents
over the whole corpus, and counts go back to the documents by a broadcast of checked size, or beyond
it by a shuffled join in which frequent pairs are split.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectra.llm import scratch, vocabularies, words

#: Parts that a task remembers, and the longest, in characters, that it does.
REMEMBERED, LONGEST = 300_000, 64
#: Parts that are encoded as one text.
JOINED = 64
#: Distinct id pairs whose counts are broadcast (16 bytes each); more are joined in so many shares of each pair.
BROADCAST_PAIRS, SHARES = 4_000_000, 16
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def expanded(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all members of runs, run after run."""
    total = np.cumsum(sizes)
    return np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - sizes - starts, sizes)


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per elementary interval of two sides that cover the same bytes: the token of either side, and the group."""
    ends = np.concatenate([ends_a, ends_b])
    ends.sort(kind="stable")  # two runs in order
    ends = ends[np.concatenate([[True], ends[1:] != ends[:-1]])] if len(ends) else ends
    a, b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    closes = (ends_a[a] == ends) & (ends_b[b] == ends)
    return a, b, np.cumsum(closes) - closes


def products(group_a: np.ndarray, ids_a: np.ndarray, group_b: np.ndarray, ids_b: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, times) of the links of each group, by distinct ids; both sides have the same groups, in ascending order."""
    key_a, times_a = np.unique(group_a << 32 | ids_a, return_counts=True)
    key_b, times_b = np.unique(group_b << 32 | ids_b, return_counts=True)
    of_a, of_b = key_a >> 32, key_b >> 32
    first = np.searchsorted(of_b, of_a)
    sizes = np.searchsorted(of_b, of_a, side="right") - first
    left, right = np.repeat(np.arange(len(of_a)), sizes), expanded(first, sizes)
    low = (1 << 32) - 1
    return of_a[left], (key_a[left] & low) << shift | (key_b[right] & low), times_a[left] * times_b[right]


def _taken(table: pa.Array, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of chosen entries one after another, and where each begins and the last ends."""
    taken = pc.take(table, pa.array(at))
    offsets = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
    data = np.frombuffer(taken.buffers()[2], np.uint8) if taken.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Side:
    """One tokenizer's ids: the bytes each stands for, and its decimal name before a token of the same group and before its end."""

    def __init__(self, spelled: list[bytes], end: str):
        self.bytes, self.sizes, self.n = pa.array(spelled, pa.large_binary()), np.array([len(x) for x in spelled], np.int64), len(spelled)
        self.names = pa.array([f"{i}{c}".encode() for c in (",", end) for i in range(len(spelled))], pa.large_binary())

    def gives_back(self, ids: np.ndarray, part: np.ndarray, raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each part whether its tokens' bytes are the part's own; `raw` has the parts' bytes one after another."""
        good = np.bincount(part, self.sizes[ids], len(sizes)).astype(np.int64) == sizes
        found, _ = _taken(self.bytes, ids[good[part]])
        wanted = raw[np.repeat(good, sizes)]
        where = np.flatnonzero(found != wanted)
        if len(where):
            good[np.repeat(np.flatnonzero(good), sizes[good])[where]] = False
        return good


class Aligner:
    """Parts of texts to their groups and links.

    Part k, once learnt, has the numbers counts[k] (n_a, n_b, n_groups, n_links), the text groups[k],
    and the distinct pairs and their times from first[k] on, sizes[k] of them; used[k] batches had it.
    """

    def __init__(self, a: str, b: str):
        self.a, self.b = vocabularies.fast_tokenizer(a), vocabularies.piece_model(b)
        self.a.encode_special_tokens = True
        letters = vocabularies.byte_of()
        names = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.side_a = Side([bytes(letters[c] for c in n) if n is not None and all(c in letters for c in n) else (n or "").encode() for n in names], "|")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"the vocabulary {b} has pieces that go on behind a space")
        self.side_b = Side([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)], ";")
        self.shift = max(1, len(pieces) - 1).bit_length()
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.counts, self.groups = np.zeros((0, 4), np.int64), []
        self.first, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used = np.zeros(0, np.int64)

    def shrink(self) -> None:
        """Forgets all parts but those met in several batches, of these the most used, half of REMEMBERED at most."""
        names, at = list(self.known), np.fromiter(self.known.values(), np.int64, len(self.known))
        keep = np.flatnonzero(self.used[at] > 1)
        keep = keep[np.argsort(-self.used[at[keep]], kind="stable")[: REMEMBERED // 2]]
        at = at[keep]
        self.known = {names[i]: k for k, i in enumerate(keep.tolist())}
        self.groups = [self.groups[i] for i in at.tolist()]
        places = expanded(self.first[at], self.sizes[at])
        self.pairs, self.times = self.pairs[places], self.times[places]
        self.counts, self.sizes, self.used = self.counts[at], self.sizes[at], self.used[at]
        self.first = np.cumsum(self.sizes) - self.sizes

    @staticmethod
    def _coded(side: Side, spaced: list[str], raw: np.ndarray, sizes: np.ndarray, edged: np.ndarray, encode: Callable[[list[str]], list[list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, part, good) of parts with their spaces: the ids and whose they are, and for each part whether its bytes are given back.

        Parts that begin and end without white space, those not `edged`, are encoded many at once, as they are in texts,
        and told apart by their bytes. Where these differ, and all others, are encoded one by one.
        """

        def flat(codes: list[list[int]], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            of = np.repeat(owner, np.fromiter(map(len, codes), np.int64, len(codes)))
            return np.fromiter(itertools.chain.from_iterable(codes), np.int64, len(of)), of

        alone = edged.copy()
        inner = np.flatnonzero(~alone)
        ids, part = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(inner):
            firsts = np.arange(0, len(inner), JOINED)
            listed = [spaced[i] for i in inner.tolist()]
            ids, chunk = flat(encode(["".join(listed[k : k + JOINED]) for k in firsts.tolist()]), np.arange(len(firsts)))
            ends, upto = np.cumsum(sizes[inner]), np.cumsum(side.sizes[ids])
            begin = np.searchsorted(chunk, np.arange(len(firsts)))
            before = np.concatenate([[0], upto])[begin]  # tokens' bytes before each chunk
            at = upto + (ends[firsts] - sizes[inner][firsts] - before)[chunk]
            last = np.minimum(firsts + JOINED, len(inner)) - 1
            part = inner[np.clip(np.searchsorted(ends, at), firsts[chunk], last[chunk])]
            wrong = ~side.gives_back(ids, part, raw, sizes)[inner]
            alone[inner] = np.isin(np.arange(len(inner)) // JOINED, np.flatnonzero(wrong) // JOINED)
        again = np.flatnonzero(alone)
        if len(again):
            keep = ~alone[part]
            more, whose = flat(encode([spaced[i] for i in again.tolist()]), again)
            ids, part = np.concatenate([ids[keep], more]), np.concatenate([part[keep], whose])
            order = np.argsort(part, kind="stable")
            ids, part = ids[order], part[order]
            return ids, part, side.gives_back(ids, part, raw, sizes)
        return ids, part, np.ones(len(spaced), bool)

    def learn(self, parts: list[str]) -> None:
        """Aligns parts, each of a space and what follows it; those whose bytes a side does not give back have no groups."""
        spaced = [" " + p for p in parts]
        raw, at = _taken(pa.array(spaced, pa.large_string()), np.arange(len(parts)))
        edged = np.fromiter((not p or p[0].isspace() or p[-1].isspace() for p in parts), bool, len(parts))
        coded_a = self._coded(self.side_a, spaced, raw, np.diff(at), edged, lambda ts: [e.ids for e in self.a.encode_batch_fast(ts, add_special_tokens=False)])
        coded_b = self._coded(self.side_b, spaced, raw, np.diff(at), edged, lambda ts: self.b.encode([t[1:] for t in ts], num_threads=1))
        good = coded_a[2] & coded_b[2]
        self.known.update(zip(parts, itertools.count(len(self.groups)), strict=False))
        counts, texts, sizes = np.zeros((len(parts), 4), np.int64), [b""] * len(parts), np.zeros(len(parts), np.int64)
        if good.any():
            (ids_a, part_a), (ids_b, part_b) = [(ids[good[part]], part[good[part]]) for ids, part, _ in (coded_a, coded_b)]
            # Parts end where both sides end a token, so groups stay inside parts.
            a, b, group = overlaps(np.cumsum(self.side_a.sizes[ids_a]), np.cumsum(self.side_b.sizes[ids_b]))
            group_a, group_b = (group[np.searchsorted(owner, np.arange(len(ids)))] for owner, ids in ((a, ids_a), (b, ids_b)))
            n_a, n_b = np.bincount(group_a), np.bincount(group_b)
            upto_a, upto_b = np.cumsum(n_a), np.cumsum(n_b)
            home = part_a[upto_a - 1]
            for column, values in enumerate((n_a, n_b, np.ones_like(n_a), n_a * n_b)):
                counts[:, column] = np.bincount(home, values, len(parts))
            # A group's names: those of the one side, then those of the other.
            names = np.zeros(len(ids_a) + len(ids_b), np.int64)
            ends_a, ends_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
            ends_a[upto_a - 1] = ends_b[upto_b - 1] = True
            names[np.arange(len(ids_a)) + (upto_b - n_b)[group_a]] = ids_a + self.side_a.n * ends_a
            names[np.arange(len(ids_b)) + upto_a[group_b]] = ids_b + self.side_b.n * ends_b + len(self.side_a.names)
            told, at = _taken(self.names, names)
            cuts = at[np.cumsum(counts[good, 0] + counts[good, 1])].tolist()
            whole, before = told.tobytes(), 0
            for k, cut in zip(np.flatnonzero(good).tolist(), cuts, strict=True):
                texts[k] = whole[before : cut - 1]
                before = cut
            in_group, pair, times = products(group_a, ids_a, group_b, ids_b, self.shift)
            of = home[in_group]
            order = np.lexsort((pair, of))
            of, pair, times = of[order], pair[order], times[order]
            fresh = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (pair[1:] != pair[:-1])]))
            sizes = np.bincount(of[fresh], minlength=len(parts))
            self.first = np.concatenate([self.first, len(self.pairs) + np.cumsum(sizes) - sizes])
            self.pairs, self.times = np.concatenate([self.pairs, pair[fresh]]), np.concatenate([self.times, np.add.reduceat(times, fresh)])
        else:
            self.first = np.concatenate([self.first, np.full(len(parts), len(self.pairs))])
        self.used = np.concatenate([self.used, np.zeros(len(parts), np.int64)])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.counts = np.concatenate([self.counts, counts])
        self.groups += texts

    @functools.cached_property
    def names(self) -> pa.Array:
        return pa.concat_arrays([self.side_a.names, self.side_b.names])

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Per text: (n_a, n_b, n_groups, n_links) and the groups; and the (text, pair, times) of all, by text and pair."""
        split = [_SINGLE_SPACE.split(t) if t else [] for t in texts]
        every = set().union(*split)
        new = [p for p in every if p not in self.known]
        if len(self.groups) + len(new) > REMEMBERED:
            self.shrink()
            new = [p for p in every if p not in self.known]
        if new:
            self.learn(new)
        known = self.known.__getitem__
        places = [list(map(known, ps)) for ps in split]
        sizes = np.array([len(p) for p in places], np.int64)
        flat = np.fromiter(itertools.chain.from_iterable(places), np.int64, int(sizes.sum()))
        self.used[flat] += 1
        text = np.repeat(np.arange(len(texts)), sizes)
        broken = np.zeros(len(texts), bool)
        broken[text[self.counts[flat, 0] == 0]] = True
        counts = np.stack([np.bincount(text, self.counts[flat, c], len(texts)) for c in range(4)], 1).astype(np.int64)
        counts[broken] = 0
        told = [b"" if broken[i] else b";".join(map(self.groups.__getitem__, p)) for i, p in enumerate(places)]
        keep = ~broken[text]
        width = max(1, len(self.groups))
        seen, often = np.unique(text[keep] * width + flat[keep], return_counts=True)
        part, whose = seen % width, seen // width
        lengths = self.sizes[part]
        at = expanded(self.first[part], lengths)
        key = np.repeat(whose, lengths) << 2 * self.bits | self.pairs[at]
        key, inverse = np.unique(key, return_inverse=True)
        total = np.bincount(inverse, self.times[at] * np.repeat(often, lengths), len(key)).astype(np.int64)
        for p in [p for p in new if len(p) > LONGEST]:
            self.groups[self.known.pop(p)] = b""
        return counts, told, key >> 2 * self.bits, key & ((1 << 2 * self.bits) - 1), total

    @functools.cached_property
    def bits(self) -> int:
        """Half of the bits of a pair; what is left names texts, of which a batch has far fewer."""
        return -(-(self.shift + (self.side_a.n - 1).bit_length()) // 2)


@functools.lru_cache(maxsize=1)
def aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


def align(df: DataFrame, key: str = "doc_id", text: str = "text", a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    """One row per row of `df`: the key, n_a, n_b, n_groups, n_links, `groups`, `pairs` and `times`.

    `a` is a byte-level vocabulary, given a space before the text; `b` a sentencepiece model that
    adds that space itself. Strings of special tokens inside texts are plain text. `groups` is
    `a1,a2|b1;a3|b2,b3`, ids in order; `pairs` are the distinct linked id pairs, id_of_a *
    2**bits + id_of_b with as many bits as ids of b need, and `times` how often each is linked.
    Null and empty texts, and those whose bytes either side does not give back, have zeros, no
    groups and no pairs. The key may be null or repeated; other columns of `df` are not read,
    whatever their names. A very long text takes memory in proportion to itself; a stretch over
    which the sides never end a token together, to the product of its distinct ids. An empty table
    gives no rows.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(a, b)
        for batch in words.slices(batches, "__text", words.SLICE // 2):
            counts, groups, owner, pairs, times = known.align(batch.column("__text").to_pylist())
            offsets = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([batch.column("__key"), *[pa.array(c) for c in counts.T.copy()], pa.array(groups, pa.binary()).cast(pa.string()), *lists], ["__key", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    narrow = df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    return narrow.mapInArrow(run, f"__key {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<bigint>, times array<bigint>").withColumnRenamed("__key", key)


def pair_counts(aligned: DataFrame, bits: int) -> DataFrame:
    """(pair, documents, best): how many rows hold each pair, and whether no other pair of its first id is in more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("documents"))
    counts = scratch.stored(counts)
    first = F.shiftright("pair", bits)
    most = counts.groupBy(first.alias("first")).agg(F.max("documents").alias("most"))
    joined = counts.withColumn("__first", first).join(most, F.col("__first") == F.col("first"))
    return joined.select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))


def weigh_links(aligned: DataFrame, b: str = "piece_bpe_32k.model", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """`aligned` without pairs and times, with n_best and count_sum.

    A pair's count is how many rows of `aligned` hold it. n_best is how many of a row's links are of
    pairs that no other pair of the same first id exceeds, equals included; count_sum is the sum of
    the counts of its links. Rows without links have zeros; repeated rows count each. Other columns
    of `aligned` are kept. An empty table gives no rows.
    """
    bits = max(1, vocabularies.piece_model(b).vocab_size() - 1).bit_length()
    stored = scratch.stored(aligned.withColumn("__row", F.monotonically_increasing_id()))
    counts = scratch.stored(pair_counts(stored, bits))
    kept = [c for c in stored.columns if c not in ("pairs", "times", "__row")]
    if counts.count() <= broadcast_pairs:
        table = counts.orderBy("pair").toArrow()
        known = stored.sparkSession.sparkContext.broadcast(tuple(table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "documents", "best")))
        names = [*kept, "pairs", "times"]

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair, documents, best = known.value
            for batch in batches:
                lists = batch.column(names.index("pairs"))
                row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                at = np.searchsorted(pair, lists.flatten().to_numpy())
                times = batch.column(names.index("times")).flatten().to_numpy()
                sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
                np.add.at(sums[0], row, times * best[at])
                np.add.at(sums[1], row, times * documents[at])
                yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in kept], *map(pa.array, sums)], [*kept, "n_best", "count_sum"])

        schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in stored.schema if f.name in kept)
        return stored.select(*names).mapInArrow(add, f"{schema}, n_best bigint, count_sum bigint")
    # A frequent pair is in most rows: each of its shares meets its own copy of the count.
    share = F.pmod(F.xxhash64("__row"), F.lit(SHARES)).cast("int")
    held = stored.select("__row", share.alias("share"), F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "held")
    copies = counts.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    met = held.join(copies, (F.col("held") == F.col("pair")) & (F.col("share") == F.col("copy")))
    sums = met.groupBy(F.col("__row").alias("__r")).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("documents")).alias("count_sum"))
    zero: Column = F.lit(0).cast("long")
    return stored.join(sums, F.col("__row") == F.col("__r"), "left").select(*kept, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"))
