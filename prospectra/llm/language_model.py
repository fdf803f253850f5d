"""Scoring by a deleted-interpolation language model: bigram, unigram and uniform estimates.

Weights of the three depend on how often the context was seen, one set for each power of two; they
are learned by expectation-maximisation on deleted counts: every training occurrence is predicted
from the counts without it. Counts come from all training texts. Tokens are known by
64-bit hashes, bigrams by a bucket and 48 bits that do not depend on it.

Texts are read twice, for token counts and for bigrams. Bigrams are shuffled in packed blocks, one
for each slice of texts and bucket of bigrams, which hold a slice's bigrams once, with the counts of
their words, and the texts' occurrences as references to them. A bucket adds its bigrams' counts up
and sends the blocks on with them; only sums over cells of a grid, and then the weights, pass the
driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectra.llm import labelled, scratch, words

END, START = np.uint64(0x1D872B41F3A5C967), np.uint64(0x6A09E667F3BCC909)
#: Bytes of a slice of texts; training tokens of a bucket; counts that are broadcast, at most (64 MB of them).
SLICE, BUCKET_TOKENS, BROADCAST_COUNTS = 4_000_000, 2_000_000, 4_000_000
#: Steps of the grid in an octave of a probability; bins of context counts; steps of the maximisation.
GRID, CONTEXTS, EM_STEPS = 8, 48, 60


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, context, ends): hashes of all tokens and of what stands before each; text d has those from ends[d] to ends[d + 1]."""
    w = words.split(texts)
    token = np.insert(w.hashes(), w.first[1:], END)
    ends = w.first + np.arange(len(w.first))
    context = np.concatenate([[START], token[:-1]]) if len(token) else token
    context[ends[:-1]] = START
    return token, context, ends


def _squeezed(values: np.ndarray) -> bytes:
    """Bytes of an array, those of equal significance together, compressed."""
    raw = np.ascontiguousarray(values)
    return pa.Codec("zstd", compression_level=9).compress(np.ascontiguousarray(raw.view(np.uint8).reshape(len(raw), raw.itemsize).T).tobytes(), asbytes=True)


def _restored(data: bytes, kind: str, size: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = pa.decompress(data, decompressed_size=size * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, size).T).view(kind).ravel()


def _alike(pairs: np.ndarray, cv: np.ndarray, cw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of one bigram of each distinct three counts, and for each bigram which of these has its own."""
    order = np.lexsort((cw, cv, pairs))
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.any([x[order][1:] != x[order][:-1] for x in (pairs, cv, cw)], axis=0)
    rank = np.empty(len(order), "<u4")
    rank[order] = np.cumsum(fresh) - 1
    return order[fresh], rank


def _identity(pairs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """What tells bigrams of a bucket apart, and their buckets, from full hashes.

    The two are independent: of t bigrams in a bucket each is taken for another with a chance of
    t / 2**48, one in 140 million where a bucket is full, however many buckets there are.
    """
    home = (words.mix(pairs ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return pairs & np.uint64((1 << 48) - 1), home.astype(np.int64)


def _found(table: tuple[np.ndarray, np.ndarray], asked: np.ndarray) -> np.ndarray:
    """Counts of the asked hashes, 0 where the sorted table lacks one."""
    keys, counts = table
    if not len(keys):
        return np.zeros(len(asked), np.int64)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, counts[at], 0)


def token_counts(rows: DataFrame) -> DataFrame:
    """(token, count) over the training texts of `rows` (__train, __text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "__text", SLICE):
            token, _, _ = tokens(batch.column("__text"))
            kinds, n = np.unique(token, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    return rows.where("__train").select("__text").mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("count"))


def _with_rare_counts(rows: DataFrame, counts: DataFrame, head: DataFrame, known) -> DataFrame:
    """Adds __rare and __counts, the counts of each text's tokens that are not among the broadcast ones, by shuffled joins."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "__text", SLICE):
            token, _, ends = tokens(batch.column("__text"))
            doc = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            new = _found(known.value, token) == 0
            order = np.lexsort((token[new], doc[new]))
            t, d = token[new][order], doc[new][order]
            fresh = np.ones(len(t), bool)
            fresh[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])
            take = pa.array(d[fresh])
            yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take), pa.array(t[fresh].view(np.int64))], ["a", "b", "token"])

    named = rows.withColumn("a", F.xxhash64("__text")).withColumn("b", F.xxhash64(F.lit(1), "__text"))
    asked = named.select("a", "b", "__text").mapInArrow(ask, "a bigint, b bigint, token bigint").distinct()
    tail = counts.join(head.select("token"), "token", "left_anti")
    given = asked.join(tail, "token").groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("token", "count"))).alias("__given"))
    joined = named.join(given, ["a", "b"], "left").drop("a", "b")
    return joined.withColumn("__rare", F.col("__given.token")).withColumn("__counts", F.col("__given.count")).drop("__given")


def _blocks(rows: DataFrame, kind: str, known, total: int, distinct: int, buckets: int, rare: bool) -> DataFrame:
    """Rows of documents, and blocks of bigrams with references to them, each for a bucket."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "__text", SLICE):
            token, context, ends = tokens(batch.column("__text"))
            train = batch.column("__train").to_numpy(zero_copy_only=False)
            table = known.value
            kinds, index = np.unique(np.concatenate([token, context]), return_inverse=True)
            count = _found(table, kinds)
            if rare:
                r, c = batch.column("__rare").flatten().to_numpy().view(np.uint64), batch.column("__counts").flatten().to_numpy()
                keys, at = np.unique(r, return_index=True)
                count = np.where(count > 0, count, _found((keys, c[at]), kinds))
            count = np.where(kinds == START, _found(table, np.array([END]))[0], count)
            cw, cv = count[index[: len(token)]], count[index[len(token) :]]
            base = np.log10((cw + 0.5) / (total + 0.5 * (distinct + 1)))
            n = batch.num_rows
            doc = np.repeat(np.arange(n), np.diff(ends))
            places = batch.column("__row").to_numpy()
            info = [np.diff(ends).astype(np.int64), np.bincount(doc, cw > 0, n).astype(np.int64), np.bincount(doc, base, n)]
            empty = pa.nulls(n, pa.binary())
            spread = (words.mix(places.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(spread), pa.array(np.full(n, places[0] if n else 0)), batch.column("__row"), batch.column("__key"), batch.column("__train"), *[pa.array(x) for x in info], *[empty] * 7, *[pa.array(np.zeros(n, np.int32))] * 2], names
            )
            pairs, at, of = np.unique(words.mix(words.mix(context) + token), return_index=True, return_inverse=True)
            ids, home = _identity(pairs, buckets)
            by = np.lexsort((ids, home))
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            of, types, first = rank[of], ids[by], at[by]
            seen = np.bincount(of, train[doc], len(types)).astype(np.int64)
            edges = np.searchsorted(home[by], np.arange(buckets + 1))
            home = home[by][of]
            order = np.argsort(home, kind="stable")  # by bucket, then by document
            cuts = np.searchsorted(home[order], np.arange(buckets + 1))
            out: list[list] = [[] for _ in range(10)]
            for b in np.flatnonzero(np.diff(cuts)):
                at, lo, hi = order[cuts[b] : cuts[b + 1]], edges[b], edges[b + 1]
                docs, uses = np.unique(doc[at], return_counts=True)
                out[0].append(int(b))
                out[1].append(_squeezed((places[docs] - places[0]).astype("<u8")))
                # By context count and then ascending: both, as steps, take fewer bytes.
                own = np.lexsort((types[lo:hi], cv[first[lo:hi]]))
                place = np.empty(len(own), "<u4")
                place[own] = np.arange(len(own))
                refs = place[of[at] - lo]
                refs = refs[np.lexsort((refs, doc[at]))]
                of_first = first[lo:hi][own]
                steps = np.diff(types[lo:hi][own], prepend=np.uint64(0))
                for k, x in enumerate((steps, seen[lo:hi][own], cv[of_first], cw[of_first], refs, uses.astype("<u4"))):
                    out[2 + k].append(_squeezed(x))
                out[8].append(int(hi - lo))
                out[9].append(len(docs))
            m = len(out[0])
            blank = [pa.nulls(m, pa.int64()), pa.nulls(m, batch.column("__key").type), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int32()), pa.array(np.full(m, places[0] if n else 0)), *blank, *[pa.array(x, pa.binary()) for x in out[1:8]], pa.array(out[8], pa.int32()), pa.array(out[9], pa.int32())], names
            )

    names = ["bucket", "slice", "row", "key", "train", "n_tokens", "n_known", "base", "rows", "types", "seen", "cv", "cw", "refs", "uses", "size", "docs"]
    schema = f"bucket int, slice bigint, row bigint, key {kind}, train boolean, n_tokens bigint, n_known bigint, base double, rows binary, types binary, seen binary, cv binary, cw binary, refs binary, uses binary, size int, docs int"
    return rows.mapInArrow(pack, schema)


def _counted(blocks: DataFrame, total: int) -> DataFrame:
    """The blocks with their bigrams' counts over all training texts, as `pairs`, in place of `types` and `seen`.

    Only the three counts of a bigram matter from here on: bigrams of a block with the same ones become one,
    in ascending order, of which pairs and contexts are kept as steps.

    Each bucket adds a row of its training occurrences for the weights: in `rows`, the bin of the
    context and the grid cell of both estimates from the counts without the occurrence; in `uses`,
    how many occurrences are there.
    """

    def count(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        size = table.column("size").to_numpy()
        packed, seen_in, cvs, cws, refs, uses = (table.column(c).to_pylist() for c in ("types", "seen", "cv", "cw", "refs", "uses"))
        docs, sizes = table.column("docs").to_numpy(), size.copy()
        full = [i for i in range(len(size)) if packed[i] is not None]
        new: list[bytes | None] = [None] * len(size)
        cells, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if full:
            types = np.concatenate([np.cumsum(_restored(packed[i], "<u8", int(size[i])), dtype=np.uint64) for i in full])
            seen = np.concatenate([_restored(seen_in[i], "<i8", int(size[i])) for i in full])
            kinds, of = np.unique(types, return_inverse=True)
            pairs = np.bincount(of, seen, len(kinds)).astype(np.int64)[of]
            cv, cw = (np.concatenate([_restored(x[i], "<i8", int(size[i])) for i in full]) for x in (cvs, cws))
            at = 0
            for i in full:
                own = slice(at, at + int(size[i]))
                some, rank = _alike(pairs[own], cv[own], cw[own])
                new[i], cvs[i] = (_squeezed(np.diff(x[own][some], prepend=0)) for x in (pairs, cv))
                cws[i] = _squeezed(cw[own][some])
                often = _restored(uses[i], "<u4", int(docs[i]))
                of_block = rank[_restored(refs[i], "<u4", int(often.sum()))]
                refs[i] = _squeezed(of_block[np.lexsort((of_block, np.repeat(np.arange(len(often)), often)))])
                sizes[i] = len(some)
                at += int(size[i])
            use = seen > 0
            cells, of = np.unique(_cell(pairs[use], cv[use], cw[use], total), return_inverse=True)
            times = np.bincount(of, seen[use], len(cells)).astype(np.int64)
        for name, values in (("cv", cvs), ("cw", cws), ("refs", refs), ("size", sizes)):
            table = table.set_column(table.schema.get_field_index(name), table.schema.field(name), pa.array(values, table.schema.field(name).type))
        table = table.drop_columns(["types", "seen"]).append_column("pairs", pa.array(new, pa.binary()))
        blank = {f.name: None for f in table.schema} | {"bucket": -1, "rows": _squeezed(cells), "uses": _squeezed(times), "size": len(cells)}
        return pa.concat_tables([table, pa.Table.from_pylist([blank], table.schema)])

    kept = [f for f in blocks.schema.fields if f.name not in ("types", "seen")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", pairs binary"
    return blocks.groupBy("bucket").applyInArrow(lambda t: count(t), schema)


def _bin(cv: np.ndarray) -> np.ndarray:
    """0 for contexts that were not seen, then a bin for each power of two."""
    return np.minimum(np.where(cv > 0, np.log2(np.maximum(cv, 1)).astype(np.int64) + 1, 0), CONTEXTS - 1)


def _grid(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.round(np.log2(np.maximum(p, 1e-300)) * GRID), 1).astype(np.int64)


def _cell(pairs: np.ndarray, cv: np.ndarray, cw: np.ndarray, total: int) -> np.ndarray:
    """Bin of the context and grid cell of the two estimates without the occurrence, in one number."""
    p2, p1 = (pairs - 1) / np.maximum(cv - 1, 1), (cw - 1) / max(total - 1, 1)
    return (_bin(cv) << 40) + ((_grid(p2) + (1 << 15)) << 20) + (_grid(p1) + (1 << 15))


def _deleted(counted: DataFrame) -> DataFrame:
    """Training occurrences by cell, of which there are few whatever the input's size."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_restored(row[k], "<i8", row["size"])) for k in ("rows", "uses")], ["cell", "n"])

    packed = counted.where("bucket = -1").select("size", "rows", "uses")
    return packed.mapInArrow(cells, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


def mixture_weights(cell: np.ndarray, n: np.ndarray, distinct: int, steps: int = EM_STEPS) -> np.ndarray:
    """Weights of the bigram, unigram and uniform estimates for each bin of context counts, by expectation-maximisation."""
    b, g2, g1 = cell >> 40, ((cell >> 20) & 0xFFFFF) - (1 << 15), (cell & 0xFFFFF) - (1 << 15)
    p = np.column_stack([np.where(g2 > 0, 0, np.exp2(g2 / GRID)), np.where(g1 > 0, 0, np.exp2(g1 / GRID)), np.full(len(cell), 1 / (distinct + 1))])
    weights = np.tile([0.4, 0.5, 0.1], (CONTEXTS, 1))
    weights[0] = [0.0, 0.9, 0.1]
    for _ in range(steps):
        part = weights[b] * p
        part = part / part.sum(axis=1, keepdims=True) * n[:, None]
        sums = np.column_stack([np.bincount(b, part[:, k], CONTEXTS) for k in range(3)])
        prior = sums.sum(axis=0) / max(sums.sum(), 1e-9) if sums.sum() > 0 else np.array([0.4, 0.5, 0.1])
        sums = sums + 2 * prior + 0.02  # bins with few occurrences lean on all the others
        sums[0, 0] = 0
        weights = sums / sums.sum(axis=1, keepdims=True)
    return weights


def mixed(weights: np.ndarray, pairs: np.ndarray, cv: np.ndarray, cw: np.ndarray, total: int, distinct: int) -> np.ndarray:
    """The model's probability of tokens, from the counts of the pair, of what stands before and of the token; a token never met is one more kind."""
    lam = weights[_bin(cv)]
    return lam[:, 0] * pairs / np.maximum(cv, 1) + lam[:, 1] * cw / max(total, 1) + lam[:, 2] / (distinct + 1)


def _scored(counted: DataFrame, weights: np.ndarray, total: int, distinct: int) -> DataFrame:
    """(row, score) of every text: blocks give packed parts, which each slice of texts adds up."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sums = [], []
            for row in batch.to_pylist():
                n, size = row["size"], row["docs"]
                pairs, cv = (np.cumsum(_restored(row[k], "<i8", n)) for k in ("pairs", "cv"))
                cw = _restored(row["cw"], "<i8", n)
                uses = _restored(row["uses"], "<u4", size)
                refs = _restored(row["refs"], "<u4", int(uses.sum()))
                rows.append(_restored(row["rows"], "<u8", size).astype(np.int64))
                sums.append(np.bincount(np.repeat(np.arange(size), uses), np.log10(mixed(weights, pairs, cv, cw, total, distinct))[refs], size))
            yield pa.RecordBatch.from_arrays([batch.column("slice"), pa.array(rows, pa.list_(pa.int64())), pa.array(sums, pa.list_(pa.float64()))], ["slice", "rows", "parts"])

    def add(table: pa.Table) -> pa.Table:
        rows = table.column("rows").combine_chunks().flatten().to_numpy()
        kinds, of = np.unique(rows, return_inverse=True)
        return pa.table({"row": kinds + table.column("slice")[0].as_py(), "score": np.bincount(of, table.column("parts").combine_chunks().flatten().to_numpy(), len(kinds))})

    packed = counted.where("pairs is not null").select("slice", "rows", "pairs", "cv", "cw", "refs", "uses", "size", "docs")
    return packed.mapInArrow(parts, "slice bigint, rows array<bigint>, parts array<double>").groupBy("slice").applyInArrow(lambda t: add(t), "row bigint, score double")


def score_texts(df: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 5, held_out: int = 1, broadcast_counts: int = BROADCAST_COUNTS) -> DataFrame:
    """One row per row of `df`: the key, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Learns from the texts whose key's fold is not `held_out`. Tokens are lower-cased words and an
    end after each text; a null or empty text is its end alone. score is the model's log10
    probability of the whole text, base_score that of smoothed single tokens. The
    `broadcast_counts` most frequent tokens' counts go to every task, others are joined. Keys may
    be null (as empty text for the fold) or repeated; other columns are not read. Without training
    texts every token is unknown. An empty table gives no rows.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    source = df.select(F.monotonically_increasing_id().alias("__row"), F.col(key).alias("__key"), (labelled.fold(F.col(key), folds) != held_out).alias("__train"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    counts = scratch.stored(token_counts(source))
    total, distinct = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    rare = distinct > broadcast_counts
    head = scratch.stored(counts.orderBy(F.desc("count"), "token").limit(broadcast_counts)) if rare else counts
    top = head.unionByName(counts.where(F.col("token") == int(END.view(np.int64)))).distinct().toArrow() if rare else head.toArrow()
    keys = top.column("token").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    known = spark.sparkContext.broadcast((keys[order], top.column("count").to_numpy()[order]))
    buckets = max(1, math.ceil(total / BUCKET_TOKENS))
    rows = _with_rare_counts(source, counts, head, known) if rare else source
    counted = scratch.stored(_counted(_blocks(rows, kind, known, total, distinct, buckets, rare), total))
    scratch.drop(counts, head)
    cells = _deleted(counted).toArrow()
    order = np.argsort(cells.column("cell").to_numpy())  # sums of floats depend on the order
    cells = cells.take(order)
    weights = mixture_weights(cells.column("cell").to_numpy(), cells.column("n").to_numpy(), distinct)
    texts = counted.where("row is not null").select("row", "key", "train", "n_tokens", "n_known", "base")
    done = texts.join(_scored(counted, weights, total, distinct), "row")
    return done.select(F.col("key").alias(key), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
