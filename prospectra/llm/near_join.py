"""N-gram Jaccard join: documents whose sets of word n-grams overlap enough, by count-vector R-trees.

Shingles are hashed into groups, and a set's group counts are a point. An R-tree over points has
the largest coordinates below each node; the summed minima of these and a query's coordinates bound
the overlap with everything below, so branches that can't reach the similarity are left out, and
what the bound leaves is verified with the sets themselves.

Trees are local to cells, so that no tree holds all documents. The shingles of a set are put in one
order, frequent ones last; a pair that reaches the similarity shares one of the first few of both
(all but the required overlap, and one more), and sets that share one of these meet in its cell: no
linked pair misses every cell. Texts with equal sets are one class from the start.

First every class goes to the most crowded of its cells only, with its set, and the trees link what
links there; a task gives a spanning forest, never all pairs. Then the trees of all cells whose
members are not yet in one component look for pairs across components. Cells of any size are cut
into blocks, and pairs of blocks that hold several components are the tasks, so no cell meets in
one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectra.llm import components, scratch, words

#: Coordinates of a shipped count vector; entries of an R-tree node; members of a block, and shingles of a block of sets.
COORDINATES, FAN, BLOCK, BLOCK_SHINGLES = 256, 16, 1024, 4_000_000
#: Rows up to which a table of keys is broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000
#: Frequent shingles that are told apart, at most; shingles that a task counts at once; the share of texts from which one is frequent.
FREQUENT, WINDOW, SHARE = 1 << 18, 4_000_000, 1 / 4000


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the distinct n-word shingles of each text, ascending, as 64-bit hashes; text d has hashes[ends[d]:ends[d + 1]]."""
    w = words.split(texts)
    h, doc, count = w.hashes(), w.document(), np.diff(w.first)
    grams = words.ngrams(h, n)
    inside = doc[: len(grams)] == doc[n - 1 :] if len(grams) else np.zeros(0, bool)
    value, owner = grams[inside], doc[: len(grams)][inside]
    short = np.flatnonzero((count > 0) & (count < n))
    whole = np.zeros(len(short), np.uint64)
    for k in range(n - 1):
        more = count[short] > k
        whole[more] = words.mix(whole[more] * np.uint64(0x9E3779B97F4A7C15) + h[w.first[:-1][short[more]] + k] + np.uint64(k + 1))
    value, owner = np.concatenate([value, whole]), np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[fresh], owner[fresh]
    return value, np.searchsorted(owner, np.arange(len(count) + 1))


def frequent_shingles(df: DataFrame, text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ascending, and counts) of shingles that many texts hold, FREQUENT at most.

    They only order shingles: any list gives the same links, a good one keeps cells small.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        docs = size = 0

        def most() -> pa.RecordBatch:
            kinds, times = np.unique(np.concatenate(held), return_counts=True)
            keep = times >= max(3, docs * SHARE)
            return pa.RecordBatch.from_arrays([pa.array(kinds[keep].view(np.int64)), pa.array(times[keep].astype(np.int64))], ["h", "c"])

        for batch in words.slices(batches, "__text"):
            hashes, _ = shingle_sets(batch.column("__text"), n)
            held.append(hashes)
            docs, size = docs + batch.num_rows, size + len(hashes)
            if size > WINDOW:
                yield most()
                held, docs, size = [], 0, 0
        if held:
            yield most()

    seen = df.select(F.col(text).cast("string").alias("__text")).mapInArrow(count, "h bigint, c bigint")
    top = seen.groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h").limit(FREQUENT).toArrow()
    hashes = top.column("h").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], top.column("c").to_numpy()[order]


def prefixes(hashes: np.ndarray, ends: np.ndarray, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(cells, ends): the shingles of each set of which a set that reaches the similarity must share one among its own."""
    size = np.diff(ends)
    owner = np.repeat(np.arange(len(size)), size)
    known, counts = frequent
    level = np.zeros(len(hashes), np.int64)
    if len(known) and len(hashes):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        level = np.where(known[at] == hashes, counts[at], 0)
    order = np.lexsort((hashes, level, owner))
    take = size - -(-size * percent // 100) + 1
    take[size == 0] = 0
    first = np.arange(len(hashes)) - ends[:-1][owner] < take[owner]
    return hashes[order][first], np.concatenate([[0], np.cumsum(take)])


def count_vectors(hashes: np.ndarray, ends: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Counts of each set's shingles in `coordinates` groups."""
    n = len(ends) - 1
    owner = np.repeat(np.arange(n), np.diff(ends))
    at = (words.mix(hashes) & np.uint64(coordinates - 1)).astype(np.int64)
    return np.bincount(owner * coordinates + at, minlength=n * coordinates).reshape(n, coordinates).astype("<i4")


def _sketches(df: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    names = ["key", "t", "n", "h1", "h2", "cells"]
    frequent = df.sparkSession.sparkContext.broadcast(frequent_shingles(df, text, n))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "__text"):
            hashes, ends = shingle_sets(batch.column("__text"), n)
            size = np.diff(ends)
            sums = [np.zeros(len(size), np.uint64) for _ in range(2)]
            full = np.flatnonzero(size)
            if len(full):
                sums[0][full] = np.add.reduceat(words.mix(hashes), ends[:-1][full])
                sums[1][full] = np.add.reduceat(words.mix(words.mix(hashes) ^ np.uint64(0xA5A5A5A5A5A5A5A5)), ends[:-1][full])
            cells, cuts = prefixes(hashes, ends, percent, frequent.value)
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(cells.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("__key"), batch.column("__t"), pa.array(size.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), lists], names)

    text_of = F.col(text).cast("string")
    narrow = df.select(F.col(key).alias("__key"), F.xxhash64(text_of).alias("__t"), text_of.alias("__text"))
    return narrow.mapInArrow(sketch, f"key {kind}, t bigint, n bigint, h1 bigint, h2 bigint, cells array<bigint>")


def _sets(df: DataFrame, wanted: DataFrame, key: str, text: str, n: int, vectors: bool = False) -> DataFrame:
    """The columns of `wanted` (key, t, node and others) but the first two, with the hashes of each one's set or its count vector, as bytes.

    Where several rows have the same key and text, each task gives a node once at most.
    """
    text_of = F.col(text).cast("string")
    rows = df.select(F.col(key).alias("__key"), text_of.alias("__text"), F.xxhash64(text_of).alias("__t"))
    others, made = [c for c in wanted.columns if c not in ("key", "t")], "vector" if vectors else "hashes"
    side = wanted.select("key", "t", *others)
    side = side if wanted.count() > BROADCAST_ROWS else F.broadcast(side)
    found = rows.join(side, F.col("__key").eqNullSafe(F.col("key")) & (F.col("__t") == F.col("t"))).select(*others, "__text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in words.slices(batches, "__text"):
            nodes = batch.column("node").to_pylist()
            new = [i for i, x in enumerate(nodes) if x not in met and not met.add(x)]
            batch = batch.take(pa.array(new, pa.int64())) if len(new) < len(nodes) else batch
            hashes, ends = shingle_sets(batch.column("__text"), n)
            rows = [x.astype("u1") if x.max() < 256 else x for x in count_vectors(hashes, ends)] if vectors else [hashes[a:b].astype("<u8") for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x.tobytes() for x in rows], pa.binary())], [*others, made])

    fields = ", ".join(f"{c} {wanted.schema[c].dataType.simpleString()}" for c in others)
    return found.mapInArrow(build, f"{fields}, {made} binary")


def reaches(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sets of hashes reach the similarity."""
    both = np.concatenate([p, q])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of `pairs` (a, b) whose sets reach the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [reaches(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), percent) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint")


class RTree:
    """An R-tree over count vectors, packed by size and then by the widest coordinates, with nodes' largest coordinates and least sizes."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        self.order = np.arange(len(sizes))
        if len(sizes) > FAN:
            wide = np.argsort(-vectors.std(axis=0), kind="stable")[:3]
            self.order = np.lexsort((vectors[:, wide[2]], vectors[:, wide[1]], vectors[:, wide[0]] // 2, sizes))
        self.vectors, self.sizes = vectors[self.order], sizes[self.order]
        self.upper = []  # from the leaves up: (largest coordinates, least size, largest size)
        top, low, high = self.vectors, self.sizes, self.sizes
        while len(top) > FAN:
            starts = np.arange(0, len(top), FAN)
            top, low, high = np.maximum.reduceat(top, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            self.upper.append((top, low, high))

    def query(self, vector: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Positions of the members whose overlap with the query may reach the similarity."""
        at = np.arange(len(self.upper[-1][0]) if self.upper else len(self.sizes))
        for depth in range(len(self.upper) - 1, -1, -1):
            top, low, high = (x[at] for x in self.upper[depth])
            bound = np.minimum(top, vector).sum(axis=1)
            fits = (percent * low <= 100 * size) & (100 * high >= percent * size)
            at = at[fits & ((100 + percent) * bound >= percent * (size + low))]
            at = (at[:, None] * FAN + np.arange(FAN)).ravel()
            at = at[at < (len(self.upper[depth - 1][0]) if depth else len(self.sizes))]
        bound = np.minimum(self.vectors[at], vector).sum(axis=1)
        return self.order[at[(100 + percent) * bound >= percent * (size + self.sizes[at])]]


def forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (position, position) that join the sets as all of theirs do: a tree gives each set's candidates, those already joined with it are left out, the rest verified."""
    size = np.array([len(x) for x in sets])
    # About two coordinates for each shingle of a middling set keep the bound close to the overlap.
    coordinates = 1 << int(np.clip(np.ceil(np.log2(2 * np.median(size))), 6, 13))
    vectors = count_vectors(np.concatenate(sets), np.concatenate([[0], np.cumsum(size)]), coordinates)
    tree = RTree(vectors, size)
    root, links = np.arange(len(sets)), []
    for q in range(len(sets)):
        got = tree.query(vectors[q], int(size[q]), percent)
        got = got[got < q]
        for x in got[np.argsort(-np.minimum(vectors[got], vectors[q]).sum(axis=1), kind="stable")]:
            if root[x] != root[q] and reaches(sets[x], sets[q], percent):
                links.append((int(x), q))
                low, high = sorted((root[x], root[q]))
                root[root == high] = low
    return links


def _crowded(df: DataFrame, members: DataFrame, classes: DataFrame, key: str, text: str, n: int, percent: int, least: float) -> DataFrame:
    """Links (a, b) between classes that meet in the most crowded cell of both, from members (cell, node, n, many, load).

    This only spares work later: it takes classes that share many cells, as most copies do.
    """
    own = members.groupBy(F.col("node").alias("m")).agg(F.max(F.struct("many", "cell", "load")).alias("c"), F.count("*").alias("cells"), F.first("n").alias("n")).where(F.col("cells") >= least * F.col("n"))
    blocks = F.ceil(F.greatest(F.col("c.many") / BLOCK, F.col("c.load") / BLOCK_SHINGLES))
    placed = own.select("m", F.col("c.cell").alias("cell"), F.pmod(F.xxhash64("m"), blocks).alias("block"))
    met = placed.groupBy(F.col("cell").alias("d"), F.col("block").alias("e")).count().where("count > 1").drop("count")
    placed = placed.join(met, (F.col("cell") == F.col("d")) & (F.col("block") == F.col("e")), "left_semi")
    wanted = scratch.stored(classes.join(placed, F.col("node") == F.col("m")).select("key", "t", "node", "cell", "block"))

    def link(table: pa.Table) -> pa.Table:
        node, hashes = table.column("node").to_numpy(), table.column("hashes").to_pylist()
        pairs = [np.zeros((0, 2), np.int64)]
        for at in _segments(table, "cell", "block"):
            own, first = np.unique(node[at], return_index=True)
            if len(own) > 1:
                pairs.append(own[np.array(forest([np.frombuffer(hashes[k], "<u8") for k in at[first]], percent), np.int64).reshape(-1, 2)])
        found = np.concatenate(pairs)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    bundle = F.pmod(F.xxhash64("cell", "block"), F.lit(-(-wanted.count() // BLOCK) or 1))
    found = scratch.stored(_sets(df, wanted, key, text, n).withColumn("bundle", bundle).groupBy("bundle").applyInArrow(lambda t: link(t), "a bigint, b bigint"))
    scratch.drop(wanted)
    return found


def _segments(table: pa.Table, *keys: str) -> list[np.ndarray]:
    """The places of the rows that agree in `keys`, for each that occurs."""
    columns = [table.column(k).to_numpy() for k in keys]
    order = np.lexsort(columns)
    fresh = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    return np.split(order, np.flatnonzero(fresh) + 1)


def _blocks(members: DataFrame) -> DataFrame:
    """(cell, node, root, n, reach, block, i, j): each of `members` (cell, node, root, n, reach) once for every pair of blocks it has to be in.

    A component of over BLOCK members has blocks of its own, which are not paired with each other.
    """
    per_root = members.groupBy(F.col("cell").alias("c"), F.col("root").alias("r")).agg(F.count("*").alias("rows"))
    small = per_root.where(F.col("rows") <= BLOCK).groupBy(F.col("c").alias("d")).agg(F.ceil(F.sum("rows") / BLOCK).alias("blocks"))
    named = per_root.join(small, F.col("c") == F.col("d"), "left").select("c", "r", F.ceil(F.col("rows") / BLOCK).alias("parts"), "blocks")
    dealt = members.alias("members").join(named, (F.col("cell") == F.col("c")) & (F.col("root") == F.col("r")))
    alone = F.when(F.col("parts") > 1, F.col("root"))
    block = F.when(F.col("parts") > 1, F.xxhash64("root", F.pmod(F.xxhash64("node"), F.col("parts"))).bitwiseOR(F.lit(-(1 << 63)))).otherwise(F.pmod(F.xxhash64("root"), F.col("blocks")))
    dealt = scratch.stored(dealt.select("cell", "node", "root", "members.n", "reach", block.alias("block"), alone.alias("alone")))
    all_blocks = dealt.groupBy(F.col("cell").alias("c"), F.col("block").alias("other")).agg(F.first("alone").alias("its"))
    paired = dealt.join(all_blocks, F.col("cell") == F.col("c")).where(F.col("alone").isNull() | F.col("its").isNull() | (F.col("alone") != F.col("its")))
    spread = scratch.stored(paired.select("cell", "node", "root", "n", "reach", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))
    scratch.drop(dealt)
    return spread


def _searched(members: DataFrame, vectors: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members (cell, node, root, n, reach) of a cell with different roots that the R-trees leave, each once."""
    own = members.groupBy(F.col("node").alias("m")).agg(F.sort_array(F.collect_set(F.struct("reach", "cell")), asc=False)["cell"].alias("cells"))
    spread = _blocks(members)
    # Small groups share a task: each bundle has about 8 blocks' rows.
    bundle = F.pmod(F.xxhash64("cell", "i", "j"), F.lit(-(-spread.count() // (8 * BLOCK)) or 1))
    full = spread.join(vectors.join(own, F.col("node") == F.col("m")).drop("m"), "node").withColumn("bundle", bundle)

    def search(table: pa.Table) -> pa.Table:
        node, root, size, reach, block = (table.column(c).to_numpy() for c in ("node", "root", "n", "reach", "block"))
        vectors = np.stack([np.frombuffer(v, "u1" if len(v) == COORDINATES else "<i4").astype("<i4") for v in table.column("vector").to_pylist()])
        cells = table.column("cells").combine_chunks()
        flat, at = cells.flatten().to_numpy(), cells.offsets.to_numpy() - cells.offsets[0].as_py()
        cell, low, high = (table.column(c).to_numpy() for c in ("cell", "i", "j"))

        def first_here(x: int, y: int) -> bool:
            """Whether this is the first cell in the order of shingles that two members share: a pair comes from one cell only."""
            mine = flat[at[x] : at[x + 1]]
            return mine[np.isin(mine, flat[at[y] : at[y + 1]], assume_unique=True)][0] == cell[x]

        pairs = [np.zeros((0, 2), np.int64)]
        for rows in _segments(table, "cell", "i", "j"):
            i, j = low[rows[0]], high[rows[0]]
            inner, outer = rows[block[rows] == i], rows[block[rows] == j]
            if not len(inner) or not len(outer) or (root[rows] == root[rows[0]]).all():
                continue
            tree = RTree(vectors[inner], size[inner])
            for q in outer:
                got = inner[tree.query(vectors[q], int(size[q]), percent)]
                got = got[(root[got] != root[q]) & (size[got] <= reach[q]) & (size[q] <= reach[got]) & ((node[got] < node[q]) if i == j else np.ones(len(got), bool))]
                got = got[[first_here(x, q) for x in got]] if len(got) else got
                pairs.append(np.column_stack([np.minimum(node[got], node[q]), np.maximum(node[got], node[q])]))
        found = np.concatenate(pairs)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    pairs = scratch.stored(full.groupBy("bundle").applyInArrow(lambda t: search(t), "a bigint, b bigint"))
    scratch.drop(spread)
    return pairs


def near_join(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of `df`: the key, n_shingles (size of its set) and component_id.

    Two texts link when 100 * shared >= percent * union of their sets of distinct n-word shingles;
    component_id is the smallest key reachable by links, the row's own included. A text of fewer
    words has its whole sequence as its one shingle; null and blank texts have none and link with
    nothing. Rows with a null key take part, and get the smallest key of their component, or null.
    Keys may be repeated; other columns are not read. An empty table gives no rows.
    """
    sketches = scratch.stored(_sketches(df, key, text, n, percent).withColumn("row", F.monotonically_increasing_id()))
    lead = F.struct(F.col("key").isNull().alias("none"), "key", "t", "row")
    classes = scratch.stored(sketches.where("n > 0").groupBy("h1", "h2").agg(F.min(lead).alias("lead")).select("h1", "h2", "lead.key", "lead.t", F.col("lead.row").alias("node")))
    leads = classes.select("node")
    leads = leads if classes.count() > BROADCAST_ROWS else F.broadcast(leads)
    # reach: the largest partner that may share enough if this shingle is the first that both share.
    rows = sketches.join(leads, F.col("row") == F.col("node")).select("node", "n", F.posexplode("cells").alias("pos", "cell"))
    rows = rows.select("cell", "node", F.col("n").cast("int").alias("n"), F.expr(f"cast(((n - pos) * {100 + percent}) div {percent} - n as int)").alias("reach"))
    shared = rows.groupBy(F.col("cell").alias("c")).agg(F.count("*").alias("many"), F.sum("n").alias("load"), F.max("reach").alias("most")).where("many > 1")
    met = rows.join(shared, F.col("cell") == F.col("c")).where("n <= most and (many > 2 or load - n <= reach)")
    members = scratch.stored(met.select("cell", "node", "n", "reach", "many", "load"))
    # A quarter of the shingles that a class brings to cells.
    links = _crowded(df, members, classes, key, text, n, percent, (100 - percent) / 400)
    roots = components.components(links)
    placed = members.join(roots, "node", "left").select("cell", "node", "n", "root")
    # The blocks of a large cell give a component each: one member of each stands for it.
    stands = placed.where("root is not null").groupBy("cell", "root").agg(F.min(F.struct("node", "n")).alias("s")).select("cell", "s.*")
    several = stands.groupBy(F.col("cell").alias("c")).agg(F.count("*").alias("many"), F.sum("n").alias("load")).where("many > 1")
    standing = scratch.stored(stands.join(several, F.col("cell") == F.col("c")).drop("c"))
    links = scratch.stored(links.unionByName(_crowded(df, standing, classes, key, text, n, percent, 0.0)))
    roots = components.components(links)
    placed = members.join(roots, "node", "left").select("cell", "node", "n", "reach", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy(F.col("cell").alias("c")).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("c")
    open_cells = scratch.stored(placed.join(mixed, F.col("cell") == F.col("c"), "left_semi"))
    named = classes.select("node", "key", "t")
    needed = scratch.stored(named.join(open_cells.select("node").distinct(), "node"))
    vectors = scratch.stored(_sets(df, needed, key, text, n, vectors=True).dropDuplicates(["node"]))
    pairs = _searched(open_cells, vectors, percent)
    asked = scratch.stored(named.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node"))
    sets = scratch.stored(_sets(df, asked, key, text, n).dropDuplicates(["node"]))
    more = scratch.stored(_verified(pairs, sets, percent))
    scratch.drop(members, standing, open_cells, needed, vectors, pairs, asked, sets)
    joined = components.components(links.unionByName(more))
    named = classes.join(joined, "node", "left").select("h1", "h2", "key", F.coalesce("root", "node").alias("root"))
    smallest = named.groupBy(F.col("root").alias("r")).agg(F.min("key").alias("component_id"))
    of_class = named.join(smallest, F.col("root") == F.col("r")).select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "component_id")
    full = sketches.where("n > 0").select("key", "n", "h1", "h2").join(of_class, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))
    blank = sketches.where("n = 0").select("key", "n", F.col("key").alias("component_id"))
    done = full.select("key", "n", "component_id").unionByName(blank)
    return done.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")
