"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside cells, one kept per group.

Equal vectors are one class from the start. Cells come from spherical k-means on a bounded sample;
every vector is indexed. A vector also goes to each other cell whose border is within reach: two
vectors at the similarity are at most `r` apart, and meet if one of them is close enough to the
plane between their cells' centres. Half of `r` would never miss; in many dimensions the part of a
difference that lies across a given plane is far shorter, about `r` over the root of the number of
dimensions, and REACH times half of that is what counts (all of it up to twelve dimensions, where
the search is exact). The tests measure the recall.

Cells of any size are cut into blocks; pairs of blocks are the tasks, and a task gives counts of
links and the links of its own spanning forest, never all pairs. A pair counts in the first cell
that both vectors are in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectra.llm import components, scratch

#: Vectors to fit the centres on, at most; centres, at most; vectors per centre, about; bytes of a block's vectors; vectors of a tile.
SAMPLE, CENTRES, PER_CELL, BLOCK_BYTES, TILE = 20_000, 4096, 1000, 4_000_000, 1024
#: Standard deviations of a difference across a border that are within reach; lengths of vectors that get centres.
REACH, LENGTHS = 3.4, 16


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, 4_000_000 // max(1, len(centres)))
    return np.concatenate([np.argmax(x[i : i + step] @ centres.T, axis=1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Unit centres of the rows of `x`, which have length one."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        nearest = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        norms = np.linalg.norm(sums, axis=1)
        full = norms > 1e-12
        centres[full] = sums[full] / norms[full, None]
    return centres


def reach(least: float, dimensions: int, exact: bool = False) -> float:
    """How far from the plane between two centres a vector still goes to both."""
    apart = math.sqrt(max(2 - 2 * least, 0))
    return apart / 2 * (1.0 if exact else min(1.0, REACH / math.sqrt(dimensions))) + 1e-9


def cells_of(x: np.ndarray, centres: np.ndarray, within: float) -> list[np.ndarray]:
    """The cells of each row in order: that of the nearest centre, and those whose border is within reach."""
    apart = np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 0))
    found: list[np.ndarray] = []
    step = max(1, 4_000_000 // len(centres))
    for i in range(0, len(x), step):
        near = x[i : i + step] @ centres.T
        home = np.argmax(near, axis=1)
        gap = near[np.arange(len(near)), home][:, None] - near
        found += [np.flatnonzero(row) for row in gap <= within * apart[home]]
    return found


def joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For links (a, b) among n places, the first place of each one's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _matched(spread: DataFrame, least: float) -> DataFrame:
    """(node, links, other) per block pair: how many vectors a node links with, counted in one cell only, and a node to join it with."""

    def match(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, copies, block = (table.column(c).to_numpy() for c in ("node", "copies", "block"))
        i, j, cell = (table.column(c)[0].as_py() for c in ("i", "j", "cell"))
        x = table.column("x").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        # Which of the cells before this one each vector is in as well.
        lists = table.column("cells").combine_chunks()
        flat, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(node)), np.diff(lists.offsets.to_numpy()))
        before, place = np.unique(flat[flat < cell], return_inverse=True)
        member = np.zeros((len(node), len(before)), np.float32)
        member[owner[flat < cell], place] = 1
        links = np.zeros(len(node), np.int64)
        inner, outer = np.flatnonzero(block == i), np.flatnonzero(block == j)
        ends = [np.zeros((0, 2), np.int64)]
        for s in range(0, len(inner), TILE):
            for t in range(s if i == j else 0, len(outer), TILE):
                a, b = inner[s : s + TILE], outer[t : t + TILE]
                linked = x[a] @ x[b].T >= least
                if len(before):
                    linked &= member[a] @ member[b].T == 0
                if i == j and s == t:
                    linked = np.triu(linked, 1)
                p, q = np.nonzero(linked)
                if len(p):
                    links += np.bincount(a[p], copies[b[q]], len(node)).astype(np.int64) + np.bincount(b[q], copies[a[p]], len(node)).astype(np.int64)
                    both = np.concatenate([a, b])
                    root = joined(p, q + len(a), len(both))
                    moved = np.flatnonzero(root != np.arange(len(both)))
                    ends.append(np.column_stack([both[moved], both[root[moved]]]))
        pairs = np.concatenate(ends)
        root = joined(pairs[:, 0], pairs[:, 1], len(node))
        used = np.flatnonzero(links)
        return pa.table({"node": node[used], "links": links[used], "other": node[root[used]]})

    return spread.groupBy("d", "cell", "i", "j").applyInArrow(lambda t: match(t), "node bigint, links bigint, other bigint")


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.95, sample: int = SAMPLE, exact: bool = False) -> DataFrame:
    """One row per row of `df`: the key, n_links, component_id and kept.

    Vectors of equal length link at a cosine of `least` or more, in double precision; equal vectors
    always do. With `exact`, no pair of different cells is missed at any number of dimensions.
    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing
    and are kept. component_id is the smallest key reachable by links, kept says whether that is
    the row's own. Rows with a null key take part and are not kept. Keys may be repeated; other
    columns are not read. An empty table gives no rows.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    v = F.col("v")
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    # Scaling by the largest component first keeps the squares of very large or small ones finite.
    top = F.array_max(F.transform(v, lambda e: F.abs(e)))
    good = F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & (top > 0), F.lit(False))
    sound = rows.where(good).withColumn("s", F.transform("v", lambda e: e / top))
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, e: a + e * e))
    unit = sound.withColumn("norm", norm).select("key", "v", F.transform("s", lambda e: e / F.col("norm")).alias("x"))
    # The literal comes first: after the vector it would only hash the first hash again.
    hashes = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")]
    classes = unit.select("key", "x", *hashes).groupBy("h1", "h2").agg(F.min("key").alias("key"), F.count("*").alias("copies"), F.first("x").alias("x"))
    classes = scratch.stored(classes.select("*", F.size("x").alias("d"), F.monotonically_increasing_id().alias("node")))
    centres = {}
    for length in classes.groupBy("d").count().orderBy(F.desc("count"), "d").limit(LENGTHS).collect():
        d, few = length["d"], min(sample, max(1, 64_000_000 // (8 * length["d"])))
        drawn = classes.where(F.col("d") == d).orderBy(F.xxhash64("h1"), "h1", "h2").limit(few).select("x").toArrow().column("x").combine_chunks()
        points = drawn.flatten().to_numpy().reshape(-1, d)
        centres[d] = spherical_kmeans(points, max(1, min(CENTRES, math.ceil(length["count"] / PER_CELL), len(points) // 4)))
    fitted = spark.sparkContext.broadcast(centres)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("d").to_numpy()
            for d in np.unique(sizes):
                part = batch.filter(pa.array(sizes == d))
                x = part.column("x").flatten().to_numpy().reshape(part.num_rows, -1)
                # The rarest lengths have one cell each.
                cells = cells_of(x, fitted.value[d], reach(least, int(d), exact)) if d in fitted.value else [np.zeros(1, np.int64)] * len(x)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells, pa.list_(pa.int64()))], ["node", "copies", "x", "d", "cells"])

    indexed = scratch.stored(classes.select("node", "copies", "x", "d").mapInArrow(index, "node bigint, copies bigint, x array<double>, d int, cells array<bigint>"))
    sizes = indexed.select("d", F.explode("cells").alias("cell")).groupBy(F.col("d").alias("e"), F.col("cell").alias("c")).agg(F.count("*").alias("rows"))
    blocks = sizes.select("e", "c", F.ceil(F.col("rows") * F.col("e") * 8 / BLOCK_BYTES).alias("blocks"))
    placed = indexed.withColumn("cell", F.explode("cells")).join(blocks, (F.col("cell") == F.col("c")) & (F.col("d") == F.col("e")))
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    found = scratch.stored(_matched(spread.select("node", "copies", "x", "cells", "d", "cell", "block", "i", "j"), least))
    scratch.drop(indexed)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components.components(found.select(F.col("node").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "m")
    named = classes.select("h1", "h2", "key", "copies", "node").join(counts, "node", "left").join(roots, F.col("node") == F.col("m"), "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy(F.col("root").alias("r")).agg(F.min("key").alias("component"))
    result = named.join(smallest, F.col("root") == F.col("r")).select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component")
    usable = rows.where(good).select("key", *hashes).join(result, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).select("key", "links", "component")
    rest = rows.where(~good).select("key", F.lit(0).cast("long").alias("links"), F.col("key").alias("component"))
    done = usable.unionByName(rest)
    component = F.col("component").cast(kind)
    return done.select(F.col("key").alias(key), F.col("links").cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("key"), F.lit(False)).alias("kept"))
