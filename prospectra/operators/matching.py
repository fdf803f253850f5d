"""One-to-one assignment by best offers, and identities that hold no contradiction."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectra.sources import shared

#: Pairs or links, at most, of which the rounds that are left run in one task, on arrays, to the same result.
AT_ONCE = 2_000_000


def _tops(side: np.ndarray, other: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """For each of n keys the single other one of the highest score, or -1."""
    top = np.full(n, -np.inf)
    np.maximum.at(top, side, score)
    at = score == top[side]
    times = np.bincount(side[at], minlength=n)
    found = np.full(n, -1)
    found[side[at]] = other[at]
    found[times != 1] = -1
    return found


def settle(left: np.ndarray, right: np.ndarray, score: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rounds of `assign` on places of keys, from round `turn` on: per left place the right one or -1, the round, whether pairs are left, and whether a single best one is."""
    n, m = left.max(initial=-1) + 1, right.max(initial=-1) + 1
    met, at = np.full(n, -1), np.zeros(n, np.int64)
    while len(left):
        a, b = _tops(left, right, score, n), _tops(right, left, score, m)
        mutual = np.flatnonzero(a >= 0)
        mutual = mutual[b[a[mutual]] == mutual]
        if not len(mutual):
            break
        met[mutual], at[mutual] = a[mutual], turn
        gone = np.zeros(m, bool)
        gone[a[mutual]] = True
        keep = (met[left] < 0) & ~gone[right]
        left, right, score, turn = left[keep], right[keep], score[keep], turn + 1
    open_ = np.zeros(n, bool)
    open_[left] = True
    return met, at, open_, (_tops(left, right, score, n) >= 0) if len(left) else np.zeros(n, bool)


def best_offers(pairs: DataFrame, side: str, other: str, score: str) -> DataFrame:
    """(side, other): for each of one side the single other one of the highest score; those with several at the top offer nothing."""
    high, low = F.max(F.struct(F.col(score), F.col(other))), F.min(F.struct((-F.col(score)).alias(score), F.col(other)))
    tops = pairs.groupBy(side).agg(high[other].alias(other), low[other].alias("__low"))
    return tops.where(F.col(other) == F.col("__low")).drop("__low")


def assign(pairs: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """(left, right, round, status): one row per left key of `pairs`, assigned one to one.

    In each round a pair is settled if either is the other's one best; both then leave, and others'
    offers may become single. It ends when no pair is settled; rounds over few pairs run in one task. `status` is `matched`; `ambiguous`
    for a left key with several best ones left; `contested` for one whose single best does not
    answer; `exhausted` where all its right keys are taken. Nothing is decided by the order of keys.
    Of repeated pairs the highest score counts; rows with null keys or scores (NaN included) are not
    pairs. Each round reads the remaining pairs once per side and keeps one row per key; random
    scores take a number of rounds that grows with the logarithm of the pairs.
    """
    s = F.col(score).cast("double")
    kinds = {c: pairs.schema[c].dataType.simpleString() for c in (left, right)}

    def finish(turn: int):
        def run(table):
            sides = [table.column(c).combine_chunks().dictionary_encode() for c in (left, right)]
            places = [x.indices.to_numpy().astype(np.int64) for x in sides]
            met, at, open_, single = settle(*places, table.column(score).to_numpy(), turn)
            keys = sides[0].dictionary
            found = sides[1].dictionary.take(pa.array(np.where(met >= 0, met, 0), mask=met < 0))
            status = np.where(met >= 0, "matched", np.where(~open_, "exhausted", np.where(single, "contested", "ambiguous")))
            return pa.table({left: keys, right: found, "round": pa.array(at, pa.int32(), mask=met < 0), "status": pa.array(status.tolist(), pa.string())})

        return run

    with shared.Shelf(pairs.sparkSession) as shelf:
        sound = pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull() & s.isNotNull() & ~F.isnan(s)).groupBy(left, right).agg(F.max(s).alias(score))
        rest = shelf.put(sound)
        everyone, settled = rest.select(left).distinct(), []
        for turn in itertools.count(1):
            if rest.count() <= AT_ONCE:
                break
            from_left, from_right = best_offers(rest, left, right, score), best_offers(rest, right, left, score)
            met = shelf.put(from_left.join(from_right, [left, right]).withColumn("round", F.lit(turn)))
            if met.isEmpty():
                break
            settled.append(met.withColumn("status", F.lit("matched")))
            rest = shelf.put(rest.join(met.select(left), left, "left_anti").join(met.select(right), right, "left_anti"))
        if rest.count() <= AT_ONCE:
            schema = f"`{left}` {kinds[left]}, `{right}` {kinds[right]}, round int, status string"
            last = rest.withColumn("__all", F.lit(0)).groupBy("__all").applyInArrow(finish(turn), schema)
        else:
            # No pair meets among what is left.
            single = F.max(F.struct(F.col(score), F.col(right)))[right] == F.min(F.struct((-F.col(score)).alias(score), F.col(right)))[right]
            last = rest.groupBy(left).agg(F.when(single, "contested").otherwise("ambiguous").alias("status")).select(left, F.lit(None).cast(kinds[right]).alias(right), F.lit(None).cast("int").alias("round"), "status")
        for met in settled:
            last = last.unionByName(met)
        done = everyone.join(last.withColumnRenamed(left, "__left"), F.col(left) == F.col("__left"), "left")
        return shared.stored(done.select(left, right, "round", F.coalesce("status", F.lit("exhausted")).alias("status")))


def agreements(rows: DataFrame, key: str, block: Sequence[str], fields: Sequence[str], least: int, identity: Sequence[str] = ()) -> DataFrame:
    """Links (a, b, weight) that connect all rows of a block that agree in at least `least` of the fields, one of `identity` among them.

    Rows with the same values in the same `least` fields all agree with each other, so each is
    linked with the smallest key of them, and with no more: a block of any size gives a row per
    combination of fields, never its pairs. Null values agree with nothing. `weight` is how many
    combinations the two share this way.
    """
    combos = [c for c in itertools.combinations(fields, least) if not identity or set(c) & set(identity)]
    held = [F.when(sum((F.col(f).isNotNull().cast("int") for f in c), F.lit(0)) == least, F.struct(F.lit(i).alias("combo"), F.xxhash64(*[F.lit(i), *block, *c]).alias("h1"), F.xxhash64(*[F.lit(-1 - i), *block, *c]).alias("h2"))) for i, c in enumerate(combos)]
    spread = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("b"), F.inline(F.array_compact(F.array(*held))))
    firsts = spread.groupBy("combo", "h1", "h2").agg(F.min("b").alias("a"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    return spread.join(firsts, ["combo", "h1", "h2"]).where("a <> b").groupBy("a", "b").agg(F.count("*").cast("double").alias("weight"))


def _compatible(one: Sequence[Column], other: Sequence[Column]) -> Column:
    agreed = F.lit(True)
    for a, b in zip(one, other, strict=True):
        agreed = agreed & (a.isNull() | b.isNull() | (a == b))
    return agreed


def _grown(u: np.ndarray, v: np.ndarray, weight: np.ndarray, flips: np.ndarray, order: np.ndarray, anchors: np.ndarray, turn: int) -> np.ndarray:
    """The rounds of `identities` on places of groups, from round `turn` on: the place that each ends in. Links are given in both directions; -1 is no anchor."""
    home, anchors = np.arange(len(flips)), anchors.copy()
    while len(u):
        agreed = ((anchors[u] < 0) | (anchors[v] < 0) | (anchors[u] == anchors[v])).all(1)
        u, v, weight = u[agreed], v[agreed], weight[agreed]
        side = (flips >> np.uint64(turn % 63)) & np.uint64(1)
        turn += 1
        at = np.flatnonzero((side[u] == 0) & (side[v] == 1))
        if len(at):
            # The heaviest link of each asker, then the heaviest asker of each group; the lower key of equals.
            at = at[np.lexsort((order[v[at]], -weight[at], u[at]))]
            at = at[np.concatenate([[True], u[at][1:] != u[at][:-1]])]
            at = at[np.lexsort((order[u[at]], -weight[at], v[at]))]
            first = np.concatenate([[True], v[at][1:] != v[at][:-1]])
            lead = at[first][np.cumsum(first) - 1]
            held = np.where(anchors[v[lead]] >= 0, anchors[v[lead]], anchors[u[lead]])
            at = at[((anchors[u[at]] < 0) | (anchors[u[at]] == held)).all(1)]
            moved = np.arange(len(home))
            moved[u[at]] = v[at]
            for column in range(anchors.shape[1]):
                np.maximum.at(anchors[:, column], v[at], anchors[u[at], column])
            home = moved[home]
            u, v = moved[u], moved[v]
            key, inverse = np.unique(np.where(u == v, -1, u * len(home) + v), return_inverse=True)
            total = np.bincount(inverse, weight, len(key))
            keep = key >= 0
            u, v, weight = key[keep] // len(home), key[keep] % len(home), total[keep]
    return home


def identities(rows: DataFrame, key: str, links: DataFrame, anchors: Sequence[str]) -> DataFrame:
    """(key, identity): groups of linked rows, none of which holds two different values of an anchor; `identity` is the smallest key of the group.

    `links` has a, b and weight. In each round half of the groups, drawn by a hash, ask the group of
    the heaviest admissible link among the other half; a group takes in the heaviest that asks and
    all askers whose anchors it then has or that have none. It ends when every link left would join
    a contradiction, so groups are as large as they can be; without anchors they are the connected
    components. A hub takes in all that agree at once, so rounds grow with the logarithm of the
    rows; those over few links run in one task, to the same groups. Rows without links are alone; null keys have no identity; repeated keys count once, with
    the smallest of their anchors.
    """
    names = [f"__n{i}" for i in range(len(anchors))]
    kind = rows.schema[key].dataType.simpleString()

    def finish(turn: int):
        def run(table):
            sides = pa.concat_arrays([table.column(c).combine_chunks() for c in ("u", "v")]).dictionary_encode()
            u, v = np.split(sides.indices.to_numpy().astype(np.int64), 2)
            flips, order = np.zeros(len(sides.dictionary), np.uint64), np.empty(len(sides.dictionary), np.int64)
            flips[u] = table.column("flips").to_numpy().view(np.uint64)
            order[np.array(pc.sort_indices(sides.dictionary))] = np.arange(len(order))
            held = np.full((len(order), len(names)), -1)
            for i, n in enumerate(names):
                codes = table.column(f"{n}u").combine_chunks().dictionary_encode().indices
                held[u, i] = codes.fill_null(-1).to_numpy()
            home = _grown(u, v, table.column("weight").to_numpy(), flips, order, held, turn)
            return pa.table({"__from": sides.dictionary, "__to": sides.dictionary.take(pa.array(home))})

        return run

    with shared.Shelf(rows.sparkSession) as shelf:
        known = rows.where(F.col(key).isNotNull())
        nodes = known.groupBy(F.col(key).alias("node")).agg(*[F.min(a).alias(n) for a, n in zip(anchors, names, strict=True)]) if anchors else known.select(F.col(key).alias("node")).distinct()
        groups = shelf.put(nodes.select(F.col("node").alias("group"), *names))
        members = groups.select(F.col("group").alias("node"), "group")
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v"), "weight").where("u <> v")
        edges = shelf.put(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight")).groupBy("u", "v").agg(F.sum("weight").alias("weight")))
        for turn in itertools.count():
            mine = groups.select(F.col("group").alias("u"), *[F.col(n).alias(f"{n}u") for n in names])
            theirs = groups.select(F.col("group").alias("v"), *[F.col(n).alias(f"{n}v") for n in names])
            fit = _compatible([F.col(f"{n}u") for n in names], [F.col(f"{n}v") for n in names])
            admissible = shelf.put(edges.join(mine, "u").join(theirs, "v").where(fit).withColumn("flips", F.xxhash64("u")))
            left = admissible.count()
            if left <= AT_ONCE:
                break
            side = lambda c: F.shiftright(F.xxhash64(c), turn % 63).bitwiseAND(F.lit(1).cast("long"))
            best = F.min(F.struct((-F.col("weight")).alias("w"), F.col("v"), *[F.col(f"{n}u") for n in names], *[F.col(f"{n}v") for n in names]))
            asked = shelf.put(admissible.where((side("u") == 0) & (side("v") == 1)).groupBy("u").agg(best.alias("b")).select("u", "b.*"))
            # What a group holds once the heaviest asker is in: its own anchors, else that one's.
            merged = {f"{n}m": F.coalesce(f"{n}v", F.col(f"first.{n}u")) for n in names}
            first = asked.groupBy("v").agg(F.min(F.struct("w", "u", *[f"{n}u" for n in names])).alias("first"), *[F.first(f"{n}v").alias(f"{n}v") for n in names]).select("v", *[c.alias(n) for n, c in merged.items()])
            fits = F.lit(True)
            for n in names:
                fits = fits & (F.col(f"{n}u").isNull() | F.coalesce(F.col(f"{n}u") == F.col(f"{n}m"), F.lit(False)))
            taken = shelf.put(asked.select("u", "v", *[f"{n}u" for n in names]).join(first, "v").where(fits).select(F.col("u").alias("__from"), F.col("v").alias("__to")))
            relabel = lambda df, c, t=taken: df.join(t, F.col(c) == F.col("__from"), "left").withColumn(c, F.coalesce("__to", c)).drop("__from", "__to")
            members = shelf.put(relabel(members, "group"))
            gone = relabel(groups, "group")
            # Anchors of a group agree, so any that is there is the one.
            groups = shelf.put(gone.groupBy("group").agg(*[F.max(n).alias(n) for n in names]) if names else gone.distinct())
            edges = shelf.put(relabel(relabel(admissible.select("u", "v", "weight"), "u"), "v").where("u <> v").groupBy("u", "v").agg(F.sum("weight").alias("weight")))
        if left:
            moved = admissible.select("u", "v", "weight", "flips", *[f"{n}u" for n in names], F.lit(0).alias("__all")).groupBy("__all").applyInArrow(finish(turn), f"__from {kind}, __to {kind}")
            members = members.join(moved, F.col("group") == F.col("__from"), "left").select("node", F.coalesce("__to", "group").alias("group"))
        kept = shelf.put(members)
        least = kept.groupBy("group").agg(F.min("node").alias("identity"))
        return shared.stored(kept.join(least, "group").select(F.col("node").alias(key), "identity"))


def collapsed(rows: DataFrame, key: str, known: DataFrame, columns: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per identity: its key, n_rows, and of each column the first value that is there, rows taken in an order."""
    joined = rows.join(known, key)
    ranked = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(key).alias("k"))
    first = [F.min(F.when(F.col(c).isNotNull(), F.struct(ranked.alias("r"), F.col(c).alias("x"))))["x"].alias(c) for c in columns]
    return joined.groupBy(F.col("identity").alias(key)).agg(F.count("*").alias("n_rows"), *first)
