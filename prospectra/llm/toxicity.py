"""Toxicity by a factorization machine over hashed terms.

Terms are whole lower-cased words and their first bytes, hashed to buckets; a text's vector says
which it holds. The machine has a weight and a short factor for every bucket, and the factors' dot
products are the weights of pairs: a pair can matter whose members do not. It is fitted on a
bounded sample of labelled rows; scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectra.llm import labelled, words

#: Hash buckets; labelled rows of each class to fit on; buckets that the machine keeps.
BUCKETS, SAMPLE, KEPT = 1 << 20, 6000, 16_384
RANK, EPOCHS = 4, 80
#: Standard errors by which a bucket must tell the classes apart alone, or a pair beyond what its two do alone.
LEAST_POWER, PAIR_POWER = 3.0, 5.5
#: Buckets whose pairs are looked at, the most frequent ones.
PAIRED = 1024
#: What the factors may add to all but a hundredth of the texts' logits before the first step.
START = 1.0


@dataclass
class Machine:
    """logit = bias + sum of weights + half of (squared sum of factors - sum of squared factors), over a text's buckets."""

    bias: float
    bucket: np.ndarray
    weight: np.ndarray
    factor: np.ndarray

    def logits(self, doc: np.ndarray, slot: np.ndarray, docs: int) -> np.ndarray:
        """From distinct pairs of document and slot, ordered by document."""
        out = np.full(docs, self.bias)
        out += np.bincount(doc, self.weight[slot], docs)
        for f in range(self.factor.shape[1]):
            v = self.factor[slot, f]
            out += 0.5 * (np.bincount(doc, v, docs) ** 2 - np.bincount(doc, v * v, docs))
        return out


def _pairs(texts: pa.Array, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, slot) in order; slots says which slot a bucket has, or -1."""
    terms, doc, _ = labelled.term_hashes(texts)
    slot = slots[(terms & np.uint64(len(slots) - 1)).astype(np.int64)]
    hit = slot >= 0
    both = np.unique((doc[hit].astype(np.int64) << 32) | slot[hit])
    return both >> 32, both & 0xFFFFFFFF


def lifted_pairs(doc: np.ndarray, bucket: np.ndarray, away: np.ndarray, most: int = PAIRED, least: float = PAIR_POWER) -> list[tuple[int, int, float]]:
    """(bucket, bucket, sign) of pairs that tell the classes apart together by `least` standard errors, beyond what either does alone.

    `away` is a text's class less the classes' mean. Pairs are of the `most` frequent buckets that
    are in less than nine tenths of the texts.
    """
    n = len(away)
    kinds, times = np.unique(bucket, return_counts=True)
    some = times < 0.9 * n
    common = kinds[some][np.argsort(-times[some], kind="stable")[:most]]
    common.sort()
    if len(common) < 2:
        return []
    place = np.minimum(np.searchsorted(common, bucket), len(common) - 1)
    hit = common[place] == bucket
    x = np.zeros((n, len(common)), np.float32)
    x[doc[hit], place[hit]] = 1
    together = (x.T @ x).astype(float)
    rate = (x.T @ (x * away[:, None].astype(np.float32))).astype(float)
    seen, alone = np.diag(together), np.diag(rate)
    # What the two would give, were their effects additive around the mean.
    expected = together * ((alone / np.maximum(seen, 1))[:, None] + (alone / np.maximum(seen, 1))[None, :])
    power = (rate - expected) / np.sqrt((together + 1) * max(float((away**2).mean()), 1e-9))
    # A bucket that is nearly always with the other adds nothing of its own.
    apart = together < 0.9 * np.minimum(seen[:, None], seen[None, :])
    i, j = np.nonzero(np.triu((np.abs(power) >= least) & apart & (together >= 8), 1))
    order = np.argsort(-np.abs(power[i, j]), kind="stable")
    return [(int(common[i[k]]), int(common[j[k]]), float(np.sign(power[i[k], j[k]]))) for k in order]


def fit(doc: np.ndarray, bucket: np.ndarray, y: np.ndarray, weights: np.ndarray, kept: int = KEPT, rank: int = RANK, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """From distinct pairs of document and bucket. Keeps the buckets that tell the classes apart best among these rows, whatever their weights, alone or in a pair."""
    own = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    rate = np.bincount(bucket, (y - own)[doc], BUCKETS)
    seen = np.bincount(bucket, minlength=BUCKETS)
    base = float(np.clip(np.average(y, weights=weights), 1e-3, 1 - 1e-3))
    power = np.abs(rate) / np.sqrt((seen + 1.0) * own * (1 - own))
    power[(seen < 3) | (power < LEAST_POWER)] = 0
    pairs = lifted_pairs(doc, bucket, y - own)[: kept // 4]
    power[[b for p in pairs for b in p[:2]]] = np.inf
    chosen = np.sort(np.argsort(-power, kind="stable")[: min(kept, int((power > 0).sum()))])
    slots = np.full(BUCKETS, -1, np.int32)
    slots[chosen] = np.arange(len(chosen))
    hit = slots[bucket] >= 0
    d, s = doc[hit], slots[bucket[hit]]
    n, m = len(y), len(chosen)
    rng = np.random.default_rng(seed)
    params = [np.array([np.log(base / (1 - base))]), np.zeros(m), rng.normal(0, 0.02, (m, rank))]
    for k, (a, b, sign) in enumerate(pairs):  # factors begin where the pairs point
        params[2][slots[a], k % rank] += 1.5
        params[2][slots[b], k % rank] += 1.5 * sign
    # A bucket of many pairs adds theirs up, and a text of many such buckets their squares: all shrink until few texts begin beyond START.
    begun = np.abs(Machine(0.0, chosen, np.zeros(m), params[2]).logits(d, s, n))
    params[2] /= np.sqrt(max(1.0, float(np.quantile(begun, 0.99)) / START)) if n else 1.0
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    share = weights / max(weights.sum(), 1e-12)
    for step in range(1, epochs + 1):
        machine = Machine(float(params[0][0]), chosen, params[1], params[2])
        p = 1 / (1 + np.exp(-np.clip(machine.logits(d, s, n), -30, 30)))
        error = share * (p - y)
        row = error[d]
        gradients = [np.array([error.sum()]), np.bincount(s, row, m) + 1e-4 * params[1], np.zeros((m, rank))]
        for f in range(rank):
            v = params[2][s, f]
            total = np.bincount(d, v, n)
            gradients[2][:, f] = np.bincount(s, row * (total[d] - v), m) + 1e-3 * params[2][:, f]
        for rate, param, g, (a, b) in zip((0.1, 0.1, 0.01), params, gradients, moments, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            param -= rate * (1 - 0.8 * step / epochs) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-9)
    return Machine(float(params[0][0]), chosen, params[1], params[2])


def train(df: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int = SAMPLE) -> Machine:
    """Fits on at most 2 * `sample` labelled rows, in one task; only the machine comes to the driver."""
    few = labelled.sample(labels, key, label, sample)
    rows = df.select(F.col(key).alias("__id"), F.col(text).cast("string").alias("__text")).join(F.broadcast(few), "__id").groupBy("__id").agg(F.max("__text").alias("__text"), F.first("__y").alias("__y"), F.first("__share").alias("__share"))

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "__text"):
            terms, doc, n = labelled.term_hashes(batch.column("__text"))
            both = np.unique((doc.astype(np.int64) << 32) | (terms & np.uint64(BUCKETS - 1)).astype(np.int64))
            ends = np.searchsorted(both >> 32, np.arange(n + 1))
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((both & 0xFFFFFFFF).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__y"), batch.column("__share"), found], ["__id", "__y", "__share", "found"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("__id").combine_chunks()
        found = table.column("found").combine_chunks()
        bucket = found.flatten().to_numpy()
        lengths = np.diff(found.offsets.to_numpy())
        y = table.column("__y").to_numpy().astype(float)
        share = table.column("__share").to_numpy()
        per = np.where(y > 0, share / max(1, (y > 0).sum()), share / max(1, (y == 0).sum()))
        m = fit(np.repeat(np.arange(len(y)), lengths), bucket, y, per)
        return pa.table({"bias": [m.bias], "bucket": [m.bucket.tolist()], "weight": [m.weight.tolist()], "factor": [m.factor.ravel().tolist()]})

    kind = df.schema[key].dataType.simpleString()
    found = rows.mapInArrow(buckets, f"__id {kind}, __y int, __share double, found array<int>").withColumn("__all", F.lit(0))
    got = found.groupBy("__all").applyInArrow(lambda t: learn(t), "bias double, bucket array<bigint>, weight array<double>, factor array<double>").first()
    if got is None:
        return Machine(-4.0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, RANK)))
    return Machine(got["bias"], np.array(got["bucket"], np.int64), np.array(got["weight"]), np.array(got["factor"]).reshape(-1, RANK))


def score(df: DataFrame, machine: Machine, text: str = "text", out: str = "score") -> DataFrame:
    """`df` with `out`, the probability that each whole text is toxic (0 to 1)."""
    held = df.sparkSession.sparkContext.broadcast(machine)
    names = [f"__c{i}" for i in range(len(df.columns))]
    narrow = df.select(*[F.col(c).alias(n) for c, n in zip(df.columns, names, strict=True)], F.col(text).cast("string").alias("__text"))

    def probabilities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Machine = held.value
        slots = np.full(BUCKETS, -1, np.int32)
        slots[m.bucket] = np.arange(len(m.bucket))
        for batch in words.slices(batches, "__text"):
            doc, slot = _pairs(batch.column("__text"), slots)
            p = 1 / (1 + np.exp(-np.clip(m.logits(doc, slot, batch.num_rows), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], [*names, "__score"])

    fields = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, df.schema.fields, strict=True))
    scored = narrow.mapInArrow(probabilities, f"{fields}, __score double")
    return scored.select(*[F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True)], F.col("__score").alias(out))


def toxicity(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", keep: list[str] | None = None, folds: int = 5, held_out: int = 0) -> DataFrame:
    """The columns in `keep` (the key, if not given) with held_out, score and predicted, one row per row of `df`.

    Learns only from labels whose key's fold is not `held_out`; nothing but the text goes into a
    score. Null and empty texts get the score of a text without known terms. Without any labels all
    scores are low. Keys may be null or repeated; null labels are left out. A column of `df` called
    like one of the new ones gives way to it. An empty table gives no rows.
    """
    learned = train(df, labels.where(labelled.fold(F.col(key), folds) != held_out), key, text, label)
    columns = [c for c in keep or [key] if c not in ("held_out", "score", "predicted")]
    scored = score(df.select(*dict.fromkeys([*columns, key, text])), learned, text, "__p")
    fold = (labelled.fold(F.col(key), folds) == held_out).alias("held_out")
    return scored.select(*columns, fold, F.col("__p").alias("score"), (F.col("__p") >= 0.5).cast("int").alias("predicted"))


def without_toxic(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, held_out: int = 0) -> DataFrame:
    """The rows of `df` that `toxicity` does not predict to be toxic, with all their columns, whatever their names."""
    learned = train(df, labels.where(labelled.fold(F.col(key), folds) != held_out), key, text, label)
    return score(df, learned, text, "__p").where("__p < 0.5").select(*df.columns)
