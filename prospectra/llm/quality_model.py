"""Quality by positive-unlabelled learning.

The texts marked good are trusted positives; all other texts of the corpus are unlabelled web text.
The classifier minimises the non-negative unbiased risk: the positives' loss weighed by the class
prior, and the unlabelled texts' loss as negatives less the positives' share in it, which is held
at zero or more. It is logistic over the shape of a text, each measure cut at quantiles, so that
both ends of a measure can speak against a text, and over the hashed words that it holds.

The direction is fitted on bounded samples. Every text outside the held-out fold then gets its
place along it, and the counts of these places, with the places of positives that were kept out of
the fit, give both the class prior and the last layer, by the same risk over all unlabelled texts.
The prior is the smallest ratio, over thresholds, of the unlabelled to the positive texts above it:
unlabelled texts are positives in that share and others, so no region can hold fewer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectra.llm import labelled, words

#: Trusted positives and unlabelled texts to fit the direction on, at most; hash buckets of words.
SAMPLE, TERMS = 6000, 1 << 13
CUTS, EPOCHS = 24, 300
#: Places in a unit of the direction, and the largest.
PLACES, FARTHEST = 16, 40


@dataclass
class Model:
    """edges: a row of increasing cuts per measure; weight: a row of one more weights per measure."""

    edges: np.ndarray
    weight: np.ndarray
    bias: float
    term: np.ndarray
    scale: float = 1.0
    offset: float = 0.0

    def direction(self, shape: np.ndarray, doc: np.ndarray, term: np.ndarray) -> np.ndarray:
        """From the measures of each text and its distinct pairs of document and word bucket."""
        out = np.full(len(shape), self.bias)
        for j in range(shape.shape[1]):
            out += self.weight[j, np.searchsorted(self.edges[j], shape[:, j], side="right")]
        return out + np.bincount(doc, self.term[term] * per_word(doc, len(shape)), len(shape))

    def logits(self, *features: np.ndarray) -> np.ndarray:
        return self.scale * self.direction(*features) + self.offset


def per_word(doc: np.ndarray, n: int) -> np.ndarray:
    """What each of a text's distinct words counts, so that long and short texts weigh the same."""
    return 1 / np.sqrt(np.maximum(np.bincount(doc, minlength=n), 1))[doc]


def text_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of document and word bucket, in order."""
    w = words.split(texts)
    both = np.unique((w.document().astype(np.int64) << 32) | (w.hashes() & np.uint64(TERMS - 1)).astype(np.int64))
    return both >> 32, both & 0xFFFFFFFF


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk_errors(zp: np.ndarray, zu: np.ndarray, wp: np.ndarray, wu: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk, and the step's derivatives by the logits of positives and unlabelled texts, whose weights sum to one each."""
    sp, su = sigmoid(zp), sigmoid(zu)
    # As negatives: the unlabelled texts' loss less the prior times the positives'.
    negative = float(wu @ np.logaddexp(0, zu) - prior * (wp @ np.logaddexp(0, zp)))
    risk = prior * float(wp @ np.logaddexp(0, -zp)) + max(negative, 0.0)
    if negative >= 0:
        return risk, prior * wp * (sp - 1) - prior * wp * sp, wu * su
    # Where the risk of the negatives is below zero the step goes back from there.
    return risk, prior * wp * sp, -wu * su


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, most: float = 0.98, delta: float = 0.1) -> float:
    """The share of positives among the unlabelled, from counts of both along the same places in ascending order.

    The threshold is that with the least upper bound of the ratio of what lies above it, so that
    places with few texts do not decide.
    """
    above_p, above_u = np.cumsum(positive[::-1])[::-1], np.cumsum(unlabelled[::-1])[::-1]
    if not above_p.size or above_p[0] == 0 or above_u[0] == 0:
        return most
    p, u = above_p / above_p[0], above_u / above_u[0]
    some = p > 0
    slack = math.sqrt(math.log(4 / delta) / (2 * above_u[0])) + math.sqrt(math.log(4 / delta) / (2 * above_p[0]))
    at = np.argmin((u[some] + 1.01 * slack) / p[some])
    return float(np.clip(u[some][at] / p[some][at], 0.01, most))


def last_layer(places: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400) -> tuple[float, float]:
    """Scale and offset along the direction by the non-negative risk over counts of texts at places.

    While the risk of the negatives is not below zero the whole is convex, and Newton steps reach its
    optimum; where it is below zero there, steps of the non-negative rule take over.
    """
    wp, wu = positive / positive.sum(), unlabelled / unlabelled.sum()
    columns, start = np.stack([places, np.ones(len(places))]), np.array([1.0, 0.0])

    def unbiased(v: np.ndarray) -> float:
        z = v @ columns
        return float(wu @ np.logaddexp(0, z) - prior * (wp @ z) + 5e-6 * ((v - start) ** 2).sum())

    best = start.copy()
    for _ in range(100):
        s = sigmoid(best @ columns)
        slope = columns @ (wu * s - prior * wp) + 1e-5 * (best - start)
        if np.abs(slope).max() < 1e-10:
            break
        move = np.linalg.solve((columns * (wu * s * (1 - s))) @ columns.T + 1e-5 * np.eye(2), slope)
        size = 1.0
        while size > 1e-9 and unbiased(best - size * move) > unbiased(best):
            size /= 2
        best = best - size * move
    z = best @ columns
    if best[0] >= 0.05 and wu @ np.logaddexp(0, z) >= prior * (wp @ np.logaddexp(0, z)):
        return float(best[0]), float(best[1])
    value, first, second = np.array([1.0, 0.0]), np.zeros(2), np.zeros(2)
    for step in range(1, steps + 1):
        z = value[0] * places + value[1]
        _, ep, eu = risk_errors(z, z, wp, wu, prior)
        g = np.array([(ep + eu) @ places, (ep + eu).sum()]) + 1e-4 * (value - [1.0, 0.0])
        first += 0.1 * (g - first)
        second += 0.01 * (g * g - second)
        value = value - 0.05 * (1 - 0.95 * step / steps) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        value[0] = max(value[0], 0.05)
    return float(value[0]), float(value[1])


Features = tuple[np.ndarray, np.ndarray, np.ndarray]


def fit(positive: Features, unlabelled: Features, prior: float | None = None, cuts: int = CUTS, epochs: int = EPOCHS) -> Model:
    """Full-batch Adam on the non-negative risk with the logistic loss; neighbouring cuts' weights are drawn together.

    Without a prior, positives are told from unlabelled texts as if these were negatives, which
    orders texts as well and is what a prior is first estimated along.
    """
    (ps, pd, pt), (us, ud, ut) = positive, unlabelled
    features = us.shape[1]
    tails = np.concatenate([[0.002, 0.005, 0.01, 0.02, 0.03], np.linspace(0.05, 0.95, cuts - 10), [0.97, 0.98, 0.99, 0.995, 0.998]])
    edges = np.stack([np.quantile(np.concatenate([ps[:, j], us[:, j]]), tails[:cuts]) for j in range(features)])
    place = lambda x: np.column_stack([np.searchsorted(edges[j], x[:, j], side="right") for j in range(features)])
    p, u = place(ps), place(us)
    lp, lu = per_word(pd, len(ps)), per_word(ud, len(us))
    weight, bias, term = np.zeros((features, edges.shape[1] + 1)), np.zeros(1), np.zeros(TERMS)
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (weight, bias, term)]
    wp, wu = np.full(len(p), 1 / len(p)), np.full(len(u), 1 / len(u))
    columns = np.arange(features)

    def back(at: np.ndarray, error: np.ndarray) -> np.ndarray:
        out = np.zeros_like(weight)
        for j in columns:
            out[j] = np.bincount(at[:, j], error, weight.shape[1])
        return out

    for step in range(1, epochs + 1):
        zp = bias + weight[columns, p].sum(1) + np.bincount(pd, term[pt] * lp, len(p))
        zu = bias + weight[columns, u].sum(1) + np.bincount(ud, term[ut] * lu, len(u))
        if prior is None:
            ep, eu = wp * (sigmoid(zp) - 1) / 2, wu * sigmoid(zu) / 2
        else:
            _, ep, eu = risk_errors(zp, zu, wp, wu, prior)
        smooth = np.zeros_like(weight)
        d = np.diff(weight, axis=1)
        smooth[:, :-1] -= d
        smooth[:, 1:] += d
        words_back = np.bincount(pt, ep[pd] * lp, TERMS) + np.bincount(ut, eu[ud] * lu, TERMS)
        gradients = [back(p, ep) + back(u, eu) + 1e-5 * smooth + 3e-6 * weight, np.array([ep.sum() + eu.sum()]), words_back + 1e-4 * term]
        for rate, param, g, (a, b) in zip((0.1, 0.1, 0.02), (weight, bias, term), gradients, moments, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            param -= rate * (1 - 0.9 * step / epochs) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-9)
    return Model(edges, weight, float(bias[0]), term)


def _counts(places: np.ndarray) -> np.ndarray:
    return np.bincount(places + FARTHEST * PLACES, minlength=2 * FARTHEST * PLACES + 1)


def _place(z: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(z * PLACES), -FARTHEST * PLACES, FARTHEST * PLACES).astype(np.int64)


def _selected(features: Features, rows: np.ndarray) -> Features:
    """The features of some texts, numbered anew."""
    shape, doc, term = features
    new = np.full(len(shape), -1)
    new[rows] = np.arange(len(rows))
    hit = new[doc] >= 0
    order = np.argsort(new[doc[hit]], kind="stable")
    return shape[rows], new[doc[hit]][order], term[hit][order]


def train(df: DataFrame, labels: DataFrame, key: str, text: str, label: str, folds: int, held_out: int, sample: int = SAMPLE) -> Model | None:
    """The direction from at most `sample` positives and `sample` unlabelled texts, the prior and the last layer from all texts; none of the held-out fold."""
    known = labels.where(labelled.fold(F.col(key), folds) != held_out)
    web = df.where(labelled.fold(F.col(key), folds) != held_out).select(F.col(key).alias("__id"), F.col(text).cast("string").alias("__text"))
    trusted = known.where(F.col(label) > 0).select(F.col(key).alias("__id")).distinct().orderBy(F.xxhash64("__id"), "__id").limit(sample).withColumn("__positive", F.lit(True))
    drawn = web.select("__id").distinct().orderBy(F.xxhash64(F.lit(1), "__id"), "__id").limit(sample).withColumn("__positive", F.lit(False))
    # One text for each key: a key that is repeated does not come to the driver as often.
    rows = web.join(F.broadcast(trusted.unionByName(drawn)), "__id").groupBy("__id", "__positive").agg(F.max("__text").alias("__text")).select("__positive", "__text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "__text"):
            doc, term = text_terms(batch.column("__text"))
            ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            terms = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(term.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("__positive"), pa.array(list(labelled.text_shape(batch.column("__text"))), pa.list_(pa.float64())), terms], ["positive", "shape", "terms"])

    measured = rows.mapInArrow(measure, "positive boolean, shape array<double>, terms array<int>").toArrow()
    positive = np.array(measured.column("positive").to_pylist(), bool)
    if not positive.any() or positive.all():
        return None
    shape = np.array(measured.column("shape").to_pylist()).reshape(len(positive), len(labelled.SHAPE))
    terms = measured.column("terms").combine_chunks()
    all_of = (shape, np.repeat(np.arange(len(shape)), np.diff(terms.offsets.to_numpy())), terms.flatten().to_numpy().astype(np.int64))
    # Sums of floats depend on the order of rows, which tasks do not keep.
    order = np.lexsort([*shape.T, positive])
    aside = order[positive[order]][::4]  # positives for the prior and the last layer
    used = np.setdiff1d(order, aside, assume_unique=True)
    used = order[np.isin(order, used)]
    yes, no = (_selected(all_of, used[positive[used] == side]) for side in (True, False))
    if not len(yes[0]):
        yes = _selected(all_of, aside)
    kept_out = _selected(all_of, aside)
    ordering = fit(yes, no)
    prior = class_prior(_counts(_place(ordering.direction(*kept_out))), _counts(_place(ordering.direction(*no))))
    model = fit(yes, no, prior)
    places = _scored(web.select("__text"), model, raw=True).groupBy(F.greatest(F.least(F.floor(F.col("__z") * PLACES), F.lit(FARTHEST * PLACES)), F.lit(-FARTHEST * PLACES)).alias("place")).count().collect()
    unlabelled = np.zeros(2 * FARTHEST * PLACES + 1)
    for r in places:  # at most as many as there are places
        unlabelled[r["place"] + FARTHEST * PLACES] = r["count"]
    trusted_at = _counts(_place(model.direction(*kept_out)))
    prior = class_prior(trusted_at, unlabelled)
    centres = (np.arange(len(unlabelled)) - FARTHEST * PLACES + 0.5) / PLACES
    scale, offset = last_layer(centres, trusted_at, unlabelled, prior)
    return replace(model, scale=scale, offset=offset)


def _scored(rows: DataFrame, model: Model | None, raw: bool = False) -> DataFrame:
    """`rows`, of which the last column is __text, with __z in its place: the logit or, if raw, the place along the direction."""
    held, others = rows.sparkSession.sparkContext.broadcast(model), rows.columns[:-1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "__text"):
            m, z = held.value, np.zeros(batch.num_rows)
            if m is not None:
                features = (labelled.text_shape(batch.column("__text")), *text_terms(batch.column("__text")))
                z = m.direction(*features) if raw else m.logits(*features)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(z)], [*others, "__z"])

    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(place, f"{fields}__z double")


def score(df: DataFrame, model: Model | None, text: str = "text", out: str = "score") -> DataFrame:
    """`df` with `out`, the probability that each whole text is good (0 to 1); 0.5 without a model."""
    names = [f"__c{i}" for i in range(len(df.columns))]
    narrow = df.select(*[F.col(c).alias(n) for c, n in zip(df.columns, names, strict=True)], F.col(text).cast("string").alias("__text"))
    z = F.greatest(F.least(F.col("__z"), F.lit(30.0)), F.lit(-30.0))
    return _scored(narrow, model).select(*[F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True)], (1 / (1 + F.exp(-z))).alias(out))


def quality(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3, folds: int = 5, held_out: int = 0) -> DataFrame:
    """One row per row of `df`: the key, held_out, score and predicted (1 if score >= threshold).

    Learns only from labels and texts whose key's fold is not `held_out`; nothing but the text goes
    into a score. Null and empty texts are scored as texts without words. Without positives every
    score is 0.5. Keys may be null or repeated; null labels are left out.
    """
    model = train(df, labels, key, text, label, folds, held_out)
    scored = score(df.select(key, text), model, text, "__p")
    return scored.select(key, (labelled.fold(F.col(key), folds) == held_out).alias("held_out"), F.col("__p").alias("score"), (F.col("__p") >= threshold).cast("int").alias("predicted"))
