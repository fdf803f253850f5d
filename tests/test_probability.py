"""Past-only models and calibrators against fits one by one in numpy, and against a change of the future."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from prospectra.operators import models, probability

DESIGN = probability.Design("id", "y", "t", ["a", "b"], {"school": 12.0, "area": 30.0}, (2, 20, 60), (3, 30, 200))
SCHEMA = "id long, y int, t int, a double, b double, school string, area string"


def history(signal=1.0, seed=5, periods=5, n=90):
    r = random.Random(seed)
    rows = []
    for i in range(periods * n):
        a, b = r.gauss(0, 1), r.gauss(0, 2)
        school = r.choice(["north", "south", "east", "", None])
        y = int(r.random() < 1 / (1 + math.exp(-(signal * (2 * a + (1.5 if school == "north" else 0)) - 1.5))))
        rows.append((i, y if r.random() > 0.02 else None, 2000 + i % periods, a, b if r.random() > 0.15 else None, school, r.choice(["x", "y"])))
    return rows


def newton(x, y, w, l2):
    """Weights (intercept last) of the weighted mean log loss + l2 / 2 |w|^2 on rows of medians, scaled; and the scaling."""
    def median(c):
        seen = np.repeat(c[~np.isnan(c)], w[~np.isnan(c)].astype(int))
        return np.median(seen) if len(seen) else 0.0
    mid = np.array([median(c) for c in x.T])
    filled = np.where(np.isnan(x), mid, x)
    mean = np.average(filled, axis=0, weights=w)
    sd = np.sqrt(np.average((filled - mean) ** 2, axis=0, weights=w))
    sd = np.where(sd > 1e-8, sd, 1.0)
    z = np.column_stack([(filled - mean) / sd, np.ones(len(x))])
    beta, pen = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], l2), 0.0)
    for _ in range(40):
        p = 1 / (1 + np.exp(-z @ beta))
        g = ((p - y) * w) @ z / w.sum() + pen * beta
        h = (z * (p * (1 - p) * w)[:, None]).T @ z / w.sum() + np.diag(pen)
        beta = beta - np.linalg.solve(h, g)
    return lambda q: 1 / (1 + np.exp(-(np.column_stack([(np.where(np.isnan(q), mid, q) - mean) / sd, np.ones(len(q))]) @ beta))), beta


def logit(p):
    return math.log(p / (1 - p))


class Plain:
    """One fit by the rules, on (row, weight) pairs."""

    def __init__(self, rows, ratio, contexts, columns, l2=0.12):
        self.contexts, self.columns = contexts, columns
        self.n = sum(w for _, w in rows)
        self.p = sum(w * r["y"] for r, w in rows)
        self.counts = {c: defaultdict(lambda: [0.0, 0.0]) for c in contexts}
        for r, w in rows:
            for c in contexts:
                if r[c]:
                    self.counts[c][r[c]][0] += w
                    self.counts[c][r[c]][1] += w * r["y"]
        most = min(ratio[2], max(ratio[1], ratio[0] * self.p))
        key = lambda rw: (hashlib.sha256(f"{rw[0]['id']}|{rw[0]['t']}".encode()).hexdigest(), rw[0]["id"])
        kept, before = [rw for rw in rows if rw[0]["y"] == 1], 0.0
        for r, w in sorted([rw for rw in rows if rw[0]["y"] == 0], key=key):
            if before < most:
                kept.append((r, min(w, most - before)))
            before += w
        y, w = np.array([r["y"] for r, _ in kept], float), np.array([w for _, w in kept], float)
        self.apply, beta = newton(np.array([self.inputs(r, True) for r, _ in kept]), y, w, l2)
        share = (y * w).sum() / w.sum()
        if 0 < share < 1 and 0 < self.p < self.n:
            beta[-1] += logit(self.p / self.n) - logit(share)  # `apply` reads the same array

    def inputs(self, r, own):
        out = [np.nan if r[c] is None else r[c] for c in self.columns]
        y, one = (r["y"], 1.0) if own else (0.0, 0.0)
        for c, weight in self.contexts.items():
            if not r[c]:
                out.append(np.nan)
                continue
            prior = max(self.p - y, 0) / (self.n - one) if self.n - one else self.p / self.n
            n, p = self.counts[c][r[c]] if r[c] in self.counts[c] else (0.0, 0.0)
            n, p = (max(n - one, 0), max(p - y, 0)) if n else (0.0, 0.0)
            out.append((p + weight * prior) / (n + weight))
        return out

    def score(self, r):
        return float(self.apply(np.array([self.inputs(r, False)]))[0])


def plainly(rows, design):
    """(id -> raw, probability) by fits one at a time, the calibrators by period, and all dicts of rows."""
    named = [dict(zip(["id", "y", "t", "a", "b", "school", "area"], r)) for r in rows]
    known = [r for r in named if r["y"] is not None]
    periods = sorted({r["t"] for r in known})
    scored = []
    for t in periods[1:]:
        model = Plain([(r, 1.0) for r in known if r["t"] < t], design.sample, design.contexts, design.features)
        scored += [{**r, "raw": model.score(r)} for r in known if r["t"] == t]
    calibrators = {}
    for t in [*periods, periods[-1] + 1]:
        past = [{**r, "raw_logit": logit(min(1 - 1e-9, max(1e-9, r["raw"])))} for r in scored if r["t"] < t]
        if len(past) >= 40 and min(sum(r["y"] for r in past), sum(1 - r["y"] for r in past)) >= 8:
            calibrators[t] = Plain([(r, 1.0) for r in past], design.calibration_sample, {}, ["raw_logit"])
    through = lambda raw, t: calibrators[t].score({"raw_logit": logit(min(1 - 1e-9, max(1e-9, raw))), "y": 0}) if t in calibrators else raw
    return {r["id"]: (r["raw"], through(r["raw"], r["t"])) for r in scored}, through, known


def test_forward_scores_equal_fits_one_by_one(spark):
    rows = history()
    done = probability.forward(spark.createDataFrame(rows, SCHEMA).repartition(3), DESIGN)
    want, _, _ = plainly(rows, DESIGN)
    got = {r.id: (r.raw, r.probability) for r in done.scored.collect()}
    assert set(got) == set(want)
    assert max(abs(got[k][i] - want[k][i]) for k in want for i in (0, 1)) < 1e-6
    assert any(abs(got[k][0] - got[k][1]) > 1e-3 for k in got)


def test_no_later_year_changes_an_earlier_probability(spark):
    rows = history()
    cut = 2003
    before = {r.id: (r.raw, r.probability) for r in probability.forward(spark.createDataFrame([r for r in rows if r[2] <= cut], SCHEMA), DESIGN).scored.collect()}
    changed = [(*r[:1], 1 - (r[1] or 0), *r[2:4], 100.0, "late", r[6]) if r[2] > cut else r for r in rows]
    after = {r.id: (r.raw, r.probability) for r in probability.forward(spark.createDataFrame(changed, SCHEMA), DESIGN).scored.collect() if r.t <= cut}
    assert set(before) == set(after) and max(abs(before[k][i] - after[k][i]) for k in before for i in (0, 1)) < 1e-9
    # A period's own labels change none of its probabilities either.
    own = [(r[0], None if r[1] is None else 1 - r[1], *r[2:]) if r[2] == cut else r for r in rows]
    mine = {r.id: r.probability for r in probability.forward(spark.createDataFrame(own, SCHEMA), DESIGN).scored.collect() if r.t == cut}
    assert max(abs(mine[k] - before[k][1]) for k in mine) < 1e-9


def test_judgement_and_predictions(spark):
    rows = history()
    df = spark.createDataFrame(rows, SCHEMA)
    done = probability.forward(df, DESIGN)
    want, through, known = plainly(rows, DESIGN)
    by_year = {r.t: r for r in probability.judged(done, DESIGN).collect()}
    assert sorted(by_year) == [2002, 2003, 2004]
    for t, r in by_year.items():
        pairs = [(want[k["id"]][1], k["y"]) for k in known if k["t"] == t]
        rate = np.mean([k["y"] for k in known if k["t"] < t])
        assert (r.n, r.positives) == (len(pairs), sum(y for _, y in pairs))
        assert r.brier == pytest.approx(np.mean([(p - y) ** 2 for p, y in pairs]), abs=1e-6) and r.baseline_brier == pytest.approx(np.mean([(rate - y) ** 2 for _, y in pairs]), abs=1e-6)
        good, bad = [p for p, y in pairs if y], [p for p, y in pairs if not y]
        assert r.auc == pytest.approx(np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]), abs=1e-6)
    assert probability.gate(done, DESIGN)["passes"]
    people = [(900, 0.5, 1.0, "north", "x"), (901, -2.0, None, "nowhere", "y"), (902, 30.0, 90.0, None, "x"), (903, None, None, None, None), (900, 0.5, 1.0, "north", "x")]
    candidates = spark.createDataFrame(people, "id long, a double, b double, school string, area string")
    got = probability.predict(candidates, df, DESIGN, done, replicates=7).collect()
    assert len(got) == 5 and sorted(got, key=str)[0] == sorted(got, key=str)[1]
    periods = sorted({r["t"] for r in known})
    final = Plain([(r, 1.0) for r in known], DESIGN.sample, DESIGN.contexts, DESIGN.features)
    draws = defaultdict(Counter)
    for fit, period, weight in models.bootstrap_plan(periods, 7, 8128):
        draws[fit][period] += weight
    replicas = [Plain([(r, float(d[r["t"]])) for r in known if d[r["t"]]], DESIGN.sample, DESIGN.contexts, DESIGN.features) for d in draws.values()]
    for r in got:
        row = {"id": r.id, "y": 0, "a": r.a, "b": r.b, "school": r.school, "area": r.area}
        if r.id == 903:
            assert (r.status, r.probability, r.coverage) == ("insufficient", None, 0.0)
            continue
        assert r.status == "estimate" and r.raw == pytest.approx(final.score(row), abs=1e-6) and r.probability == pytest.approx(through(final.score(row), 2005), abs=1e-6)
        spread = [through(m.score(row), 2005) for m in replicas]
        assert (r.low, r.high) == pytest.approx(tuple(np.quantile(spread, [0.1, 0.9])), abs=1e-6)
    assert next(r for r in got if r.id == 902).out_of_range > 10 > 3 > next(r for r in got if r.id == 900).out_of_range


def test_noise_is_withheld_and_nothing_breaks_on_little(spark):
    candidates = spark.createDataFrame([(1, 0.0, 0.0, "north", "x")], "id long, a double, b double, school string, area string")
    noise = spark.createDataFrame(history(signal=0.0, seed=8), SCHEMA)
    assert [(r.status, r.probability, r.coverage) for r in probability.predict(candidates, noise, DESIGN).collect()] == [("withheld", None, 1.0)]
    none = noise.limit(0)
    assert [r.status for r in probability.predict(candidates, none, DESIGN).collect()] == ["withheld"]
    assert probability.forward(none, DESIGN).scored.count() == 0
    one = noise.where("t = 2000")
    assert probability.forward(one, DESIGN).scored.count() == 0 and not probability.gate(probability.forward(one, DESIGN), DESIGN)["passes"]
    same = noise.where("y = 1")
    assert probability.forward(same, DESIGN).scored.count() == 0


def test_missing_flags_reach_their_own_optimum(spark):
    r = random.Random(2)
    data = [(i, int(r.random() < (0.8 if i % 3 else 0.2)), 1, r.gauss(0, 1) if i % 3 else None) for i in range(300)]
    rows = spark.createDataFrame(data, "id int, y int, t int, a double")
    fitted = models.fit_logistic(rows, [(7, 1, 1.0)], ["a"], "y", "t", flags=True)
    scored = {x.id: x.probability for x in fitted.score(rows, "fit") .collect()} if "fit" in rows.columns else {x.id: x.probability for x in fitted.score(rows.selectExpr("*", "7 AS fit"), "fit").collect()}
    x = np.array([[0.0 if v is None else v, float(v is None)] for _, _, _, v in data])
    seen = [v for *_, v in data if v is not None]
    x[:, 0] = np.where(x[:, 1] == 1, np.median(seen), x[:, 0])
    z = np.column_stack([(x[:, 0] - x[:, 0].mean()) / x[:, 0].std(), x[:, 1]])
    y, p = np.array([d[1] for d in data]), np.array([scored[d[0]] for d in data])
    # The unpenalised intercept and both penalised slopes: their gradients vanish for some weights on these columns.
    design = np.column_stack([z, np.ones(len(z))])
    beta, *_ = np.linalg.lstsq(design, np.log(p / (1 - p)), rcond=None)
    assert np.abs(design @ beta - np.log(p / (1 - p))).max() < 1e-8
    g = design.T @ (p - y) / len(y) + 0.08 * np.append(beta[:2], 0)
    assert np.abs(g).max() < 1e-7 and beta[1] < -0.5


def test_nested_folds_equal_fits_one_by_one(spark):
    rows = history(seed=12, periods=4, n=60)
    design = probability.Design("id", "y", "t", ["a", "b"], {"school": 12.0}, (2, 20, 60), (3, 30, 200))
    got = {r.id: (r.raw, r.probability) for r in probability.nested(spark.createDataFrame(rows, SCHEMA), design).collect()}
    known = [r for r in (dict(zip(["id", "y", "t", "a", "b", "school", "area"], r)) for r in rows) if r["y"] is not None]
    assert set(got) == {r["id"] for r in known}
    fit = lambda without: Plain([(r, 1.0) for r in known if r["t"] not in without], design.sample, design.contexts, design.features)
    for h in sorted({r["t"] for r in known}):
        inner = []
        for q in sorted({r["t"] for r in known} - {h}):
            model = fit({h, q})
            inner += [({**r, "t": h, "raw_logit": logit(model.score(r))}, 1.0) for r in known if r["t"] == q]
        through, model = Plain(inner, design.calibration_sample, {}, ["raw_logit"]), fit({h})
        for r in [r for r in known if r["t"] == h]:
            raw = model.score(r)
            assert got[r["id"]] == pytest.approx((raw, through.score({"raw_logit": logit(raw), "y": 0})), abs=1e-6)
    assert probability.nested(spark.createDataFrame([], SCHEMA), design).count() == 0
    folds = {r.id: r.fold for r in probability.with_fold(spark.createDataFrame(rows, SCHEMA), "id").collect()}
    assert set(folds.values()) == set(range(5))
