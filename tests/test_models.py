"""Logistic fits against the optimum's own condition, streams against tables, record files by round trip."""

import gzip
import json

import numpy as np
import pytest

from conftest import DATA
from prospectra.operators import models
from prospectra.plans.models import order_rows
from prospectra.sources import records
from prospectra.streaming import windows


def slope(x, y, weight, fitted, l2):
    median, mean, scale, w = fitted
    z = (np.where(np.isnan(x), median, x) - mean) / scale
    p = 1 / (1 + np.exp(-(z @ w[:-1] + w[-1])))
    g = np.append(((p - y) * weight) @ z, ((p - y) * weight).sum()) / weight.sum()
    return g + l2 * np.append(w[:-1], 0), p


def test_fits_reach_their_optimum_and_score_past_only(spark):
    rows = order_rows(spark, DATA)
    pdf = rows.toPandas()
    fitted = models.fit_logistic(rows, models.expanding_plan(sorted(set(int(t) for t in pdf["year"]))), ["o_totalprice", "month"], "late", "year")
    assert fitted.by_fit
    x, y, year = pdf[["o_totalprice", "month"]].to_numpy(float), pdf["late"].to_numpy(float), pdf["year"].to_numpy()
    for fit, model in fitted.by_fit.items():
        past = year < fit
        g, _ = slope(x[past], y[past], np.ones(past.sum()), model, 0.08)
        assert np.abs(g).max() < 1e-7
        _, p = slope(x[year == fit], y[year == fit], np.ones((year == fit).sum()), model, 0.08)
        got = fitted.score(rows.where(f"year = {fit}"), "year").toPandas().set_index("o_orderkey")["probability"]
        assert np.allclose(got.loc[pdf["o_orderkey"][year == fit]].to_numpy(), p, atol=1e-9)


def test_bootstrap_weights_missing_values_and_one_class(spark):
    rng = np.random.default_rng(1)
    data = [(int(t), float(v) if v > -1 else None, int(rng.random() < 1 / (1 + np.exp(-v)))) for t, v in zip(rng.integers(0, 4, 400), rng.normal(size=400))]
    rows = spark.createDataFrame([*data, (9, 1.0, 1), (2, 1.0, None)], "t int, v double, y int")
    plan = models.bootstrap_plan([0, 1, 2, 3], 3, 8128)
    fitted = models.fit_logistic(rows, [*plan, (50, 9, 1.0)], ["v"], "y", "t")
    assert sorted(fitted.by_fit) == [0, 1, 2]
    for fit, model in fitted.by_fit.items():
        weight = {p: n for f, p, n in plan if f == fit}
        kept = [d for d in data if d[0] in weight]
        x = np.array([[np.nan if d[1] is None else d[1]] for d in kept])
        g, _ = slope(x, np.array([d[2] for d in kept], float), np.array([weight[d[0]] for d in kept]), model, 0.08)
        assert np.abs(g).max() < 1e-7
    assert models.fit_logistic(rows.limit(0), plan, ["v"], "y", "t").by_fit == {}


def test_a_drained_stream_gives_the_tables_windows(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{DATA}/events*.parquet")
    for i, made in enumerate([lambda e: windows.tumbling(e, "event_type", "value"), lambda e: windows.sessions(e, "user_id"), lambda e: windows.first_seen(e, "event_id").select("event_id")]):
        query = made(stream).writeStream.format("memory").queryName(f"drained{i}").outputMode("append" if i == 2 else "complete").trigger(availableNow=True).start()
        query.awaitTermination(120)
        want = made(events)
        got = spark.table(f"drained{i}")
        shown = [c for c in want.columns if c != "total"]
        assert sorted(map(str, got.select(*shown).collect())) == sorted(map(str, want.select(*shown).collect()))


def test_record_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbfname,week\nAnn , 3\nBo,\n")
    want = [("Ann", "3"), ("Bo", None)]
    assert [tuple(r) for r in records.read_records(spark, f"{tmp_path}/a.csv", ["name"]).collect()] == want
    (tmp_path / "b.csv.gz").write_bytes(gzip.compress(b"name,week\nAnn,3\nBo,\n"))
    assert [tuple(r) for r in records.read_records(spark, f"{tmp_path}/b.csv.gz").collect()] == want
    rows = [{"name": "Ann", "week": 3}, {"name": "Bo", "week": None}]
    for name, held in [("list", rows), ("held", {"players": rows}), ("kept", {"records": rows})]:
        (tmp_path / f"{name}.json").write_text(json.dumps(held, indent=1))
        assert sorted(r["name"] for r in records.read_records(spark, f"{tmp_path}/{name}.json").collect()) == ["Ann", "Bo"]
    with pytest.raises(ValueError):
        records.read_records(spark, f"{tmp_path}/a.csv", ["team"])
    df = spark.createDataFrame(want, "name string, week string")
    records.write_records(df, f"{tmp_path}/out.csv", ["week"])
    back = records.read_records(spark, f"{tmp_path}/out.csv")
    assert back.columns == ["week", "name"] and sorted(r["name"] for r in back.collect()) == ["Ann", "Bo"]
    records.write_records(df, f"{tmp_path}/out.jsonl")
    assert sorted(map(tuple, records.read_records(spark, f"{tmp_path}/out.jsonl").select("name", "week").collect()), key=str) == sorted(want, key=str)
    assert records.template(spark, "name string").count() == 0


def test_fits_in_several_passes(spark, monkeypatch):
    """One fit at a time, and a few sums at a time, give what one pass gives."""
    rows = spark.createDataFrame([(i % 4, int((i * 7 % 11) > 5), float(i % 13) if i % 9 else None, float(i * i % 17)) for i in range(400)], "t int, y int, v double, u double")
    plan = models.expanding_plan([0, 1, 2, 3])
    want = models.fit_logistic(rows, plan, ["v", "u"], "y", "t").linear()
    monkeypatch.setattr(models, "MOST_NUMBERS", 1)
    monkeypatch.setattr(models, "MOST_SUMS", 4)
    got = models.fit_logistic(rows, plan, ["v", "u"], "y", "t").linear()
    assert set(got) == set(want) == {1, 2, 3}
    for f, (w, b, m) in want.items():
        assert got[f][2] == m and abs(got[f][1] - b) < 1e-9 and all(abs(x - y) < 1e-9 for x, y in zip(got[f][0], w))
