"""Trained members, measured fits, and features of series."""

import math
import time

import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import functions as F

from tideweave.operators import features, learners
from tideweave.operators.prep import Split
from tideweave.plans import evaluate
from tideweave.plans.evaluate import Settings
from tideweave.sources import trained
from tideweave.sources.panels import to_panel

def models():
    return {"linear": LinearRegression(regParam=0.01), "tree": DecisionTreeRegressor(maxDepth=3, seed=1)}


@pytest.fixture(scope="module")
def walk():
    r = np.random.default_rng(12)
    return {s: (100 * k + np.cumsum(r.normal(size=80))).tolist() for k, s in enumerate("ab", 1)}


def frame(spark, walk):
    return spark.createDataFrame([(s, t, float(y)) for s, ys in walk.items() for t, y in enumerate(ys, 1)], "series string, t long, y double")


def test_no_fold_sees_its_own_targets_or_later_ones(spark, walk):
    plain = {(r["series"], r["t"]): (r["linear"], r["tree"]) for r in trained.walk_forward(frame(spark, walk), models()).collect()}
    assert len(plain) == 2 * 60  # all rows after the first of four stretches
    changed = {s: ys[:60] + [1e6 - 7 * k for k in range(20)] for s, ys in walk.items()}  # the last fold's targets
    other = {(r["series"], r["t"]): (r["linear"], r["tree"]) for r in trained.walk_forward(frame(spark, changed), models()).collect()}
    for key, value in plain.items():
        if key[1] <= 41:  # the folds before, and the row of the last one whose lags all lie before it
            assert np.allclose(value, other[key]), key
    assert not np.allclose(plain["a", 45], other["a", 45])


def test_linear_member_equals_a_fit_by_hand(spark, walk):
    got = {(r["series"], r["t"]): r["linear"] for r in trained.walk_forward(frame(spark, walk), {"linear": LinearRegression(regParam=0.0)}, lags=3).collect()}

    def scaled(ys, t):  # the row t (from 1)
        v = [ys[t - 1 - k] for k in range(1, 4)]
        unit = (abs(v[0] - v[1]) + abs(v[1] - v[2])) / 2 or 1.0
        return v[0], unit, [(x - v[0]) / unit for x in v[1:]]

    known = [(scaled(ys, t), ys[t - 1]) for ys in walk.values() for t in range(4, 21)]
    x = np.array([[1.0, *f[2]] for f, _ in known])
    goal = np.array([(y - f[0]) / f[1] for f, y in known])
    beta = np.linalg.lstsq(x, goal, rcond=None)[0]
    for s, ys in walk.items():
        for t in range(21, 41):
            base, unit, lags = scaled(ys, t)
            assert abs(got[s, t - 20] - (beta @ [1.0, *lags] * unit + base)) < 1e-6


def test_reports_take_trained_members_and_measured_times(spark, walk, monkeypatch):
    members = trained.walk_forward(frame(spark, walk), models())
    panel, settings = to_panel(members, ("linear", "tree")), Settings(Split(0.5, 2, 10, None), members=2)
    slow = learners.ridge

    def slowed(*args, **named):
        def wait(source):
            time.sleep(1.5)
            yield from source

        out = slow(*args, **named)
        return out.coalesce(1).mapInArrow(wait, out.schema)

    monkeypatch.setattr(evaluate.learners, "ridge", slowed)
    rows = evaluate.results_table(panel, settings).collect()
    took = {r["Method"]: r["Time"] for r in rows}
    assert len(took) == 11 and {r["Dataset"] for r in rows} == {"a", "b"}
    assert took["ridge"] >= 1500 and all(took[m] > 0 for m in took if m.startswith("adaptive")) and took["mean"] == 0
    same = {(r["series"], r["method"]): r["mae"] for r in evaluate.report(panel, settings).collect()}
    assert all(abs(same[r["Dataset"], r["Method"]] - r["MAE"]) < 1e-9 for r in rows)


def test_features_equal_plain_loops(spark, monkeypatch):
    r = np.random.default_rng(4)
    y = np.round(np.sin(np.arange(150) / 5) * 3 + r.normal(size=150), 1)  # rounding makes ties
    rows = [("s", "y", t, float(v)) for t, v in enumerate(y, 1)] + [("flat", "y", t, 2.0) for t in range(1, 6)] + [("one", "y", 1, 5.0), ("one", "y", 2, None)]
    monkeypatch.setattr("tideweave.operators.windows.BLOCK", 32)
    held = spark.createDataFrame(rows, "series string, of string, t long, v double")
    got = {x["series"]: x for x in features.series_features(held, most=6, length=32, frequencies=4).collect()}
    s, d, n = got["s"], y - y.mean(), len(y)
    acf = [d[k:] @ d[: n - k] / n / d.var() for k in range(1, 7)]
    assert s["n"] == n and np.allclose(s["autocorrelation"], acf) and np.allclose(s["autocovariance"], np.array(acf) * d.var())
    for k in range(1, 7):  # the last coefficient of a regression on k lags, from the same correlations
        full = np.array([1.0, *acf])
        system = full[np.abs(np.subtract.outer(range(k), range(k)))]
        assert abs(s["partial"][k - 1] - np.linalg.solve(system, full[1 : k + 1])[-1]) < 1e-9
    patterns = {}
    for k in range(n - 2):
        order = tuple(np.argsort(y[k : k + 3], kind="stable"))
        patterns[order] = patterns.get(order, 0) + 1
    p = np.array(list(patterns.values())) / (n - 2)
    assert abs(s["entropy"] + (p * np.log(p)).sum() / math.log(6)) < 1e-9
    power = np.mean([np.abs(np.fft.rfft(y[k : k + 32] - y[k : k + 32].mean())) ** 2 / 32 for k in range(0, 128, 32)], axis=0)
    assert np.allclose(s["power"], power[1:5])
    runs, best = 0, 0
    for v in d:
        runs = runs + 1 if v > 0 else 0
        best = max(best, runs)
    assert s["longest_above"] == best and s["crossings"] == int(((d[1:] > 0) != (d[:-1] > 0)).sum())
    assert s["peaks"] == sum(y[k] > y[k - 1] and y[k] > y[k + 1] for k in range(1, n - 1))
    assert abs(s["slope"] - np.polyfit(np.arange(n), y, 1)[0]) < 1e-9
    assert got["flat"]["autocorrelation"][0] is None and got["flat"]["longest_above"] == 0 and got["flat"]["power"] is None
    assert got["one"]["n"] == 1 and got["one"]["entropy"] is None
    assert features.series_features(held.limit(0)).count() == 0


def test_variables_of_a_panel(spark):
    wide = spark.createDataFrame([("s", 1, 3.0, 2.0)], "series string, t long, y double, m1 double")
    assert {r["of"]: r["v"] for r in features.variables(wide, ["m1"]).collect()} == {"y": 3.0, "m1": 2.0, "m1_error": -1.0}
    assert features.variables(wide, ["m1"]).filter(F.col("t") == 1).count() == 3
