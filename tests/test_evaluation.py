"""The toy panel against known results, and every step against plain NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tideweave.operators import learners, metrics, online
from tideweave.operators.lags import lag_matrix
from tideweave.operators.learners import Penalty
from tideweave.operators import prep
from tideweave.operators.prep import Split, standardised, training
from tideweave.plans import evaluate
from tideweave.plans.evaluate import Settings
from tideweave.sources.panels import to_panel

MEMBERS = [f"m{k}" for k in range(1, 4)]


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(3)
    out = []
    for s, n in (("a", 60), ("b", 45)):
        y = 5 + np.cumsum(r.normal(size=n)) / 3
        for t in range(n):
            out.append((s, t + 1, *(float(v) for v in y[t] + r.normal(size=3) * [0.3, 0.6, 1.0]), float(y[t])))
    return pd.DataFrame(out, columns=["series", "t", *MEMBERS, "y"])


@pytest.fixture(scope="module")
def panel(spark, data):
    return to_panel(spark.createDataFrame(data), MEMBERS).cache()


SETTINGS = Settings(Split(0.5, 2, 8, 10), Penalty(0.01, 0.02, 0.3), 3)


def plain(data, s: Settings):
    """All methods by loops over arrays."""
    rows = []
    for name, part in data.groupby("series"):
        part = part.sort_values("t")
        y0, x0 = part["y"].to_numpy(), part[MEMBERS].to_numpy()
        n, sp, past = len(y0), int(len(y0) * s.split.fraction), s.split.past
        mu, sg = y0[:sp].mean(), y0[:sp].std(ddof=1)
        y, x = (y0 - mu) / sg, np.column_stack([np.ones(n), (x0 - mu) / sg])
        h = s.split.history
        first = max(sp - h + 1, 1)
        last = first + min(h, sp)
        end = sp + 1 + min(s.split.val, n - sp - 1)
        tr = range(first - 1, last)
        xt, yt = x[list(tr)], y[list(tr)]
        ridge = np.linalg.solve(xt.T @ xt / len(yt) + s.penalty.rho * np.eye(4), xt.T @ yt / len(yt))

        def z(i, rule):
            if rule == "value":
                return np.concatenate([*(x[i - k] for k in range(1, past + 1)), y[i - past : i]])
            return np.concatenate([*(x[i - k] - y[i - k] for k in range(1, past + 1)), np.ones(past)])

        fits = {}
        for rule, suffix in (("value", ""), ("error", "_err_rule")):
            ii = [i for i in tr if i - past >= first - 1]
            w = np.array([np.concatenate([[1], z(i, rule)]) for i in ii])
            phi = np.array([np.outer(x[i], w[k]).ravel() for k, i in enumerate(ii)])
            m = len(ii)
            for kind, rb in (("exact", s.penalty.rho_beta), ("standard", 0.0)):
                d = np.full(w.shape[1], s.penalty.rho_v)
                d[0] = s.penalty.rho
                a = phi.T @ phi / m + np.kron(np.eye(4), rb / m * w.T @ w + np.diag(d))
                fits[f"adaptive_ridge_{kind}{suffix}"] = (rule, np.linalg.solve(a, phi.T @ y[ii] / m).reshape(4, -1))
        pa = np.full(4, 0.25)

        def hedge(i, size):
            lo = max(0, i - size)
            loss = ((x[lo:i, 1:] - y[lo:i, None]) ** 2).sum(0)
            e = -np.sqrt(8 * np.log(3) / (i - lo)) * loss
            e = np.exp(e - e.max())
            return e / e.sum()

        for i in range(sp + 1, end):
            pa = online.passive_aggressive_step(pa, x[i - 1], y[i - 1], s.penalty.rho_beta)
            got = {"mean": x[i, 1:].mean(), "bandits_full": x[i, 1:] @ hedge(i, h), "bandits_recent": x[i, 1:] @ hedge(i, past - 1), "PA": x[i] @ pa, "ridge": x[i] @ ridge}
            if i > sp + 1:
                got["last_timestep"] = y[i - 1]
            for m, (rule, theta) in fits.items():
                got[m] = x[i] @ (theta @ np.concatenate([[1], z(i, rule)]))
            rows += [(name, i + 1, m, v * sg + mu) for m, v in got.items()]
    return pd.DataFrame(rows, columns=["series", "t", "method", "want"])


def test_all_methods_equal_plain_loops(panel, data):
    got = evaluate.errors(panel, SETTINGS).toPandas()
    assert set(got["method"]) == set(evaluate.METHODS)
    both = plain(data, SETTINGS).merge(got, on=["series", "t", "method"])
    assert len(both) == len(plain(data, SETTINGS))
    assert np.abs(both["want"] - both["pred"]).max() < 1e-8


def test_no_forecast_uses_its_own_or_later_targets(spark, data):
    changed = data.copy()
    at = changed["t"] > 40
    changed.loc[at & (changed["series"] == "a"), "y"] += 100
    run = lambda d: evaluate.errors(to_panel(spark.createDataFrame(d), MEMBERS), SETTINGS).filter("series = 'a' AND t <= 41 AND method <> 'best_model'").toPandas()
    a, b = (run(d).sort_values(["t", "method"])["pred"].to_numpy() for d in (data, changed))
    assert np.abs(a - b).max() < 1e-9


def test_adaptive_ridge_becomes_ridge_when_lags_cost_too_much(panel):
    rows = standardised(panel, SETTINGS.split)
    data = training(lag_matrix(rows, 2)).filter("t >= first + 2")
    theta = learners.adaptive_ridge(data, [("x", Penalty(0.1, 0.2, 1e9))]).toPandas().set_index("series")["theta"]
    plain_ridge = learners.ridge(data, 0.3).toPandas().set_index("series")["theta"]
    for s in ("a", "b"):
        t = np.array(theta[s]).reshape(4, -1)
        assert np.abs(t[:, 1:]).max() < 1e-6
        assert np.abs(t[:, 0] - np.array(plain_ridge[s])).max() < 1e-6


def test_results_do_not_depend_on_partitions(panel):
    a = evaluate.report(panel.repartition(7), SETTINGS).orderBy("series", "method").toPandas()
    b = evaluate.report(panel.coalesce(1), SETTINGS).orderBy("series", "method").toPandas()
    assert np.allclose(a.iloc[:, 2:].to_numpy(float), b.iloc[:, 2:].to_numpy(float), atol=1e-9)


@pytest.mark.parametrize("alpha,want", [(0.5, 3.5), (1.0, 2.5), (0.25, 4.0), (0.375, 11 / 3)])
def test_tail_risk_of_four_errors(spark, alpha, want):
    errors = spark.createDataFrame([("s", "m", float(v)) for v in (1, 2, 3, 4)], "series string, method string, err double")
    assert abs(metrics.cvar(errors, (alpha,)).first()[2] - want) < 1e-12


def test_tail_risk_is_the_least_over_tau(spark):
    r = np.random.default_rng(0)
    for alpha in (0.05, 0.15, 0.33):
        e = np.abs(r.normal(size=37)).round(1)
        frame = spark.createDataFrame([("s", "m", float(v)) for v in e], "series string, method string, err double")
        least = min(t + np.maximum(e - t, 0).sum() / (alpha * len(e)) for t in e)
        assert abs(metrics.cvar(frame, (alpha,)).first()[2] - least) < 1e-9


def test_passive_aggressive_step_meets_the_margin():
    assert online.passive_aggressive_step(np.array([0.5, 0.5]), np.ones(2), 3.0, 0.0).tolist() == [1.5, 1.5]
    w = online.passive_aggressive_step(np.array([0.1, 0.2]), np.array([1.0, 2.0]), 4.0, 0.25)
    assert abs(abs(w @ np.array([1.0, 2.0]) - 4.0) - 0.25) < 1e-12


def test_zero_targets_and_constant_targets_give_nulls_not_errors(spark):
    errors = spark.createDataFrame([("s", "m", 0.0, 1.0), ("s", "m", 0.0, 2.0)], "series string, method string, y double, err double")
    row = metrics.scores(errors).first()
    assert row["mape"] is None and row["r2"] is None and row["mae"] == 1.5


def test_test_rows_follow_training(panel):
    rows = standardised(panel, SETTINGS.split)
    a = training(rows).groupBy("series").agg(F.max("t").alias("a"))
    b = prep.testing(rows).groupBy("series").agg(F.min("t").alias("b"))
    assert all(r["b"] == r["a"] + 1 for r in a.join(b, "series").collect())


def test_plans_of_storms_stay_small(spark):
    rows = [(s, t + 1, t // 4 % 28 + 1, t % 4 * 6, 5.0 + (t * 7 + k) % 11) for k, s in enumerate("ab") for t in range(96)]
    rows = spark.createDataFrame(rows, "series string, t long, days int, hours int, y double").withColumn("current_speed", F.col("y") / 10)
    rows = rows.withColumn("x", F.array(F.lit(1.0), "current_speed", F.col("y") + F.col("hours")))
    errors = evaluate.storm_errors(rows, Settings(Split(0.5, 1, 8, 10), members=2))
    assert errors._jdf.queryExecution().analyzed().collectLeaves().size() < 100  # steps that stand in the plan make it 768


def test_errors_of_adaptive_weights_equal_row_by_row_weights(spark, panel):
    rows = evaluate.relevant(standardised(panel, SETTINGS.split), SETTINGS.split)
    params = evaluate.adaptive_params(rows, SETTINGS)
    tests = prep.testing(evaluate.with_lags(rows, SETTINGS, "value"))
    tests = tests.withColumn("z", F.when((F.col("series") == "a") & (F.col("t") % 4 == 0), F.transform("z", lambda v: F.lit(None).cast("double"))).otherwise(F.col("z")))
    slow = online.adaptive_weights(tests, params, evaluate.z_width(SETTINGS)).withColumn("pred", online.dot("x", "beta") * F.col("sigma") + F.col("mu"))
    want = {(r["series"], r["t"], r["method"]): r["pred"] for r in slow.collect()}
    got = {(r["series"], r["t"], r["method"]): r for r in online.adaptive_errors(tests, params).collect()}
    assert got.keys() == want.keys() and any(v is None for v in want.values()) and any(v is not None for v in want.values())
    for k, v in want.items():
        assert got[k]["pred"] == (v if v is None else pytest.approx(v, abs=1e-9)) and (got[k]["err"] is None) == (v is None)


def test_errors_keep_no_cache_of_one_partition_for_each_series(spark, panel):
    plan = evaluate.errors(panel.localCheckpoint(), SETTINGS)._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan


def test_losses_are_shuffled_in_the_quantiles_bucket_only(spark):
    rows = spark.range(40_000).select(F.lit("a").alias("series"), F.lit("m").alias("method"), (F.col("id") / 7 + 1).alias("err"))
    tail = metrics.cvar(rows, (0.05,))
    k, losses = 2000, np.sort(np.arange(40_000) / 7 + 1)[::-1]
    assert tail.first()[2] == pytest.approx(losses[:k].mean(), rel=1e-12)
    found = [n for n in _shuffled(tail._jdf.queryExecution().executedPlan())]
    assert found and max(found) < 20_000  # all 40,000 before


def _shuffled(node) -> list[int]:
    """Rows that each exchange of an executed plan wrote."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _shuffled(node.executedPlan())
    if name.endswith("QueryStageExec"):
        return _shuffled(node.plan())
    own = [node.metrics().apply("shuffleRecordsWritten").value()] if name == "ShuffleExchangeExec" else []
    return own + [n for k in range(node.children().size()) for n in _shuffled(node.children().apply(k))]


@pytest.mark.parametrize("first,last", [(1, 1), (1, 13), (4, 11), (1, 64), (3, 2)])
def test_sliding_sums_equal_frames_and_use_none(spark, first, last):
    from tideweave.operators.windows import sliding_sums

    w = Window.partitionBy("series").orderBy("t")
    v = F.when(F.col("t") % 5 < 2, F.lit(None)).otherwise(F.col("t") * F.lit(1.5))
    rows = sliding_sums(spark.range(1, 41).select(F.lit("a").alias("series"), F.col("id").alias("t")), w, {"s": v}, first, last)
    for r in rows.collect():
        own = [1.5 * t for t in range(max(1, r["t"] - last), r["t"] - first + 1) if t % 5 >= 2]
        assert r["s"] == (sum(own) if own else None)
    weights = online.exponential_weights(rows.select("series", "t", F.array(F.lit(1.0), "t", "t").alias("x"), F.col("t").alias("y")), 2, 40)
    assert "-40, -1" not in weights._jdf.queryExecution().analyzed().toString()
