"""Queries over all rows of their tables, on a small table of events."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideweave.operators import online
from tideweave.plans import catalog


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """The folder of a table of events: two types of 607 rows, so 600 rows of panel, 300 of training, 299 of test each."""
    r, start, rows = np.random.default_rng(5), datetime.datetime(2024, 1, 1), []
    for k in range(1214):
        rows.append((k, k % 7, start + datetime.timedelta(minutes=30 * k), "ab"[k % 2], float(5 + r.normal())))
    d = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{d}/events.parquet")
    return d


def test_all_rows_after_training_are_scored(spark, events):
    q = catalog.queries()
    report = q["all_methods_report"](spark, events).collect()
    assert {r["series"] for r in report} == {"a", "b"} and {r["n"] for r in report} == {299, 298}  # 298: the last value has no first row
    assert {r["n"] for r in q["metrics_mae_mape_rmse_r2_all"](spark, events).collect()} == {299, 298}
    assert q["split_test_all"](spark, events).count() == 2 * 299
    spark.catalog.clearCache()


@pytest.mark.parametrize("delay,name", [(1, "pa_path_all"), (4, "pa_delayed_all")])
def test_passive_aggressive_over_the_whole_test(spark, events, delay, name):
    rows = catalog._std(spark, events, catalog.WHOLE).select("series", "t", "x", "y", "split", "end").toPandas()
    want = {}
    for s, part in rows.groupby("series"):
        part = part.set_index("t").sort_index()
        split, w = int(part["split"].iloc[0]), np.full(7, 1 / 7)
        for t in range(split + 2, len(part) + 1):
            k = t - delay
            if k >= split + 1 + (delay > 1):
                w = online.passive_aggressive_step(w, np.array(part["x"][k]), part["y"][k], 0.01)
            want[s, t] = w
    got = {(r["series"], r["t"]): np.array([r[f"w{k}"] for k in range(7)]) for r in catalog.queries()[name](spark, events).collect()}
    assert got.keys() == want.keys() and len(got) == 2 * 299
    assert all(np.abs(got[k] - want[k]).max() < 1e-5 for k in want)


@pytest.mark.parametrize("delay", [1, 4])
def test_weights_of_all_earlier_rows_equal_a_frame_of_all_rows(spark, events, delay):
    rows = catalog._std(spark, events, catalog.WHOLE).filter("t >= first")
    a, b = (online.exponential_weights(rows, 6, h, delay).select("series", "t", F.col("beta")).toPandas().sort_values(["series", "t"]) for h in (None, 1000))
    assert len(a) == len(b) > 0 and np.abs(np.stack(a["beta"]) - np.stack(b["beta"])).max() < 1e-9


def test_columns_by_mean_keeps_all_series(spark, tmp_path):
    rows = [(k, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=k), "abc"[k % 3], float(k)) for k in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    out = catalog.queries()["columns_by_mean_all"](spark, str(tmp_path))
    assert out.columns == ["t", "m3", "m5"] and out.count() == 3 * 13
    assert catalog.queries()["columns_by_mean"](spark, str(tmp_path)).count() == 2 * 13  # as its SQL says


def test_storms_are_of_users_and_keep_all_records(spark, events):
    out = catalog.queries()["storm_segments_all"](spark, events).toPandas()
    assert len(out) == 1214 and set(out["series"]) == {str(k) for k in range(7)}
    assert (out.groupby(["series", "storm"]).size() == out.groupby(["series", "storm"])["length"].first()).all()


def test_grid_scores_equal_row_by_row_scores(spark, events, monkeypatch):
    from dataclasses import replace

    from tideweave.operators import metrics
    from tideweave.plans import evaluate
    from tideweave.sources.panels import panel

    monkeypatch.setattr(evaluate, "SCORED", 70)
    p, s = panel(spark, events), catalog.WHOLE
    got = {(r["series"], r["param_combo"]): r for r in evaluate.grid_scores(p, s.split, [5, 206, 500]).collect()}
    assert len(got) == 6
    for k in (5, 206):
        own = evaluate.setting_of(k, s)
        rows = evaluate.relevant(catalog.prep.standardised(p, own.split), own.split)
        errors = evaluate.adaptive_errors(rows, own).filter("method = 'adaptive_ridge_exact'").groupBy("series").agg(metrics.mae(F.col("err")).alias("a"), metrics.rmse(F.col("err")).alias("b"), F.count("*").alias("n"))
        for r in errors.collect():
            have = got[r["series"], k]
            assert have["n"] == r["n"] and abs(have["mae"] - r["a"]) < 1e-6 and abs(have["rmse"] - r["b"]) < 1e-6
    assert replace(s, members=6) == s


def test_robust_fits_of_the_panel_are_certified(spark, events):
    for name in ("robust_learners", "adaptive_lad"):
        rows = catalog.queries()[name](spark, events).collect()
        assert rows and all(r["certified"] and r["error"] is None and r["objective"] > 0 for r in rows), rows
