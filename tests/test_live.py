"""Live operators on streams: equal to batch, late rows kept, restarts from a checkpoint."""

import datetime
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideweave.operators import online, segments
from tideweave.streaming import ordered

BASE = datetime.datetime(2024, 1, 1)
FORECASTS, LABELS = "series string, t long, x array<double>, ts timestamp", "series string, t long, y double, ts timestamp"


def at(seconds):
    return BASE + datetime.timedelta(seconds=float(seconds))


def put(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


@pytest.fixture(scope="module")
def panel():
    r = np.random.default_rng(7)
    return [(s, t, [1.0, *map(float, r.normal(size=3))], float(r.normal())) for s in ("a", "b") for t in range(1, 25)]


def files(spark, tmp_path, panel, delay, cuts=((1, 12), (13, 24)), shuffle=False):
    """Forecasts and labels in two files each; a label comes `delay` rows after its forecast, just before that row's."""
    r = np.random.default_rng(1)
    for low, high in cuts:
        f = [(s, t, x, at(t)) for s, t, x, _ in panel if low <= t <= high]
        lab = [(s, t, y, at(t + delay)) for s, t, _, y in panel if low <= t + delay <= high]
        put(spark, [f[k] for k in (r.permutation(len(f)) if shuffle else range(len(f)))], FORECASTS, tmp_path / "f")
        put(spark, lab or [("a", -1, 0.0, at(low))], LABELS, tmp_path / "l")


def beat(spark, tmp_path, second):
    """Rows of another series that move the watermarks on."""
    put(spark, [("beat", second, [1.0, 0.0, 0.0, 0.0], at(second))], FORECASTS, tmp_path / "f")
    put(spark, [("beat", -second, 0.0, at(second))], LABELS, tmp_path / "l")


def streams(spark, tmp_path):
    read = lambda schema, d: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / d))
    return read(FORECASTS, "f"), read(LABELS, "l")


def run(df, name, tmp_path):
    ordered.rocksdb_state(df.sparkSession)
    q = df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.read.parquet(str(tmp_path / name)).filter("series <> 'beat'").collect()


@pytest.mark.parametrize("delay", [1, 3])
def test_late_labels_give_what_batch_gives(spark, tmp_path, panel, delay):
    files(spark, tmp_path, panel, delay, shuffle=True)
    beat(spark, tmp_path, 400)
    beat(spark, tmp_path, 500)
    got = run(ordered.live_learner(*streams(spark, tmp_path), ordered.PassiveAggressive(0.05)), "pa", tmp_path)
    forecast = {(r["series"], r["t"]): np.array(r["beta"]) for r in got if r["kind"] == "forecast"}
    assert len(forecast) == len(panel)
    frame = spark.createDataFrame(panel, "series string, t long, x array<double>, y double")
    # the first row of a batch run only sets the start (with a delay, its target doesn't count): give it one that precedes the stream's
    limits = spark.createDataFrame([(s, 0, 24) for s in "ab"], "series string, first long, end long")
    want = {(r["series"], r["t"]): r["beta"] for r in online.passive_aggressive(frame, 0.05, limits, delay).collect()}
    assert forecast.keys() == want.keys() and all(np.allclose(forecast[k], want[k], atol=1e-12) for k in want)
    scored = {(r["series"], r["t"]): (r["pred"], r["y"]) for r in got if r["kind"] == "scored"}
    assert len(scored) == len([p for p in panel if p[1] + delay <= 24])
    for s, t, x, y in panel:
        if (s, t) in scored:
            assert scored[s, t][1] == y and abs(scored[s, t][0] - forecast[s, t] @ x) < 1e-12


def test_exponential_weights_with_delay_equal_batch(spark, tmp_path, panel):
    files(spark, tmp_path, panel, 3)
    beat(spark, tmp_path, 400)
    beat(spark, tmp_path, 500)
    got = run(ordered.live_learner(*streams(spark, tmp_path), ordered.Exponential(8)), "hedge", tmp_path)
    forecast = {(r["series"], r["t"]): r["beta"] for r in got if r["kind"] == "forecast"}
    frame = spark.createDataFrame(panel, "series string, t long, x array<double>, y double")
    want = {(r["series"], r["t"]): r["beta"] for r in online.exponential_weights(frame, 3, 8, 3).collect()}
    assert forecast.keys() == want.keys() and all(np.allclose(forecast[k], want[k], atol=1e-12) for k in want)


def test_late_rows_have_an_output_of_their_own_and_none_vanish(spark, tmp_path, panel):
    files(spark, tmp_path, panel, 1, cuts=((1, 24),))
    beat(spark, tmp_path, 400)
    beat(spark, tmp_path, 401)  # the watermark is past 24 by now
    put(spark, [("a", 25, [1.0] * 4, at(10))], FORECASTS, tmp_path / "f")
    put(spark, [("a", 24, 9.0, at(11))], LABELS, tmp_path / "l")
    beat(spark, tmp_path, 500)
    beat(spark, tmp_path, 600)
    live = ordered.live_learner(*streams(spark, tmp_path), ordered.PassiveAggressive(0.05))
    got = run(live, "late", tmp_path)
    kinds = sorted(r["kind"] for r in got)
    count = {k: len(list(g)) for k, g in itertools.groupby(kinds)}
    assert count["late_forecast"] == 1 and count["late_label"] == 1
    assert count["forecast"] == 48 and count["scored"] == 46
    fine, late = ordered.outputs(spark.read.parquet(str(tmp_path / "late")))
    assert sorted((r["t"], r["kind"]) for r in late.collect()) == [(24, "late_label"), (25, "late_forecast")] and fine.count() + 2 == spark.read.parquet(str(tmp_path / "late")).count()


def test_a_stopped_stream_goes_on_from_its_checkpoint(spark, tmp_path, panel):
    (whole := tmp_path / "whole").mkdir()
    (parts := tmp_path / "parts").mkdir()
    files(spark, whole, panel, 3)
    beat(spark, whole, 400)
    beat(spark, whole, 500)
    want = run(ordered.live_learner(*streams(spark, whole), ordered.PassiveAggressive(0.05)), "pa", whole)
    files(spark, parts, panel, 3, cuts=((1, 12),))
    first = run(ordered.live_learner(*streams(spark, parts), ordered.PassiveAggressive(0.05)), "pa", parts)
    files(spark, parts, panel, 3, cuts=((13, 24),))
    beat(spark, parts, 400)
    beat(spark, parts, 500)
    got = run(ordered.live_learner(*streams(spark, parts), ordered.PassiveAggressive(0.05)), "pa", parts)
    row = lambda r: (r["series"], r["kind"], r["t"], r["pred"], r["y"])
    assert len(first) < len(got) and sorted(map(row, got), key=repr) == sorted(map(row, want), key=repr)


def test_live_storms_equal_batch_storms(spark, tmp_path):
    r = np.random.default_rng(3)
    rows = []
    for s in ("a", "b"):
        hour = 0
        for t in range(1, 40):
            hour += int(r.choice([6, 6, 6, 6, 12, 30]))
            when = BASE + datetime.timedelta(hours=hour)
            rows.append((s, t, when.day, when.hour, when))
    schema = "series string, t long, days int, hours int, ts timestamp"
    order = r.permutation(len(rows))
    for part in (sorted(order[:30], key=lambda k: rows[k][4]), order[30:]):
        put(spark, [rows[k] for k in part], schema, tmp_path / "in")
    for k in (400, 420, 440):
        put(spark, [("beat", k, 1, 0, BASE + datetime.timedelta(days=k))], schema, tmp_path / "in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(ordered.live_storms(source, 5 * 24 * 3_600_000, allowed="365 days"), "storms", tmp_path)
    batch = segments.storms(spark.createDataFrame(rows, schema))
    want = {(x["series"], x["t"]): (x["storm"], x["k"], x["length"]) for x in batch.collect()}
    assert {(x["series"], x["t"]): (x["storm"], x["k"], x["length"]) for x in got} == want  # the timer ends the last ones


def test_the_rule_for_one_row_is_the_rule_for_all(spark):
    grid = [(f"{k}", t, d, h) for k, (p, q, d2, h2) in enumerate(itertools.product((1, 2, 3, 30), (0, 6, 12, 18), (1, 2, 3, 4, 30, 31), (0, 6, 12, 18))) for t, d, h in ((1, p, q), (2, d2, h2))]
    found = segments.storms(spark.createDataFrame(grid, "series string, t long, days int, hours int")).filter(F.col("t") == 2).collect()
    first = {s: (d, h) for s, t, d, h in grid if t == 1}
    for r in found:
        assert segments.starts_storm(*first[r["series"]], r["days"], r["hours"]) == (r["storm"] == 2), r
