"""Evaluation of all learners without look-ahead: standardise, train once, score every test row."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideweave.operators import learners, metrics, online
from tideweave.operators.lags import lag_matrix, storm_lags
from tideweave.operators.learners import Penalty
from tideweave.operators.prep import Split, standardised, testing, training
from tideweave.operators.reporting import PASTS, RHOS, combo
from tideweave.operators.segments import long_storms, renumbered
from tideweave.sources.rounds import written

METHODS = (
    "mean", "last_timestep", "best_model", "bandits_full", "bandits_recent", "PA", "ridge",
    "adaptive_ridge_exact", "adaptive_ridge_standard", "adaptive_ridge_exact_err_rule", "adaptive_ridge_standard_err_rule",
)


@dataclass(frozen=True)
class Settings:
    """split; penalties; members: how many forecasts a row has; lead: steps until a target is known;
    best_with_intercept counts the constant forecast among the members of best_model."""

    split: Split = field(default_factory=Split)
    penalty: Penalty = field(default_factory=Penalty)
    members: int = 6
    lead: int = 1
    epsilon: float | None = None
    best_with_intercept: bool = False

    @property
    def margin(self) -> float:
        return self.penalty.rho_beta if self.epsilon is None else self.epsilon


def relevant(rows: DataFrame, split: Split) -> DataFrame:
    """Rows that training or testing can look at: from the training's first row, less the lags."""
    return rows.filter(F.col("t") >= F.col("first") - split.past).filter("t <= end")


def expanding(split: Split) -> int | None:
    """Rows that cover training and test together; None for all."""
    return None if split.val is None else split.history + split.val + 1


def with_lags(rows: DataFrame, settings: Settings, rule: str) -> DataFrame:
    """Rows with z; training rows count from the first one whose lags lie within training."""
    return lag_matrix(rows, settings.split.past, rule, settings.lead)


class Clock:
    """Milliseconds that each learner's fit of all series took; fits are written to the shared folder, so that scoring doesn't fit again."""

    def __init__(self):
        self.elapsed: dict[str, int] = {}

    def fitted(self, method: str, fit: Callable[[], DataFrame]) -> DataFrame:
        began = time.perf_counter()
        params = written(fit(), "params")
        self.elapsed[method] = round(1000 * (time.perf_counter() - began))
        return params


def adaptive_params(rows: DataFrame, settings: Settings, rule: str = "value", suffix: str = "", clock: Clock | None = None) -> DataFrame:
    """Parameters of the two adaptive methods on the lag vectors of a rule; with a clock each is a fit of its own."""
    p = settings.penalty
    data = training(with_lags(rows, settings, rule)).filter(F.col("t") >= F.col("first") + settings.split.past + settings.lead - 1)
    data = data.select("series", "x", "y", "z")
    fits = [(f"adaptive_ridge_exact{suffix}", p), (f"adaptive_ridge_standard{suffix}", Penalty(0.0, p.rho, p.rho_v))]
    if clock is None:
        return learners.adaptive_ridge(data, fits)
    return reduce(DataFrame.unionByName, [clock.fitted(m, lambda f=(m, q): learners.adaptive_ridge(data, [f])) for m, q in fits])


def z_width(settings: Settings, constant: bool = False) -> int:
    """1 + |z|."""
    return 1 + settings.split.past * (settings.members + 1) + settings.split.past + constant


def adaptive_errors(rows: DataFrame, settings: Settings, rule: str = "value", suffix: str = "", clock: Clock | None = None) -> DataFrame:
    params = adaptive_params(rows, settings, rule, suffix, clock)
    return online.adaptive_errors(testing(with_lags(rows, settings, rule)), params)


def best_errors(tests: DataFrame, settings: Settings) -> DataFrame:
    """Errors of each series' best member in hindsight."""
    each = metrics.member_errors(tests, 1 if settings.best_with_intercept else 2)
    best = metrics.best_member(each).select("series", "model")
    own = each.join(best, ["series", "model"])
    return own.select("series", "t", F.lit("best_model").alias("method"), "y", (F.col("y") - F.col("err")).alias("pred"), "err")


def errors(panel: DataFrame, settings: Settings, clock: Clock | None = None) -> DataFrame:
    """series, t, method, y, pred, err of every method on every test row; a clock takes the times of the fits."""
    split = settings.split
    # every learner reads this stretch of each series; a cache would keep the join's partitions, one for each series
    rows = written(relevant(standardised(panel, split), split), "rows")
    tests = testing(rows)
    members = settings.members
    full = testing(online.exponential_weights(rows, members, split.history))
    recent = testing(online.exponential_weights(rows, members, split.past - 1)) if split.past > 1 else None
    limits = rows.select("series", (F.col("split") + 1).alias("first"), "end").distinct()
    pa = tests.join(online.passive_aggressive(rows.select("series", "t", "x", "y"), settings.margin, limits), ["series", "t"])
    fit = lambda: learners.ridge(training(rows), settings.penalty.rho)
    params = fit() if clock is None else clock.fitted("ridge", fit)
    ridge = tests.join(params.select("series", F.col("theta").alias("beta")), "series")
    last = testing(online.persistence(rows)).filter(F.col("t") > F.col("split") + 2)
    parts = [
        online.ensemble_mean(tests),
        online.errors_of(last, "last_timestep", F.col("last")),
        best_errors(tests, settings),
        online.weighted(full, "bandits_full", True),
        *([online.weighted(recent, "bandits_recent", True)] if recent is not None else []),
        online.weighted(pa, "PA"),
        online.weighted(ridge, "ridge"),
        adaptive_errors(rows, settings, clock=clock),
        adaptive_errors(rows, settings, "error", "_err_rule", clock),
    ]
    return reduce(DataFrame.unionByName, parts)


def report(panel: DataFrame, settings: Settings, clock: Clock | None = None) -> DataFrame:
    """series, method, n, mae, mape, rmse, r2, cvar_05, cvar_15."""
    return metrics.report(errors(panel, settings, clock))


def results_table(panel: DataFrame, settings: Settings, clock: Clock | None = None) -> DataFrame:
    """The 19 columns of the results table; Time has the milliseconds of the methods that are fitted (a job over all series each), 0 for
    the others."""
    clock = clock or Clock()
    p, s = settings.penalty, settings.split
    sizes = panel.groupBy("series").agg(F.max("t").alias("n"))
    half = F.floor(F.col("n") * s.fraction)
    rows = report(panel, settings, clock).withColumnRenamed("n", "n_test").join(sizes, "series")
    elapsed = reduce(lambda c, m: c.when(F.col("method") == m[0], F.lit(m[1])), clock.elapsed.items(), F.when(F.lit(False), F.lit(0))).otherwise(0)
    d = lambda v: F.lit(float(v))
    return rows.select(
        F.col("series").alias("Dataset"), (F.least(F.lit(s.history), half) + 1).cast("long").alias("Train_Length"), F.col("n_test").alias("Test_Length"),
        F.lit(settings.members + 1).cast("long").alias("End_id"),
        d(p.rho_beta).alias("Rho_beta"), d(p.rho).alias("Rho"), d(p.rho_v).alias("Rho_V"), d(s.past).alias("Past"), d(s.num_past).alias("Num_past"),
        d(-1 if s.val is None else s.val).alias("Val"), d(s.fraction).alias("Train_test_split"), F.col("method").alias("Method"),
        F.col("mae").alias("MAE"), F.col("mape").alias("MAPE"), F.col("rmse").alias("RMSE"), F.col("r2").alias("R2"),
        F.col("cvar_05").alias("CVAR_05"), F.col("cvar_15").alias("CVAR_15"), elapsed.cast("long").alias("Time"),
    )


def setting_of(index: int, settings: Settings) -> Settings:
    """The settings, with the penalties and the length of the lags of a number of the grid in place of their own."""
    rho_beta, rho, rho_v, past = combo(index)
    return replace(settings, penalty=Penalty(rho_beta, rho, rho_v), split=replace(settings.split, past=past))


#: Test rows that one task scores, for all penalties at once.
SCORED = 20_000


def grid_scores(panel: DataFrame, split: Split, indexes: list[int] | None = None, members: int = 6) -> DataFrame:
    """series, param_combo, n, mae, rmse of the adaptive ridge for numbers of the grid (None: all 500), for every series.

    Settings that differ in penalties only share the Gram matrix and the lag vectors: for each length of the lags one pass over the
    training rows serves all fits, and one over the test rows all scores, as a product of features and weights; a task gives sums of
    errors, not errors. Test rows of a series are dealt out in stretches of SCORED rows, each with the series' weights.
    """
    chosen = {k: combo(k) for k in (indexes or range(1, len(RHOS) ** 3 * len(PASTS) + 1))}
    out = []
    for past in sorted({c[3] for c in chosen.values()}):
        s = Settings(replace(split, past=past), members=members)
        fits = [(str(k), Penalty(*c[:3])) for k, c in chosen.items() if c[3] == past]
        lagged = with_lags(relevant(standardised(panel, s.split), s.split), s, "value")
        data = training(lagged).filter(F.col("t") >= F.col("first") + past)
        params = learners.adaptive_ridge(data.select("series", "x", "y", "z"), fits).select("series", "method", "theta")
        stretch = F.floor(F.col("t") / SCORED).cast("int")
        rows = testing(lagged).select("series", stretch.alias("stretch"), "x", "z", "y_true", "mu", "sigma")
        parts = rows.select(F.col("series").alias("of"), F.col("stretch").alias("at")).distinct()
        weights = params.join(parts, F.col("series") == F.col("of")).select("of", "at", "method", "theta")
        sums = rows.groupBy("series", "stretch").cogroup(weights.groupBy("of", "at")).applyInArrow(_score, SCORES)
        total = sums.groupBy("series", "param_combo").agg(F.sum("n").alias("n"), F.sum("absolute").alias("a"), F.sum("square").alias("q"))
        out.append(total.select("series", "param_combo", "n", F.try_divide("a", "n").alias("mae"), F.sqrt(F.try_divide("q", "n")).alias("rmse")))
    return reduce(DataFrame.unionByName, out)


SCORES = "series string, param_combo int, n long, absolute double, square double"


def _score(key: tuple, rows: pa.Table, params: pa.Table) -> pa.Table:
    """Sums of errors of a stretch of test rows, for all weights of its series."""
    n = rows.num_rows
    if not n or not params.num_rows:
        return pa.table({"series": pa.array([], pa.string()), "param_combo": pa.array([], pa.int32()), "n": pa.array([], pa.int64()), "absolute": pa.array([], pa.float64()), "square": pa.array([], pa.float64())})
    flat = lambda t, c: np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in t.column(c).chunks]).reshape(t.num_rows, -1)
    x, z, theta = flat(rows, "x"), flat(rows, "z"), flat(params, "theta")
    w = np.column_stack([np.ones(n), z])
    y, mu, sigma = (rows.column(c).to_numpy() for c in ("y_true", "mu", "sigma"))
    absolute, square = np.zeros(len(theta)), np.zeros(len(theta))
    for low in range(0, n, 2048):
        part = slice(low, low + 2048)
        f = (x[part, :, None] * w[part, None, :]).reshape(len(x[part]), -1)
        err = y[part, None] - ((f @ theta.T) * sigma[part, None] + mu[part, None])
        absolute += np.abs(err).sum(axis=0)
        square += (err * err).sum(axis=0)
    names = params.column("method").to_pylist()
    return pa.table({
        "series": pa.array([key[0].as_py()] * len(names), pa.string()), "param_combo": pa.array([int(m) for m in names], pa.int32()),
        "n": pa.array([n] * len(names), pa.int64()), "absolute": pa.array(absolute), "square": pa.array(square),
    })


def storm_errors(rows: DataFrame, settings: Settings, delay: int = 4) -> DataFrame:
    """The eight methods on storms, whose targets are known `delay` rows later.

    rows: series, t, days, hours, current_speed, x, y. Storms shorter than the lags go; the others follow one another.
    Each step is written and read back: persisted, its plan would stand in every later plan once for each use.
    """
    past = settings.split.past
    laid = long_storms(rows, past)
    lagged = storm_lags(laid, past)
    lagged = written(renumbered(lagged.drop("t", "pos"), "t"), "storms")
    split = settings.split
    std = standardised(lagged, split)
    std = written(std.withColumn("z", F.transform("z", lambda v: F.try_divide(v - F.col("mu"), F.col("sigma")))), "rows")
    tests, train = testing(std), training(std)
    p = settings.penalty
    params = learners.adaptive_ridge(train.select("series", "x", "y", "z"), [("adaptive_ridge_exact", p), ("adaptive_ridge_standard", Penalty(0.0, p.rho, p.rho_v))])
    bandits = testing(online.exponential_weights(std.filter("t >= first AND t <= end"), settings.members, expanding(split), delay))
    equal = F.array_repeat(F.lit(1.0 / settings.members), settings.members)
    bandits = bandits.withColumn("beta", F.when(F.col("t") - F.col("split") - 1 < delay + 1, equal).otherwise(F.col("beta")))
    limits = std.select("series", (F.col("split") + 1).alias("first"), "end").distinct()
    pa = tests.join(online.passive_aggressive(std.select("series", "t", "x", "y"), settings.margin, limits, delay), ["series", "t"])
    ridge = tests.join(learners.ridge(train, settings.penalty.rho_beta).select("series", F.col("theta").alias("beta")), "series")
    last = tests.filter(F.col("t") > F.col("split") + 2)
    adaptive = online.adaptive_errors(tests, params)
    parts = [
        online.ensemble_mean(tests), best_errors(tests, settings), online.weighted(bandits, "bandits_full", True),
        online.errors_of(last, "last_timestep", F.element_at("z", -1)), online.weighted(pa, "PA"), online.weighted(ridge, "ridge"), adaptive,
    ]
    return reduce(DataFrame.unionByName, parts)

