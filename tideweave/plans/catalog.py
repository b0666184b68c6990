"""Registry of the engine's queries and of their SQL twins. Doubles are rounded to six places on both sides."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideweave.functions import vectors as V
from tideweave.operators import adversary, features, learners, metrics, online, prep, reporting, robust, robust_rounds, segments, slow_lad, synthetic
from tideweave.operators.lags import lag_matrix, storm_lags
from tideweave.operators.learners import Penalty
from tideweave.operators.prep import Split
from tideweave.operators.windows import dense_index
from tideweave.plans import evaluate, sql
from tideweave.plans.evaluate import Settings
from tideweave.sources import trained
from tideweave.sources.panels import MEMBERS, orders_panel, panel, table, to_panel, wide_panel
from tideweave.streaming import ordered

FLAGSHIP = "all_methods_report"
SETTINGS = Settings()
SPLIT = SETTINGS.split
#: The reference's defaults: all rows after training are scored, and training has past * 100 rows.
WHOLE = Settings(Split(num_past=100, val=None))

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, without negative zeros."""
    return df.select(*((F.round(F.col(f"`{c}`"), 6) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def query(text: str | None = None, whole: bool = False):
    """Registers a function under its name, with its SQL twin if there is one.

    whole: also registers NAME_all, the same over the split of WHOLE; its twin, unless recursive (too slow over whole
    series), has the bounds of WHOLE. For storms it is the same over the records of every user.
    """

    def register(f: Callable[..., DataFrame]):
        _QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if text:
            _SQL[f.__name__] = text
        if whole:
            _QUERIES[f"{f.__name__}_all"] = lambda spark, sf_dir: rounded(f(spark, sf_dir, WHOLE))
            if text and "RECURSIVE" not in text:
                _SQL[f"{f.__name__}_all"] = text.replace(sql.BASE, sql.WHOLE).replace(sql.storms(), sql.user_storms()).replace(f" {SPLIT.history} PRECEDING", f" {WHOLE.split.history} PRECEDING")
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _std(spark, d, s=SETTINGS):
    return prep.standardised(panel(spark, d), s.split)


def _relevant(spark, d, s=SETTINGS):
    return evaluate.relevant(_std(spark, d, s), s.split)


def _flat(df: DataFrame, name: str, n: int, alias: str) -> list:
    return [F.get(name, F.lit(k)).alias(f"{alias}{k + 1}") for k in range(n)]


# --- scans, projections, filters ---------------------------------------------------------------------------------


@query(f"WITH {sql.PANEL} SELECT series, t, {_r('y', *sql.MEMBERS)} FROM panel")
def panel_events(spark, d):
    return wide_panel(spark, d)


@query("""WITH daily AS (SELECT o_orderpriority AS series, date_trunc('day', o_orderdate) AS day, sum(o_totalprice) AS y FROM orders GROUP BY ALL),
raw AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY day) AS t, y FROM daily)
SELECT series, t - 7 AS t, round(y, 6) AS y, round(m1, 6) AS m1, round(m3, 6) AS m3, round(m6, 6) AS m6 FROM (SELECT series, t, y, lag(y) OVER (PARTITION BY series ORDER BY t) AS m1,
  avg(y) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS m3,
  avg(y) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m6 FROM raw) WHERE t > 7""")
def panel_orders(spark, d):
    return orders_panel(spark, d).select("series", "t", "y", "m1", "m3", "m6")


@query(f"WITH {sql.PANEL} SELECT m1 AS m1, round(m2, 6) AS m2, round(m3, 6) AS m3 FROM panel")
def scan_project_clamp(spark, d):
    return prep.project_range(wide_panel(spark, d), 4, 6)


@query(f"WITH {sql.PANEL} SELECT series, t, round(y, 6) AS y, CAST(1 AS DOUBLE) AS intercept FROM panel WHERE t BETWEEN 50 AND 120")
def slice_constant_drop(spark, d):
    return prep.add_constant(prep.drop_columns(prep.rows_between(wide_panel(spark, d), 50, 120), list(MEMBERS)))


@query(f"WITH {sql.PANEL} SELECT series, t, CASE WHEN y > m3 THEN round(y, 6) END AS y, m4 = m1 AS at_low FROM panel")
def masked_values(spark, d):
    return prep.masked(wide_panel(spark, d), "y", F.col("y") > F.col("m3")).select("series", "t", "y", (F.col("m4") == F.col("m1")).alias("at_low"))


@query(f"WITH {sql.PANEL} SELECT t, round(m3, 6) AS m3, round(m5, 6) AS m5 FROM panel WHERE series IN (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 2)")
def columns_by_mean(spark, d):
    first = table(spark, d, "events").select(F.col("event_type").alias("series")).distinct().orderBy("series").limit(2)
    kept = columns_by_mean_all(spark, d, series=True)
    return kept.join(F.broadcast(first), "series", "left_semi").drop("series")


@query(f"WITH {sql.PANEL} SELECT t, round(m3, 6) AS m3, round(m5, 6) AS m5 FROM panel")
def columns_by_mean_all(spark, d, series=False):
    wide = wide_panel(spark, d)
    kept = prep.columns_with_mean_above(wide.withColumn("none", F.lit(-2e6)), ["m3", "m5", "none"], -1e6)
    return wide.select(*(["series"] if series else []), "t", *kept)


_GAPS = "raw AS (SELECT event_type AS series, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS t, value AS y, event_id FROM events), g AS (SELECT series, t, CASE WHEN event_id % 7 IN (2, 3) THEN NULL ELSE y END AS y, CASE WHEN event_id % 40 <> 5 THEN y END AS y2 FROM raw)"


def _gaps(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("series"), "ts", "event_id", F.col("value").alias("y"))
    rows = dense_index(rows, ["series"], ["ts", "event_id"])
    gap = F.when(~(F.col("event_id") % 7).isin(2, 3), F.col("y"))
    return rows.select("series", "t", gap.alias("y"), F.when(F.col("event_id") % 40 != 5, F.col("y")).alias("y2"))


@query(f"WITH {_GAPS} SELECT 'y' AS \"column\", count(*) - count(y) AS n_null FROM g UNION ALL SELECT 'y2', count(*) - count(y2) FROM g")
def null_profile(spark, d):
    return prep.null_profile(_gaps(spark, d), ["y", "y2"])


@query(f"WITH {_GAPS} SELECT series, t, round(y2, 6) AS y2 FROM g WHERE t >= 50")
def dense_columns(spark, d):
    gaps = _gaps(spark, d)
    return gaps.select("series", "t", *prep.dense_columns(gaps, ["y", "y2"])).filter("t >= 50")


@query(f"""WITH {_GAPS},
e AS (SELECT series, t, y, max(CASE WHEN y IS NOT NULL THEN t END) OVER (PARTITION BY series ORDER BY t) AS t0,
  min(CASE WHEN y IS NOT NULL THEN t END) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1 FROM g)
SELECT e.series, e.t, round(CASE WHEN t0 IS NULL THEN NULL WHEN e.y IS NOT NULL THEN e.y WHEN t1 IS NULL THEN a.y ELSE a.y + (b.y - a.y) * (e.t - t0) / (t1 - t0) END, 6) AS filled
FROM e LEFT JOIN g a ON a.series = e.series AND a.t = t0 LEFT JOIN g b ON b.series = e.series AND b.t = t1""")
def interpolate_linear(spark, d):
    return prep.interpolated(_gaps(spark, d)).select("series", "t", "filled")


# --- splits and scaling --------------------------------------------------------------------------------------------

_STD = "series, t, round(y, 6) AS y, round(m1, 6) AS m1, round(m6, 6) AS m6, round(mu, 6) AS mu, round(sigma, 6) AS sigma"


def _std_columns(df):
    return df.select("series", "t", "y", F.get("x", F.lit(1)).alias("m1"), F.get("x", F.lit(6)).alias("m6"), "mu", "sigma")


@query(f"WITH {sql.BASE} SELECT {_STD} FROM std")
def standardize_samp(spark, d):
    return _std_columns(_std(spark, d))


@query(f"WITH {sql.PANEL}, {sql.bounds()}, {sql.standardised('stddev_pop')} SELECT {_STD} FROM std")
def standardize_pop(spark, d):
    return _std_columns(prep.standardised(panel(spark, d), SPLIT, population=True))


@query(f"WITH {sql.PANEL}, {sql.bounds()} SELECT series, n, split, first, last, end_ AS end FROM lim")
def split_bounds(spark, d):
    return prep.bounds(panel(spark, d), SPLIT).select("series", "n", "split", "first", "last", "end")


@query(f"WITH {sql.BASE} SELECT series, t, round(y, 6) AS y FROM std WHERE t BETWEEN first AND last", whole=True)
def split_train(spark, d, s=SETTINGS):
    return prep.training(_std(spark, d, s)).select("series", "t", "y")


@query(f"WITH {sql.BASE} SELECT series, t, round(y, 6) AS y FROM std WHERE t > split + 1 AND t <= end_", whole=True)
def split_test(spark, d, s=SETTINGS):
    return prep.testing(_std(spark, d, s)).select("series", "t", "y")


@query(f"WITH {sql.PANEL}, {sql.bounds(val=1 << 40)} SELECT series, count(*) AS n_test FROM panel JOIN lim USING (series) WHERE t > split + 1 AND t <= end_ GROUP BY series")
def split_all_remaining(spark, d):
    rows = prep.standardised(panel(spark, d), Split(val=None))
    return prep.testing(rows).groupBy("series").agg(F.count("*").alias("n_test"))


@query(f"WITH {sql.PANEL}, s AS (SELECT avg(m1) AS a1, stddev_pop(m1) AS b1, avg(m6) AS a6, stddev_pop(m6) AS b6 FROM panel WHERE t <= 100) SELECT series, t, round((m1 - a1) / b1, 6) AS m1, round((m6 - a6) / b6, 6) AS m6 FROM panel, s")
def scaler_train(spark, d):
    return prep.scale(wide_panel(spark, d).select("series", "t", "m1", "m6"), ["m1", "m6"], F.col("t") <= 100)


@query("SELECT event_id, CASE WHEN CAST('0x' || md5('7:' || event_id)[1:8] AS BIGINT) % 10000 < 8000 THEN 'train' ELSE 'test' END AS part FROM events")
def random_split(spark, d):
    return prep.random_split(table(spark, d, "events").select("event_id"), "event_id", 0.8, 7)


@query(f"WITH {sql.PANEL} SELECT series, t, round(y - 0.1 * abs(y), 6) AS d_min, round(y + 0.1 * abs(y), 6) AS d_max FROM panel")
def uncertainty_box(spark, d):
    return prep.uncertainty_box(wide_panel(spark, d), 0.1).select("series", "t", "d_min", "d_max")


@query(f"""WITH {sql.PANEL}, l AS (SELECT series, t, unnest([m1, m2, m3, m4, m5, m6]) AS v FROM panel)
SELECT series, t, round(avg(v), 6) AS mean, round(avg(v) - 2 * stddev_samp(v), 6) AS low, round(avg(v) + 2 * stddev_samp(v), 6) AS high FROM l GROUP BY series, t""")
def member_spread(spark, d):
    m = F.slice("x", 2, 6)
    return panel(spark, d).select("series", "t", V.mean(m).alias("mean"), (V.mean(m) - 2 * V.std(m)).alias("low"), (V.mean(m) + 2 * V.std(m)).alias("high"))


# --- time-series preparation ---------------------------------------------------------------------------------------


@query(f"""WITH {sql.PANEL}, l AS (SELECT series, t, y AS y_0, lag(y, 1) OVER w AS y_1, lag(y, 2) OVER w AS y_2, m1 AS m1_0, lag(m1, 1) OVER w AS m1_1, lag(m1, 2) OVER w AS m1_2,
  lead(y, 2) OVER w AS target FROM panel WINDOW w AS (PARTITION BY series ORDER BY t))
SELECT series, t, {_r('y_0', 'm1_0', 'y_1', 'm1_1', 'y_2', 'm1_2', 'target')} FROM l WHERE t >= 3 AND target IS NOT NULL""")
def supervised_xy(spark, d):
    return prep.supervised(wide_panel(spark, d), ["y", "m1"], "y", 3, 2)


@query(f"WITH {sql.PANEL} SELECT series, t, round(y - lag(y) OVER w, 6) AS diff, round((y - lag(y) OVER w) / nullif(lag(y) OVER w, 0), 6) AS ret FROM panel WINDOW w AS (PARTITION BY series ORDER BY t)")
def diff_returns(spark, d):
    return prep.differences(wide_panel(spark, d)).select("series", "t", "diff", "ret")


@query("SELECT event_id, round(sin(2 * pi() * dayofyear(ts) / 365), 6) + 0.0 AS sin_day, round(cos(2 * pi() * dayofyear(ts) / 365), 6) + 0.0 AS cos_day, round(sin(2 * pi() * hour(ts) / 24), 6) + 0.0 AS sin_hour, round(cos(2 * pi() * hour(ts) / 24), 6) + 0.0 AS cos_hour FROM events")
def cyclic_time(spark, d):
    return prep.cyclic_time(table(spark, d, "events"), "ts").select("event_id", "sin_day", "cos_day", "sin_hour", "cos_hour")


@query("SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'A' AS DOUBLE) AS \"l_returnflag_A\", CAST(l_returnflag = 'N' AS DOUBLE) AS \"l_returnflag_N\", CAST(l_returnflag = 'R' AS DOUBLE) AS \"l_returnflag_R\" FROM lineitem")
def one_hot(spark, d):
    return prep.one_hot(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag", ["A", "N", "R"]).drop("l_returnflag")


_LAGGED = f"WITH {sql.BASE}, l AS (SELECT series, t, " + ", ".join(f"lag({m}, {k}) OVER w AS {m}_{k}" for k in (1, 2, 3) for m in ("m1", "m6", "y")) + ", lag(y, 4) OVER w AS y_4 FROM std WINDOW w AS (PARTITION BY series ORDER BY t))"


def _picked(df, places, names):
    return df.select("series", "t", F.size("z").alias("width"), *(F.get("z", F.lit(p)).alias(n) for p, n in zip(places, names)))


@query(f"{_LAGGED} SELECT series, t, 24 AS width, round(m1_1, 6) AS a, round(m6_3, 6) AS b, round(y_3, 6) AS c, round(y_1, 6) AS e FROM l WHERE t >= 4")
def lags_value_rule(spark, d):
    return _picked(lag_matrix(_std(spark, d), 3), (1, 20, 21, 23), "abce")


@query(f"{_LAGGED} SELECT series, t, 24 AS width, round(m1_1 - y_1, 6) AS a, round(m6_3 - y_3, 6) AS b, round(1 - y_2, 6) AS c, CAST(1 AS DOUBLE) AS e FROM l WHERE t >= 4")
def lags_error_rule(spark, d):
    return _picked(lag_matrix(_std(spark, d), 3, "error"), (1, 20, 7, 23), "abce")


@query(f"WITH {sql.BASE}, l AS (SELECT series, t, " + ", ".join(f"lag({m} - y) OVER w AS d{k}" for k, m in enumerate(sql.MEMBERS, 1)) + ", lag(1 - y) OVER w AS d0 FROM std WINDOW w AS (PARTITION BY series ORDER BY t)) SELECT series, t, 8 AS width, round(d0 / s, 6) AS a, round(d6 / s, 6) AS b FROM (SELECT *, nullif(abs(d0) + abs(d1) + abs(d2) + abs(d3) + abs(d4) + abs(d5) + abs(d6), 0) AS s FROM l) WHERE t >= 2")
def lags_error_norm(spark, d):
    return _picked(lag_matrix(_std(spark, d), 1, "error_norm"), (0, 6), "ab")


@query(f"{_LAGGED} SELECT series, t, 16 AS width, round(m1_1, 6) AS a, round(m6_2, 6) AS b, round(y_4, 6) AS c, round(y_3, 6) AS e FROM l WHERE t >= 5")
def lags_lead(spark, d):
    return _picked(lag_matrix(_std(spark, d), 2, lead=3), (1, 13, 14, 15), "abce")


@query(f"WITH {sql.BASE}, l AS (SELECT series, t, m1, lag(m1) OVER w AS m1_1, lag(y) OVER w AS y_1 FROM std WINDOW w AS (PARTITION BY series ORDER BY t)) SELECT series, t, 16 AS width, round(m1, 6) AS a, round(m1_1, 6) AS b, round(y_1, 6) AS c, CAST(1 AS DOUBLE) AS e FROM l WHERE t >= 2")
def lags_python(spark, d):
    return _picked(lag_matrix(_std(spark, d), 1, constant=True, present=True), (1, 8, 14, 15), "abce")


# --- storms ----------------------------------------------------------------------------------------------------------


def _storm_records(spark, d):
    ev = table(spark, d, "events")
    day = F.date_trunc("day", "ts").alias("d")
    six = ev.groupBy("event_type", F.dayofmonth("ts").alias("days"), (F.floor(F.hour("ts") / 6) * 6).cast("int").alias("hours"), day).agg(F.min("value").alias("y"))
    six = six.filter("NOT (days % 9 = 4 AND hours = 6)")
    rows = six.select(F.col("event_type").alias("series"), "days", "hours", "d", "y", (F.col("y") / 10).alias("current_speed"))
    return dense_index(rows, ["series"], ["d", "hours"]).select("series", "t", "days", "hours", "y", "current_speed")


def _user_records(spark, d):
    """All events as records of their users, the times cut to six hours."""
    ev = table(spark, d, "events").withColumn("series", F.col("user_id").cast("string"))
    rows = dense_index(ev, ["series"], ["ts", "event_id"])
    hours = (F.floor(F.hour("ts") / 6) * 6).cast("int").alias("hours")
    return rows.select("series", "t", F.dayofmonth("ts").alias("days"), hours, F.col("value").alias("y"), (F.col("value") / 10).alias("current_speed"))


def _records(spark, d, s):
    return _storm_records(spark, d) if s is SETTINGS else _user_records(spark, d)


@query(f"WITH {sql.storms()} SELECT series, t, storm, k, length FROM st", whole=True)
def storm_segments(spark, d, s=SETTINGS):
    return segments.storms(_records(spark, d, s)).select("series", "t", "storm", "k", "length")


@query(f"WITH {sql.storms()}, p AS (SELECT * FROM st WHERE length > 2) SELECT series, storm, k, row_number() OVER (PARTITION BY series ORDER BY storm, k) AS pos FROM p", whole=True)
def storm_lengths(spark, d, s=SETTINGS):
    return segments.long_storms(_records(spark, d, s), 1).select("series", "storm", "k", "pos")


@query(f"WITH {sql.storms()}, p AS (SELECT *, lag(y) OVER (PARTITION BY series, storm ORDER BY k) AS x1, lag(current_speed) OVER (PARTITION BY series, storm ORDER BY k) AS c1 FROM st) SELECT series, storm, k, round(x1, 6) AS x1, round(current_speed, 6) AS c0 FROM p WHERE k > 1", whole=True)
def storm_lag_vectors(spark, d, s=SETTINGS):
    rows = segments.storms(_records(spark, d, s)).withColumn("x", F.array("y"))
    return storm_lags(rows, 1).select("series", "storm", "k", F.get("z", F.lit(0)).alias("x1"), F.get("z", F.lit(1)).alias("c0"))


# --- simple forecasts and scores -----------------------------------------------------------------------------------


def _simple(spark, d, s=SETTINGS):
    rows = _relevant(spark, d, s)
    last = prep.testing(online.persistence(rows)).filter(F.col("t") > F.col("split") + 2)
    return online.ensemble_mean(prep.testing(rows)).unionByName(online.errors_of(last, "last_timestep", F.col("last")))


_SIMPLE = f"WITH {sql.BASE}, {sql.SIMPLE} "


@query(f"{_SIMPLE} SELECT series, t, round(y, 6) AS y, round(y - err, 6) AS pred, round(err, 6) AS err FROM simple WHERE method = 'mean'", whole=True)
def ensemble_mean(spark, d, s=SETTINGS):
    return online.ensemble_mean(prep.testing(_relevant(spark, d, s))).drop("method")


@query(f"{_SIMPLE} SELECT series, t, round(err, 6) AS err FROM simple WHERE method = 'last_timestep'", whole=True)
def persistence(spark, d, s=SETTINGS):
    return _simple(spark, d, s).filter("method = 'last_timestep'").select("series", "t", "err")


@query(f"{_SIMPLE} SELECT series, t, model, round(err, 6) AS err FROM merr", whole=True)
def model_errors(spark, d, s=SETTINGS):
    return metrics.member_errors(prep.testing(_relevant(spark, d, s))).select("series", "t", "model", "err")


@query(f"{_SIMPLE} {sql.scores('simple')}", whole=True)
def metrics_mae_mape_rmse_r2(spark, d, s=SETTINGS):
    return metrics.scores(_simple(spark, d, s))


@query(f"{_SIMPLE} {sql.cvar('simple')}", whole=True)
def cvar_05_15(spark, d, s=SETTINGS):
    return metrics.cvar(_simple(spark, d, s))


@query(f"{_SIMPLE} {sql.cvar('(SELECT series, method, err * err AS err FROM simple)')}", whole=True)
def cvar_squared(spark, d, s=SETTINGS):
    return metrics.cvar(_simple(spark, d, s), loss=F.col("err") * F.col("err"))


@query(f"{_SIMPLE} SELECT series, method, count(*) FILTER (abs(err) > 1.5) AS over_1_5, count(*) FILTER (abs(err) > 2) AS over_2_0, count(*) FILTER (abs(err) > 2.5) AS over_2_5, count(*) FILTER (abs(err) > 3) AS over_3_0 FROM simple GROUP BY ALL", whole=True)
def exceedance_counts(spark, d, s=SETTINGS):
    return metrics.exceedances(_simple(spark, d, s))


@query(f"{_SIMPLE}, b AS (SELECT series, model, 100 * avg(abs(err / nullif(y, 0))) AS mape FROM merr GROUP BY ALL) SELECT series, model, round(mape, 6) AS mape FROM b QUALIFY row_number() OVER (PARTITION BY series ORDER BY mape, model) = 1", whole=True)
def best_model_hindsight(spark, d, s=SETTINGS):
    return metrics.best_member(metrics.member_errors(prep.testing(_relevant(spark, d, s))))


@query(f"{_SIMPLE} SELECT series, method, round(avg(err), 6) AS mean, round(min(err), 6) AS min, round(stddev_samp(err), 6) AS std, count(err) AS count FROM simple GROUP BY ALL", whole=True)
def error_describe(spark, d, s=SETTINGS):
    return reporting.summary(_simple(spark, d, s), ["series", "method"], "err")


# --- sequential learners -------------------------------------------------------------------------------------------


def _weights(df):
    return df.select("series", "t", *_flat(df, "beta", 6, "b"))


@query(f"WITH {sql.BASE}, {sql.exp3('ROWS BETWEEN 150 PRECEDING AND 1 PRECEDING', 'e')} SELECT series, t, {_r(*(f'b{k}' for k in range(1, 7)))} FROM e", whole=True)
def exp3_full(spark, d, s=SETTINGS):
    return _weights(prep.testing(online.exponential_weights(_relevant(spark, d, s), 6, s.split.history)))


@query(f"WITH {sql.BASE}, {sql.exp3('ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING', 'e')} SELECT series, t, {_r(*(f'b{k}' for k in range(1, 7)))} FROM e", whole=True)
def exp3_recent(spark, d, s=SETTINGS):
    return _weights(prep.testing(online.exponential_weights(_relevant(spark, d, s), 6, s.split.past - 1)))


@query(f"WITH {sql.BASE}, {sql.exp3('ROWS BETWEEN UNBOUNDED PRECEDING AND 4 PRECEDING', 'e', '(SELECT * FROM std WHERE t >= first)')} SELECT series, t, {_r(*(f'b{k}' for k in range(1, 7)))} FROM e", whole=True)
def exp3_delayed(spark, d, s=SETTINGS):
    rows = _std(spark, d, s).filter("t >= first AND t <= end")
    return _weights(prep.testing(online.exponential_weights(rows, 6, evaluate.expanding(s.split), 4)))


@query(f"WITH {sql.BASE}, {sql.exp3('ROWS BETWEEN 150 PRECEDING AND 1 PRECEDING', 'e')}, m AS (SELECT series, 'bandits_full' AS method, y, err FROM e) {sql.scores('m')}", whole=True)
def bandits_report(spark, d, s=SETTINGS):
    return metrics.scores(online.weighted(prep.testing(online.exponential_weights(_relevant(spark, d, s), 6, s.split.history)), "bandits_full", True))


def _pa_sql(delay: int) -> str:
    names = ["x0", *sql.MEMBERS]
    source = ", ".join([*(f"s.{m}" for m in sql.MEMBERS)])
    dot = " + ".join(f"p.w{k} * u.{m}" if k else "p.w0" for k, m in enumerate(names))
    square = " + ".join(f"u.{m} * u.{m}" if k else "1" for k, m in enumerate(names))
    active = "true" if delay == 1 else f"p.t + 1 - {delay} >= p.split + 2"
    step = lambda k, m: f"CASE WHEN {active} THEN p.w{k} + sign(u.y - ({dot})) * greatest(abs(u.y - ({dot})) - 0.01, 0) / ({square}) * {'u.' + m if k else '1'} ELSE p.w{k} END AS w{k}"
    return f"""WITH RECURSIVE {sql.BASE},
pa AS (SELECT series, split + 1 AS t, split, end_, {', '.join(f'CAST(1.0 / 7 AS DOUBLE) AS w{k}' for k in range(7))} FROM lim
  UNION ALL SELECT p.series, p.t + 1, p.split, p.end_, {', '.join(step(k, m) for k, m in enumerate(names))}
  FROM pa p JOIN (SELECT s.series, s.t, s.y, {source} FROM std s) u ON u.series = p.series AND u.t = p.t + 1 - {delay} WHERE p.t < p.end_)
SELECT series, t, {_r(*(f'w{k}' for k in range(7)))} FROM pa WHERE t > split + 1"""


def _pa(spark, d, delay, s=SETTINGS):
    rows = _std(spark, d, s)
    limits = rows.select("series", (F.col("split") + 1).alias("first"), "end").distinct()
    beta = online.passive_aggressive(rows.select("series", "t", "x", "y"), 0.01, limits, delay)
    return beta.select("series", "t", *(F.get("beta", F.lit(k)).alias(f"w{k}") for k in range(7)))


@query(_pa_sql(1), whole=True)
def pa_path(spark, d, s=SETTINGS):
    return _pa(spark, d, 1, s)


@query(_pa_sql(4), whole=True)
def pa_delayed(spark, d, s=SETTINGS):
    return _pa(spark, d, 4, s)


# --- batch learners ------------------------------------------------------------------------------------------------


@query(f"WITH {sql.BASE} SELECT series, count(*) AS n, round(sum(y), 6) AS xy0, round(sum(m1 * y), 6) AS xy1, round(sum(m1 * m6), 6) AS xx16, round(sum(m6 * m6), 6) AS xx66 FROM std WHERE t BETWEEN first AND last GROUP BY series", whole=True)
def gram_sums(spark, d, s=SETTINGS):
    sums = learners.gram(prep.training(_std(spark, d, s)).withColumn("f", F.col("x")))
    def read(source):
        for b in source:
            rows = [np.frombuffer(r, float).reshape(8, 8) for r in b.column(2).to_pylist()]
            pick = lambda i, j: pa.array([float(m[i, j]) for m in rows])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pick(0, 7), pick(1, 7), pick(1, 6), pick(6, 6)], names=["series", "n", "xy0", "xy1", "xx16", "xx66"])

    return sums.select("series", "n", "sums").mapInArrow(read, "series string, n long, xy0 double, xy1 double, xx16 double, xx66 double")


@query(f"""WITH {sql.BASE}, g AS (SELECT series, avg(m1) AS a, avg(m1 * m1) + 0.01 AS b, avg(y) AS c, avg(m1 * y) AS e FROM std WHERE t BETWEEN first AND last GROUP BY series)
SELECT series, round((c * b - a * e) / (1.01 * b - a * a), 6) AS b0, round((1.01 * e - a * c) / (1.01 * b - a * a), 6) AS b1 FROM g""", whole=True)
def ridge_two_features(spark, d, s=SETTINGS):
    rows = prep.training(_std(spark, d, s)).withColumn("x", F.slice("x", 1, 2))
    return learners.ridge(rows, 0.01).select("series", F.get("theta", F.lit(0)).alias("b0"), F.get("theta", F.lit(1)).alias("b1"))


_THREE = """g AS (SELECT series, 1.0 AS a00, avg(m1) AS a01, avg(m4) AS a02, avg(m1 * m1) AS a11, avg(m1 * m4) AS a12, avg(m4 * m4) AS a22, avg(y) AS b0, avg(m1 * y) AS b1, avg(m4 * y) AS b2
  FROM std WHERE t BETWEEN first AND last GROUP BY series)"""


def _three(rho: float, free: bool, method: str) -> str:
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    a = {(i, j): f"a{i}{j}" + (f" + {rho}" if i == j and not (free and i == 0) else "") for i, j in pairs}
    values = ", ".join(f"round({v}, 6) AS b{k}" for k, v in enumerate(sql.cramer(a, ["b0", "b1", "b2"])))
    return f"WITH {sql.BASE}, {_THREE} SELECT series, '{method}' AS method, {values} FROM g"


def _theta(params: DataFrame, names: str, *more: str) -> DataFrame:
    return params.select("series", *more, *(F.get("theta", F.lit(k)).alias(n) for k, n in enumerate(names.split())))


def _three_members(rows: DataFrame) -> DataFrame:
    return rows.withColumn("x", F.array(F.lit(1.0), F.get("x", F.lit(1)), F.get("x", F.lit(4))))


@query(_three(0.01, False, "ridge"), whole=True)
def ridge_general(spark, d, s=SETTINGS):
    return _theta(learners.ridge(_three_members(prep.training(_std(spark, d, s))), 0.01), "b0 b1 b2", "method")


@query(_three(0.05, True, "ols_ridge"), whole=True)
def ridge_free_intercept(spark, d, s=SETTINGS):
    return _theta(learners.ridge(_three_members(prep.training(_std(spark, d, s))), 0.05, "ols_ridge", True), "b0 b1 b2", "method")


@query(f"""WITH {sql.BASE}, g AS (SELECT series, count(*) AS n, sum(y * y) AS yy, sum(m1 * y) AS b, sum(m1 * m1) AS c FROM std WHERE t BETWEEN first AND last GROUP BY series)
SELECT series, round(CASE WHEN abs(b) <= 0.01 * n * sqrt(yy) THEN 0 ELSE b / c - sign(b) * n * 0.01 * sqrt((yy - b * b / c) / (c * (c - n * n * 0.0001))) END, 6) AS b1 FROM g""")
def unsquared_ridge(spark, d):
    rows = prep.training(_std(spark, d)).withColumn("x", F.slice("x", 2, 1))
    return _theta(learners.unsquared_ridge(rows, 0.01), "b1")


def _one_member(spark, d, rule: str, s=SETTINGS) -> DataFrame:
    """Training rows of m1 alone, with the lag vector of one row."""
    rows = _std(spark, d, s).withColumn("x", F.slice("x", 2, 1))
    return prep.training(lag_matrix(rows, 1, rule)).filter(F.col("t") >= F.col("first") + 1)


_P = SETTINGS.penalty


def _ridge_penalty(rho_beta: float) -> dict[tuple[int, int], str]:
    own = {(0, 0): _P.rho, (1, 1): _P.rho_v, (2, 2): _P.rho_v}
    return {(i, j): f"{rho_beta} * avg(w{i} * w{j}) + {own.get((i, j), 0.0)}" for i in range(3) for j in range(i, 3)}


def _both_penalties(rule: str, suffix: str) -> str:
    part = lambda name, rho: sql.adaptive_system(_ridge_penalty(rho), extra=f", '{name}{suffix}' AS method")
    return f"WITH {sql.BASE}, {sql.adaptive(rule)} {part('adaptive_ridge_exact', _P.rho_beta)} UNION ALL {part('adaptive_ridge_standard', 0.0)}"


def _adaptive(spark, d, rule: str, suffix: str, s) -> DataFrame:
    fits = [(f"adaptive_ridge_exact{suffix}", _P), (f"adaptive_ridge_standard{suffix}", Penalty(0.0, _P.rho, _P.rho_v))]
    return _theta(learners.adaptive_ridge(_one_member(spark, d, rule, s), fits), "v0 v1 v2", "method")


@query(_both_penalties("value", ""), whole=True)
def adaptive_ridge_value(spark, d, s=SETTINGS):
    return _adaptive(spark, d, "value", "", s)


@query(_both_penalties("error", "_err_rule"), whole=True)
def adaptive_ridge_err_rule(spark, d, s=SETTINGS):
    return _adaptive(spark, d, "error", "_err_rule", s)


def _lagged_training(spark, d):
    rows = _relevant(spark, d, WHOLE)
    return prep.training(evaluate.with_lags(rows, WHOLE, "value")).filter(F.col("t") >= F.col("first") + WHOLE.split.past)


_CHANGE = {(i, j): f"0.01 * avg(w{i} * w{j}) + 0.1 * sum(c{i} * c{j}) / (count(*) - 1) + {1e-10 if i == j else 0.0}" for i in range(3) for j in range(i, 3)}


@query(f"""WITH {sql.BASE}, {sql.adaptive("value")}, ch AS (SELECT *, {', '.join(f"w{i} - coalesce(lag(w{i}) OVER (PARTITION BY series ORDER BY t), w{i}) AS c{i}" for i in range(3))} FROM ad)
{sql.adaptive_system(_CHANGE, "ch")}""", whole=True)
def slowly_varying(spark, d, s=SETTINGS):
    rows = _one_member(spark, d, "value", s).select("series", "t", "x", "y", "z")
    return _theta(learners.slowly_varying_ridge(rows, 0.01, 0.1), "v0 v1 v2")


def _stable_sql(over_all: bool) -> str:
    """w1, w2 are 0 in the first 49 rows; the penalty of the weights covers the later rows, or all."""
    late, rows, first = ("", "count(*) - 50", 0.01 / 50) if over_all else (" FILTER (k >= 50)", "count(*) - 49", 0.01 / 49)
    penalty = {(i, j): f"0.1 * coalesce(sum(w{i} * w{j}){late}, 0) / ({rows}) + {first if i == j == 0 else 0.0}" for i in range(3) for j in range(i, 3)}
    return f"""WITH {sql.BASE}, {sql.adaptive("value")}, st AS (SELECT * REPLACE (CASE WHEN k < 50 THEN 0 ELSE w1 END AS w1, CASE WHEN k < 50 THEN 0 ELSE w2 END AS w2) FROM ad)
{sql.adaptive_system(penalty, "st")}"""


def _stable(spark, d, s, over_all: bool) -> DataFrame:
    rows = _one_member(spark, d, "value", s).withColumn("k", F.col("t") - F.col("first"))
    return _theta(learners.stable_part_ridge(rows, 0.01, 0.1, 50, over_all=over_all), "v0 v1 v2")


@query(_stable_sql(False), whole=True)
def stable_part(spark, d, s=SETTINGS):
    return _stable(spark, d, s, False)


@query(_stable_sql(True), whole=True)
def stable_part_over_all(spark, d, s=SETTINGS):
    return _stable(spark, d, s, True)


@query(None)
def free_path(spark, d):
    rows = _one_member(spark, d, "value").select("series", "t", "x", "y", "z")
    return _theta(learners.free_path_ridge(rows, 0.01, 0.1, 50), "b0 v1 v2", "n_rows")


@query(f"""WITH {sql.BASE}, g AS (SELECT series, t, split, end_, avg(m1) OVER w AS a, avg(m1 * m1) OVER w + 0.1 AS b, avg(y) OVER w AS c, avg(m1 * y) OVER w AS e FROM std
  WINDOW w AS (PARTITION BY series ORDER BY t ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
SELECT series, t, round((c * b - a * e) / (1.1 * b - a * a), 6) AS b0, round((1.1 * e - a * c) / (1.1 * b - a * a), 6) AS b1 FROM g WHERE t > split + 1 AND t <= end_""", whole=True)
def rolling_ridge(spark, d, s=SETTINGS):
    rows = _relevant(spark, d, s).withColumn("x", F.slice("x", 1, 2))
    tests = prep.testing(rows).select("series", "t")
    beta = learners.rolling_ridge(rows.select("series", "t", "x", "y"), 30, 0.1, 2, 2).join(tests, ["series", "t"], "left_semi")
    return beta.select("series", "t", F.get("beta", F.lit(0)).alias("b0"), F.get("beta", F.lit(1)).alias("b1"))


@query(f"""WITH {sql.BASE}, g AS (SELECT series, t, y_true, y, m1, mu, sigma, split, end_, avg(m1) OVER w AS a, avg(m1 * m1) OVER w + 0.1 AS b, avg(y) OVER w AS c, avg(m1 * y) OVER w AS e FROM std
  WINDOW w AS (PARTITION BY series ORDER BY t ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
SELECT series, t, round(y_true - (((c * b - a * e) + (1.1 * e - a * c) * m1) / (1.1 * b - a * a) * sigma + mu), 6) AS err FROM g WHERE t > split + 1 AND t <= end_""", whole=True)
def retrained_errors(spark, d, s=SETTINGS):
    rows = _relevant(spark, d, s).withColumn("x", F.slice("x", 1, 2))
    beta = learners.rolling_ridge(rows.select("series", "t", "x", "y"), 30, 0.1, 2, 2)
    return online.weighted(prep.testing(rows).join(beta, ["series", "t"]), "retrained").select("series", "t", "err")


def _robust(spark, d, names, adaptive=False):
    methods = {n: robust.METHODS[n] for n in names}
    rows = learners.adaptive_features(_lagged_training(spark, d)) if adaptive else prep.training(_std(spark, d, WHOLE))
    fitted = robust_rounds.fit_rounds(rows, methods, "f" if adaptive else "x", evaluate.z_width(SETTINGS) if adaptive else 0)
    # the gap to a lower bound of the least objective proves each fit
    return fitted.select("series", "method", "n_rows", F.round("objective", 4).alias("objective"), (F.col("gap") < 1e-4).alias("certified"), "error")


@query(None)
def robust_learners(spark, d):
    return _robust(spark, d, ["ols_ridge_CVaR", "ols_lasso_CVaR", "lad_lasso", "lad_lasso_CVaR"])


@query(None)
def adaptive_lad(spark, d):
    return _robust(spark, d, ["adaptive_lad_ridge", "adaptive_lad_ridge_CVaR"], True)


@query(None)
def box_path(spark, d):
    fitted = robust.box_paths(prep.training(_std(spark, d)), 0.5, 0.02)
    return fitted.select("series", "method", "n_rows", F.round("objective", 2).alias("objective"), (F.col("gap") < 1e-4 * F.col("objective") + 1e-4).alias("certified"), "error")


@query(None)
def drifting_offsets(spark, d):
    fitted = robust.drifting_series(prep.training(_std(spark, d)), 0.01, 0.1, 0.1, 0.15, 3)
    return fitted.select("series", "method", "n_rows", F.round("objective", 4).alias("objective"), (F.col("gap") < 1e-4).alias("certified"), "error")


def _least(rows: DataFrame, method: str, spec) -> DataFrame:
    fitted = robust_rounds.fit_rounds(rows, {method: spec}, close=1e-9)
    return fitted.select("series", "n_rows", F.round("objective", 5).alias("objective"))


# absolute losses are least at a corner: a line through two rows, or a level one through one row
@query(f"""WITH {sql.BASE}, p AS (SELECT series, t, m1 AS x, y FROM std WHERE t BETWEEN first AND last),
c AS (SELECT a.series, (a.y - b.y) / (a.x - b.x) AS b1, a.y - (a.y - b.y) / (a.x - b.x) * a.x AS b0 FROM p a JOIN p b ON a.series = b.series AND a.t < b.t AND a.x <> b.x
  UNION SELECT series, 0, y FROM p),
v AS (SELECT c.series, b0, b1, count(*) AS n, avg(abs(p.y - b0 - b1 * p.x)) + 0.01 * abs(b1) AS o FROM c JOIN p USING (series) GROUP BY c.series, b0, b1)
SELECT series, n AS n_rows, round(min(o), 5) AS objective FROM v GROUP BY series, n""")
def lad_lasso_two_features(spark, d):
    return _least(prep.training(_std(spark, d)).withColumn("x", F.slice("x", 1, 2)), "lad_lasso", robust.METHODS["lad_lasso"])


@query(f"""WITH {sql.BASE}, p AS (SELECT series, m1 AS x, y, count(*) OVER (PARTITION BY series) AS n FROM std WHERE t BETWEEN first AND last),
c AS (SELECT series, y / x AS b FROM p WHERE x <> 0 UNION SELECT series, 0 FROM p),
v AS (SELECT c.series, b, n, avg(abs(p.y - b * p.x)) + 0.5 / n * abs(b) AS o FROM c JOIN p USING (series) GROUP BY c.series, b, n)
SELECT series, n AS n_rows, round(min(o), 5) AS objective FROM v GROUP BY series, n""")
def l1_regression(spark, d):
    """The sum of absolute errors + 0.5 * |b|, over the number of rows."""
    rows = prep.training(_std(spark, d)).withColumn("x", F.slice("x", 2, 1))
    return _least(rows, "l1_regression", robust.sum_lad(0.5, SPLIT.history + 1))


# the tail's mean over a constant changes its slope only midway between two targets
@query(f"""WITH {sql.BASE}, p AS (SELECT series, t, y, count(*) OVER (PARTITION BY series) AS n FROM std WHERE t BETWEEN first AND last),
c AS (SELECT DISTINCT a.series, (a.y + b.y) / 2 AS b FROM p a JOIN p b ON a.series = b.series AND a.t <= b.t),
l AS (SELECT c.series, b, n, abs(y - b) AS e, row_number() OVER (PARTITION BY c.series, b ORDER BY abs(y - b) DESC) AS r FROM c JOIN p USING (series)),
v AS (SELECT series, b, n, sum(e * greatest(least(r, 0.15 * n) - (r - 1), 0)) / max(0.15 * n) AS o FROM l WHERE r <= 0.15 * n + 1 GROUP BY ALL)
SELECT series, n AS n_rows, round(min(o), 5) AS objective FROM v GROUP BY ALL""")
def lad_cvar_constant(spark, d):
    return _least(prep.training(_std(spark, d)).withColumn("x", F.slice("x", 1, 1)), "lad_lasso_CVaR", robust.METHODS["lad_lasso_CVaR"])


@query(f"WITH {sql.user_storms()} SELECT series, storm, k, round(y, 6) AS y, round(current_speed, 6) AS current_speed, round(y * 2, 6) AS x0, CAST(hours AS DOUBLE) AS x1, CAST(1 AS DOUBLE) AS x2 FROM st")
def storm_parts(spark, d):
    rows = segments.storms(_user_records(spark, d)).withColumns({"f1": F.col("y") * 2, "f2": F.col("hours")})
    parts = segments.storm_parts(rows, ["f1", "f2"], "y")
    return parts.select("series", "storm", "k", "y", "current_speed", *(F.get("x", F.lit(k)).alias(f"x{k}") for k in range(3)))


@query(None)
def slowly_varying_lad(spark, d):
    """Weights that change slowly: stretches of 128 rows, certificates, and the last row's weights on the constant."""
    fitted = slow_lad.slow_lad(_lagged_training(spark, d), slow_lad.Slow(), 20, 128)
    proven = (F.col("gap") < 0.01 + 0.05 * F.col("objective")).alias("certified")
    return fitted.select("series", "method", "n_rows", F.round("objective", 3).alias("objective"), proven, F.size("theta").alias("n_weights"), F.round(F.get("theta", F.lit(0)), 2).alias("b0"))


#: Steps of the horizon whose targets the adversary picks.
HORIZON = 6


def _horizon(spark, d, members):
    """Training rows and the horizon after them, with the intercept and some members."""
    rows = _relevant(spark, d).withColumn("x", F.slice("x", 1, members + 1))
    cut = lambda df: df.select("series", "t", "x", "y")
    return cut(prep.training(rows)), cut(prep.testing(rows).filter(F.col("t") <= F.col("split") + 1 + HORIZON))


# where the steps' bound is twice the tube's half width it never binds: each target has a worst side of its own
@query(f"""WITH {sql.BASE}, g AS (SELECT series, avg(m1) AS a, avg(m1 * m1) + 0.1 AS b, avg(y) AS c, avg(m1 * y) AS e FROM std WHERE t BETWEEN first AND last GROUP BY series),
w AS (SELECT series, (c * b - a * e) / (1.1 * b - a * a) AS b0, (1.1 * e - a * c) / (1.1 * b - a * a) AS b1 FROM g)
SELECT series, round(sum(greatest(0, abs(y - b0 - b1 * m1) + 0.3 * abs(y) - 0.1 * (1 + abs(m1)))), 3) AS value FROM std JOIN w USING (series)
WHERE t > split + 1 AND t <= split + 1 + {HORIZON} GROUP BY series""")
def adversary_free_steps(spark, d):
    train, horizon = _horizon(spark, d, 1)
    cases = adversary.horizon_cases(horizon, learners.ridge(train, 0.1), 0.3)
    found = adversary.adversary(cases, adversary.Tube(0.1, 0.2, 1e-7), 1e-6)
    return found.select("series", F.round("value", 3).alias("value"))


@query(None)
def adversary_tied_steps(spark, d):
    train, horizon = _horizon(spark, d, 6)
    found = adversary.adversary(adversary.horizon_cases(horizon, learners.ridge(train, 0.1), 0.3), adversary.Tube(0.1, 0.02))
    proven = (F.col("bound") - F.col("value") <= 2e-3 * F.greatest("value", F.lit(1.0))).alias("certified")
    return found.select("series", F.round("value", 2).alias("value"), proven, "nodes", "pruned")


@query(None)
def worst_case_ridge(spark, d):
    found = adversary.worst_case_ridge(*_horizon(spark, d, 6), 0.3, adversary.Tube(0.1, 0.02))
    proven = (F.col("gap") <= 0.01).alias("certified")
    return found.select("series", F.round("objective", 2).alias("objective"), proven, "rounds", F.size("theta").cast("int").alias("n_weights"))


_FEATURED = ("m1", "m4", "m5")
_VARIABLES = ", ".join(["{'of': 'y', 'v': y}", *(f"{{'of': '{m}', 'v': {m}}}" for m in _FEATURED), *(f"{{'of': '{m}_error', 'v': {m} - y}}" for m in _FEATURED)])


def _features_sql() -> str:
    """Means, lags and patterns by whole windows; partial autocorrelations order by order."""
    lags = range(1, 5)
    d = ", ".join(f"lag(d, {k}) OVER w AS d{k}" for k in lags)
    r = ", ".join(f"coalesce(sum(d * d{k}), 0) / count(*) / nullif(avg(d * d), 0) AS r{k}" for k in lags)
    waves = ", ".join(f"pow(sum(d * cos(p * {f} * 2 * pi() / 64)), 2) / 64 + pow(sum(d * sin(p * {f} * 2 * pi() / 64)), 2) / 64 AS w{f}" for f in (1, 2, 3))
    rank = " || ',' || ".join("CAST(" + " + ".join(f"CAST({a} {'<=' if j < k else '<'} {b} AS INT)" for j, a in enumerate(("v2", "v1", "v")) if j != k) + " AS VARCHAR)" for k, b in enumerate(("v2", "v1", "v")))
    return f"""WITH {sql.PANEL},
e AS (SELECT series, t, u.of, CAST(u.v AS DOUBLE) AS v FROM (SELECT series, t, unnest([{_VARIABLES}]) AS u FROM panel)),
c AS (SELECT series, of, t, v, v - avg(v) OVER p AS d, stddev_pop(v) OVER p AS sd FROM e WINDOW p AS (PARTITION BY series, of)),
l AS (SELECT *, lag(v) OVER w AS v1, lag(v, 2) OVER w AS v2, {d} FROM c WINDOW w AS (PARTITION BY series, of ORDER BY t)),
a AS (SELECT series, of, count(*) AS n, {r}, avg(abs(v - v1)) AS mean_change, sqrt(sum((v - v1) * (v - v1))) AS complexity, avg(v * v1 * v2) AS c3,
  avg(v * v * v1 - v1 * v2 * v2) AS asymmetry, count(*) FILTER ((d > 0) <> (d1 > 0)) AS crossings, count(*) FILTER (v1 > v AND v1 > v2) AS peaks,
  avg(CAST(abs(d) > sd AS INT)) AS beyond_1, avg(CAST(abs(d) > 2 * sd AS INT)) AS beyond_2, covar_pop(t, d) / nullif(var_pop(t), 0) AS slope FROM l GROUP BY series, of),
p2 AS (SELECT *, (r2 - r1 * r1) / (1 - r1 * r1) AS q2 FROM a),
p3 AS (SELECT *, r1 - q2 * r1 AS f1, (r3 - (r1 - q2 * r1) * r2 - q2 * r1) / (1 - (r1 - q2 * r1) * r1 - q2 * r2) AS q3 FROM p2),
p4 AS (SELECT *, (r4 - (f1 - q3 * q2) * r3 - (q2 - q3 * f1) * r2 - q3 * r1) / (1 - (f1 - q3 * q2) * r1 - (q2 - q3 * f1) * r2 - q3 * r3) AS q4 FROM p3),
o AS (SELECT series, of, (ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(6) AS entropy FROM (SELECT series, of, {rank} AS k, count(*) AS c FROM l WHERE v2 IS NOT NULL GROUP BY ALL) GROUP BY series, of),
s AS (SELECT series, of, avg(w1) AS w1, avg(w2) AS w2, avg(w3) AS w3 FROM (SELECT series, of, k, {waves} FROM (SELECT *, (t - 1) // 64 AS k, (t - 1) % 64 AS p FROM c) GROUP BY series, of, k HAVING count(*) = 64) GROUP BY series, of),
g AS (SELECT series, of, max(c) AS longest_above FROM (SELECT series, of, r, count(*) FILTER (d > 0) AS c FROM (SELECT *, sum(b) OVER (PARTITION BY series, of ORDER BY t) AS r FROM (
  SELECT *, CASE WHEN d > 0 AND NOT coalesce(d1 > 0, false) THEN 1 ELSE 0 END AS b FROM l)) GROUP BY series, of, r) GROUP BY series, of)
SELECT series, of, n, {_r('r1', 'r2', 'r3', 'r4', 'q2', 'q3', 'q4', 'mean_change', 'beyond_1', 'beyond_2', 'slope', 'entropy')}, round(complexity, 4) AS complexity, round(c3, 1) AS c3,
  round(asymmetry, 1) AS asymmetry, crossings, peaks, longest_above, round(w1, 2) AS w1, round(w2, 2) AS w2, round(w3, 2) AS w3
FROM p4 JOIN o USING (series, of) JOIN g USING (series, of) LEFT JOIN s USING (series, of)"""


@query(_features_sql())
def series_dependence(spark, d):
    """Of targets, members and their errors: dependence over four lags, patterns, periods, changes and runs."""
    found = features.series_features(features.variables(wide_panel(spark, d), _FEATURED), most=4, frequencies=3)
    flat = [F.get("autocorrelation", F.lit(k)).alias(f"r{k + 1}") for k in range(4)] + [F.get("partial", F.lit(k)).alias(f"q{k + 1}") for k in range(1, 4)]
    flat += [F.round(F.get("power", F.lit(k)), 2).alias(f"w{k + 1}") for k in range(3)] + [F.round("complexity", 4).alias("complexity")]
    flat += [F.round(c, 1).alias(c) for c in ("c3", "asymmetry")]
    return found.select("series", "of", "n", *flat, "mean_change", "beyond_1", "beyond_2", "slope", "entropy", "crossings", "peaks", "longest_above")


# --- whole evaluations and reports ---------------------------------------------------------------------------------


@query(None)
def all_methods_report(spark, d):
    return evaluate.report(panel(spark, d), WHOLE)


@query(None)
def results_table(spark, d):
    return evaluate.results_table(to_panel(orders_panel(spark, d)), WHOLE)


def _daily_orders(spark, d):
    day = F.date_trunc("day", "o_orderdate").alias("day")
    daily = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("series"), day).agg(F.sum("o_totalprice").alias("y"))
    return dense_index(daily, ["series"], ["day"]).select("series", "t", "y")


@query(None)
def trained_report(spark, d):
    """All methods over members that are regressions trained in folds that walk forward."""
    names = tuple(trained.regressors())
    return evaluate.report(to_panel(trained.walk_forward(_daily_orders(spark, d)), names), Settings(WHOLE.split, members=len(names)))


@query(f"WITH {sql.user_storms()} SELECT DISTINCT series, storm, length FROM st")
def live_storm_lengths(spark, d):
    """The storms of all users by the live operator: the table of events as a stream, until nothing is left of it."""
    ev = table(spark, d, "events").select(F.col("user_id").cast("string").alias("series"), F.col("event_id").alias("t"), "ts")
    found = ordered.drained(ev, lambda rows: ordered.live_storms(rows.withColumns(
        {"days": F.dayofmonth("ts").cast("int"), "hours": (F.floor(F.hour("ts") / 6) * 6).cast("int")}), 10_000 * ordered.DAY_MS))
    return found.filter("kind = 'storm'").select("series", "storm", "length").distinct()


@query(None)
def storm_report(spark, d):
    rows = _storm_records(spark, d)
    rows = rows.withColumn("x", F.array(F.lit(1.0), F.col("current_speed"), F.col("y") * 0.9 + F.col("hours"), F.col("y") + F.col("days") / 7))
    return metrics.report(evaluate.storm_errors(rows, Settings(Split(0.5, 2, 30, 40), members=3)))


@query(None)
def grid_scores(spark, d):
    """All 500 settings of the grid, for every series."""
    return evaluate.grid_scores(panel(spark, d), WHOLE.split)


_GRID_SQL = """SELECT row_number() OVER (ORDER BY a, b, c, p) AS param_combo, CAST(a AS DOUBLE) AS rho_beta, CAST(b AS DOUBLE) AS rho, CAST(c AS DOUBLE) AS "rho_V", p AS past
FROM (SELECT unnest([0, 0.001, 0.01, 0.1, 1]) AS a), (SELECT unnest([0, 0.001, 0.01, 0.1, 1]) AS b), (SELECT unnest([0, 0.001, 0.01, 0.1, 1]) AS c), (SELECT unnest([2, 3, 4, 5]) AS p)"""


@query(_GRID_SQL)
def grid_combos(spark, d):
    return reporting.grid(spark)


_RUNS = """runs AS (SELECT c_nationkey AS setting, c_mktsegment AS "Method", CAST(c_custkey % 3 AS INT) AS unit, CASE WHEN c_custkey % 2 = 0 THEN 0.5 ELSE 0.7 END AS split, avg(abs(c_acctbal)) AS "MAE" FROM customer GROUP BY ALL)"""


def _runs(spark, d):
    """A table shaped like experiment results: methods, settings and units from the customers."""
    c = table(spark, d, "customer")
    split = F.when(F.col("c_custkey") % 2 == 0, 0.5).otherwise(0.7).alias("split")
    unit = (F.col("c_custkey") % 3).cast("int").alias("unit")
    return c.groupBy(F.col("c_nationkey").alias("setting"), F.col("c_mktsegment").alias("Method"), unit, split).agg(F.avg(F.abs("c_acctbal")).alias("MAE"))


@query(f"""WITH {_RUNS} SELECT v.setting, v."Method", v.unit, round(v."MAE", 6) AS "MAE_x", round(t."MAE", 6) AS "MAE_y" FROM runs v LEFT JOIN runs t ON t.setting = v.setting AND t."Method" = v."Method" AND t.unit = v.unit AND t.split = 0.7 WHERE v.split = 0.5""")
def val_test_join(spark, d):
    return reporting.validation_to_test(_runs(spark, d), ["setting", "Method", "unit"], F.col("split") == 0.5, F.col("split") == 0.7)


@query(f"""WITH {_RUNS}, j AS (SELECT v.setting, v."Method", v.unit, v."MAE" AS x, t."MAE" AS y FROM runs v LEFT JOIN runs t ON t.setting = v.setting AND t."Method" = v."Method" AND t.unit = v.unit AND t.split = 0.7 WHERE v.split = 0.5)
SELECT "Method", setting, unit, round(x, 6) AS "MAE_x", round(y, 6) AS "MAE_y" FROM j QUALIFY row_number() OVER (PARTITION BY "Method" ORDER BY x, setting, unit) = 1""")
def val_test_select(spark, d):
    joined = reporting.validation_to_test(_runs(spark, d), ["setting", "Method", "unit"], F.col("split") == 0.5, F.col("split") == 0.7)
    return reporting.selected(joined, ["Method"])


@query(f"""WITH {_RUNS}, b AS (SELECT setting, "Method" FROM runs WHERE "Method" IN ('BUILDING', 'MACHINERY', 'NONE') QUALIFY row_number() OVER (PARTITION BY setting ORDER BY "MAE", "Method") = 1)
SELECT n."Method", count(b.setting) AS wins FROM (SELECT unnest(['BUILDING', 'MACHINERY', 'NONE']) AS "Method") n LEFT JOIN b ON b."Method" = n."Method" GROUP BY n."Method" """)
def method_wins(spark, d):
    return reporting.wins(_runs(spark, d), ["BUILDING", "MACHINERY", "NONE"], "setting")


@query(f"""WITH {_RUNS}, b AS (SELECT setting, max("MAE") AS b FROM runs WHERE "Method" = 'BUILDING' GROUP BY setting) SELECT r.setting, "Method", unit, split, round("MAE", 6) AS "MAE", round(("MAE" - b) / nullif(b, 0), 6) AS gap FROM runs r LEFT JOIN b USING (setting)""")
def gap_to_baseline(spark, d):
    return reporting.gap_to(_runs(spark, d), "setting", "BUILDING")


@query(f"""WITH {_RUNS} SELECT setting, round(avg("MAE") FILTER ("Method" = 'BUILDING'), 6) AS "BUILDING", round(avg("MAE") FILTER ("Method" = 'MACHINERY'), 6) AS "MACHINERY" FROM runs GROUP BY setting""")
def pivot_sweep(spark, d):
    return reporting.pivoted(_runs(spark, d), "setting", ["BUILDING", "MACHINERY"])


@query(f"""WITH {_RUNS} SELECT setting, {', '.join(f"round({f}(\"MAE\") FILTER (\"Method\" = '{m}'), 6) AS \"{m}_{n}\"" for m in ("BUILDING", "MACHINERY") for f, n in (("avg", "mean"), ("stddev_samp", "std")))} FROM runs GROUP BY setting""")
def sweep_curves(spark, d):
    return reporting.sweep(_runs(spark, d), "setting", ["BUILDING", "MACHINERY"])


@query(f"""WITH {_RUNS}, e AS (SELECT "Method", setting, avg("MAE") AS m, stddev_samp("MAE") AS s FROM runs GROUP BY ALL) SELECT "Method", setting, round(m, 6) AS mean, round(m - s, 6) AS low, round(m + s, 6) AS high FROM e""")
def sweep_bands(spark, d):
    return reporting.bands(_runs(spark, d), "setting")


@query("SELECT CAST(least(floor((value - 0) / 12.5), 39) AS INT) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 500 GROUP BY 1")
def value_histogram(spark, d):
    return reporting.histogram(table(spark, d, "events"), "value", 0.0, 500.0, 40)


@query("""SELECT l_returnflag AS "Method", l_linenumber AS setting, round(avg(l_extendedprice) / 1000, 6) AS seconds FROM lineitem GROUP BY ALL""")
def timing_table(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("Method"), F.col("l_linenumber").alias("setting"), F.col("l_extendedprice").alias("Time"))
    return reporting.timings(rows, "setting")


@query(f"""WITH {_RUNS} SELECT setting, "Method", unit, split, round("MAE", 6) AS "MAE", CASE "Method" WHEN 'BUILDING' THEN 'Builders' WHEN 'MACHINERY' THEN 'Makers' ELSE "Method" END AS label FROM runs""")
def method_labels(spark, d):
    return reporting.labelled(_runs(spark, d), {"BUILDING": "Builders", "MACHINERY": "Makers"})


@query(f"""WITH {sql.PANEL}, c AS (SELECT series, t, y, lag(y) OVER (PARTITION BY series ORDER BY t) AS p FROM panel)
SELECT series, count(y) AS n, round(avg(y), 6) AS mean, round(stddev_pop(y), 6) AS std, min(y) AS low, max(y) AS high, round(sum(y * y), 4) AS energy, round(avg(y - p), 6) AS mean_change,
  round(avg(abs(y - p)), 6) AS mean_abs_change, round(corr(y, p), 6) AS autocorrelation, round(covar_pop(t, y) / var_pop(t), 6) AS slope FROM c GROUP BY series""")
def series_features(spark, d):
    return reporting.features(wide_panel(spark, d)).withColumn("energy", F.round("energy", 4))


@query(f"""WITH {_RUNS}, e AS (SELECT "Method", unit, setting, avg("MAE") AS mean, stddev_samp("MAE") AS std FROM runs GROUP BY ALL) SELECT "Method", unit, round(mean, 6) AS mean, round(std, 6) AS std FROM e QUALIFY row_number() OVER (PARTITION BY "Method", unit ORDER BY mean, setting) = 1""")
def min_over_rho(spark, d):
    return reporting.best_setting(_runs(spark, d), ["Method", "unit"], "setting")


@query(f"""WITH {_RUNS} SELECT "Method", unit, round(avg("MAE"), 6) AS mean, round(min("MAE"), 6) AS min, round(stddev_samp("MAE"), 6) AS std, count("MAE") AS count FROM runs GROUP BY ALL""")
def group_stats(spark, d):
    return reporting.summary(_runs(spark, d), ["Method", "unit"], "MAE")


@query(f"""WITH {_RUNS} SELECT setting, "Method", unit, split, round("MAE", 6) AS "MAE" FROM runs WHERE "MAE" = (SELECT min("MAE") FROM runs)""")
def global_argmin(spark, d):
    return reporting.least_overall(_runs(spark, d), "MAE")


@query(f"""WITH {_RUNS} SELECT setting, "Method", unit, split, round("MAE", 6) AS "MAE" FROM runs ORDER BY "MAE", setting, "Method", unit, split LIMIT 10""")
def topk(spark, d):
    return _runs(spark, d).orderBy("MAE", "setting", "Method", "unit", "split").limit(10)


@query(f"""WITH {_RUNS} SELECT setting, "Method", unit, split, round("MAE", 6) AS "MAE", CAST(row_number() OVER (PARTITION BY "Method" ORDER BY "MAE", setting, unit, split) AS INT) AS place FROM runs QUALIFY row_number() OVER (PARTITION BY "Method" ORDER BY "MAE", setting, unit, split) BETWEEN 3 AND 6""")
def ranked_slice(spark, d):
    return reporting.ranked_slice(_runs(spark, d), ["Method"], [F.col(c) for c in ("MAE", "setting", "unit", "split")], 3, 6)


@query(f"""WITH {_RUNS} SELECT setting % 7 AS slot, round(sum("MAE"), 6) AS total FROM runs GROUP BY 1""")
def folded_sums(spark, d):
    return reporting.folded(_runs(spark, d), "setting", 7, "MAE")


@query(f"""WITH {_RUNS} SELECT DISTINCT "Method" FROM runs WHERE unit = 1 AND "MAE" BETWEEN 1000 AND 6000 AND setting IN (1, 2, 3) UNION ALL SELECT DISTINCT "Method" FROM runs WHERE split = 0.5""")
def filter_distinct_union(spark, d):
    runs = _runs(spark, d)
    some = runs.filter((F.col("unit") == 1) & F.col("MAE").between(1000, 6000) & F.col("setting").isin(1, 2, 3))
    return some.select("Method").distinct().unionByName(runs.filter("split = 0.5").select("Method").distinct())


# --- synthetic data ------------------------------------------------------------------------------------------------

_U = lambda *k: "((CAST('0x' || substring(md5(concat_ws(':', {0})), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)".format(", ".join(k))
_N = lambda *k: f"(sqrt(-2 * ln({_U(chr(39) + 'a' + chr(39), *k)})) * cos(2 * pi() * {_U(chr(39) + 'b' + chr(39), *k)}))"
_Y = f"y AS (SELECT t, sin(2 * pi() * 3 * t / 200.0) + 0.3 * {_N(chr(39) + '11' + chr(39), chr(39) + 'y' + chr(39), 't')} AS y FROM (SELECT unnest(range(1, 401)) AS t))"


def _ens_sql(step: str, drift: bool) -> str:
    s = "'11'"
    extra = f" + {step} * (0.4 * {_N(s, chr(39) + 'drift' + chr(39), 'm')} + {_U(s, chr(39) + 'dspread' + chr(39), 'm')} * 0.2 * {_N(s, chr(39) + 'dx' + chr(39), 'm', 't')})" if drift else ""
    return f"WITH {_Y} SELECT t, CAST(m AS INT) AS model, round(y + (2 * {_U(s, chr(39) + 'bias' + chr(39), 'm')} - 1) * 0.5 + {_U(s, chr(39) + 'spread' + chr(39), 'm')} * 0.5 * {_N(s, chr(39) + 'x' + chr(39), 'm', 't')}{extra}, 6) AS x, round(y, 6) AS y FROM y, (SELECT unnest(range(1, 6)) AS m)"


def _synthetic(spark, **more):
    return synthetic.ensemble(synthetic.target(spark, 200, 3, 0.3, 11), 5, 200, 11, **more)


@query(f"WITH {_Y} SELECT t, round(y, 6) AS y FROM y")
def synth_y(spark, d):
    return synthetic.target(spark, 200, 3, 0.3, 11)


@query(_ens_sql("0", False))
def synth_ensemble(spark, d):
    return _synthetic(spark)


@query(_ens_sql("t / 200.0", True))
def synth_drift(spark, d):
    return _synthetic(spark, drift_bias=0.4, drift_spread=0.2)


@query(_ens_sql("CAST(" + _U("'11'", "'on'", "m", "t") + " < 0.3 AS DOUBLE)", True))
def synth_bernoulli(spark, d):
    return _synthetic(spark, drift_bias=0.4, drift_spread=0.2, p_discrete=0.3)


@query(f"WITH {_Y} SELECT t, round(y + t / 200.0 * (0.5 + 0.1 * {_N(chr(39) + '11' + chr(39), chr(39) + 'ydrift' + chr(39), 't')}), 6) AS y FROM y")
def synth_target_drift(spark, d):
    return synthetic.drifted_target(synthetic.target(spark, 200, 3, 0.3, 11), 200, 11, 0.5, 0.1)


@query(None)
def synth_report(spark, d):
    wide = synthetic.wide(synthetic.perturbed(_synthetic(spark, drift_bias=0.4), 300, 360, 0.5, "gradual"), 5)
    return evaluate.report(to_panel(wide, [f"m{k}" for k in range(1, 6)]), Settings(Split(0.5, 3, 30, 100), members=5))
