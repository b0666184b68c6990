"""SQL fragments of the queries' twins: the same panels, splits and scores in plain SQL."""

from __future__ import annotations

MEMBERS = [f"m{k}" for k in range(1, 7)]
_LIST = ", ".join(MEMBERS)

#: series, t, y, m1 .. m6 of the events.
PANEL = """
raw AS (SELECT event_type AS series, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS t, value AS y FROM events),
panel AS (SELECT series, t - 7 AS t, y, m1, m2, m3, m4, m5, m6 FROM (
  SELECT series, t, y, lag(y) OVER w AS m1,
    avg(y) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m2,
    avg(y) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS m3,
    min(y) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS m4,
    max(y) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS m5,
    avg(y) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m6
  FROM raw WINDOW w AS (PARTITION BY series ORDER BY t)) WHERE t > 7)"""


def bounds(fraction: float = 0.5, history: int = 150, val: int = 100) -> str:
    """CTE lim: series, n, split, first, last, end_."""
    return f"""
lim AS (SELECT series, n, split, greatest(split - {history} + 1, 1) AS first, greatest(split - {history} + 1, 1) + least({history}, split) AS last,
    split + 1 + greatest(least({val}, n - split - 1), 0) AS end_
  FROM (SELECT series, max(t) AS n, CAST(floor(max(t) * {fraction}) AS BIGINT) AS split FROM panel GROUP BY series))"""


def standardised(deviation: str = "stddev_samp") -> str:
    """CTE std: the panel standardised, with its bounds."""
    cols = ", ".join(f"({m} - mu) / sigma AS {m}" for m in MEMBERS)
    return f"""
stats AS (SELECT p.series, avg(y) AS mu, {deviation}(y) AS sigma FROM panel p JOIN lim USING (series) WHERE t <= split GROUP BY p.series),
std AS (SELECT p.series, t, y AS y_true, (y - mu) / sigma AS y, {cols}, mu, sigma, n, split, first, last, end_
  FROM panel p JOIN lim USING (series) JOIN stats USING (series))"""


BASE = PANEL + "," + bounds() + "," + standardised()
#: The same with all rows after training as the test, and training of 300 rows.
WHOLE = PANEL + "," + bounds(history=300, val=1 << 40) + "," + standardised()

#: series, t, method, y, err of the mean, the last value and every member.
SIMPLE = """
test AS (SELECT * FROM std WHERE t > split + 1 AND t <= end_),
merr AS (SELECT series, t, model, y_true AS y, y_true - (v * sigma + mu) AS err FROM (
  SELECT series, t, y_true, mu, sigma, unnest([1, 2, 3, 4, 5, 6]) AS model, unnest([m1, m2, m3, m4, m5, m6]) AS v FROM test)),
simple AS (
  SELECT series, t, 'mean' AS method, y_true AS y, y_true - ((m1 + m2 + m3 + m4 + m5 + m6) / 6 * sigma + mu) AS err FROM test
  UNION ALL SELECT series, t, 'last_timestep', y_true, y_true - (m1 * sigma + mu) FROM test WHERE t > split + 2)"""


def scores(table: str, keys: str = "series, method") -> str:
    """SELECT of the five scores, rounded."""
    return (
        f"SELECT {keys}, count(*) AS n, round(avg(abs(err)), 6) AS mae, round(100 * avg(abs(err / nullif(y, 0))), 6) AS mape, "
        f"round(sqrt(avg(err * err)), 6) AS rmse, round(1 - avg(err * err) / nullif(var_pop(y), 0), 6) AS r2 FROM {table} GROUP BY {keys}"
    )


def cvar(table: str, keys: str = "series, method") -> str:
    """SELECT of the conditional values at risk for 0.05 and 0.15, rounded."""
    part = lambda a: f"round(sum(e * greatest(least(r, {a} * n) - (r - 1), 0)) / max({a} * n), 6)"
    return (
        f"SELECT {keys}, {part(0.05)} AS cvar_05, {part(0.15)} AS cvar_15 FROM (SELECT {keys}, abs(err) AS e, count(*) OVER (PARTITION BY {keys}) AS n, "
        f"row_number() OVER (PARTITION BY {keys} ORDER BY abs(err) DESC) AS r FROM {table}) GROUP BY {keys}"
    )


def exp3(frame: str, name: str, source: str = "std") -> str:
    """CTE name: rows of the test with the members' weights b1 .. b6 over a frame, and the error."""
    sums = ", ".join(f"sum(({m} - y) * ({m} - y)) OVER (PARTITION BY series ORDER BY t {frame}) AS s{k}" for k, m in enumerate(MEMBERS, 1))
    eta = "sqrt(8 * ln(6.0) / c)"
    low = "least(s1, s2, s3, s4, s5, s6)"
    e = ", ".join(f"coalesce(exp(-{eta} * (s{k} - {low})), 1) AS e{k}" for k in range(1, 7))
    whole = "(e1 + e2 + e3 + e4 + e5 + e6)"
    pred = " + ".join(f"m{k} * e{k} / {whole}" for k in range(1, 7))
    b = ", ".join(f"e{k} / {whole} AS b{k}" for k in range(1, 7))
    return f"""
{name} AS (SELECT series, t, {b}, y_true AS y, y_true - (({pred}) * sigma + mu) AS err FROM (
  SELECT *, {e} FROM (SELECT *, {sums}, count(*) OVER (PARTITION BY series ORDER BY t {frame}) AS c FROM {source} WHERE t >= first - 3 AND t <= end_))
  WHERE t > split + 1)"""


def storms() -> str:
    """CTE st: storms of the events of each type, from timestamps cut to six hours, with some records left out."""
    return """
six AS (SELECT * FROM (SELECT event_type, min(value) AS value, day(ts) AS days, CAST(hour(ts) // 6 * 6 AS INT) AS hours, date_trunc('day', ts) AS d
  FROM events GROUP BY event_type, days, hours, d) WHERE NOT (days % 9 = 4 AND hours = 6)),
recs AS (SELECT event_type AS series, row_number() OVER (PARTITION BY event_type ORDER BY d, hours) AS t, CAST(days AS INT) AS days, hours, value AS y, value / 10 AS current_speed FROM six),
lagged AS (SELECT *, lag(days) OVER (PARTITION BY series ORDER BY t) AS p_day, lag(hours) OVER (PARTITION BY series ORDER BY t) AS p_hour FROM recs),
flags AS (SELECT *, CASE WHEN p_day IS NULL THEN 1
  WHEN abs(days - p_day) > 1 AND days <> 1 THEN 1
  WHEN abs(days - p_day) > 1 THEN CAST(NOT (hours = p_hour + 6 OR (hours = 0 AND p_hour = 18)) AS INT)
  WHEN hours <> p_hour + 6 THEN CAST(NOT (hours = 0 AND p_hour = 18) AS INT)
  ELSE CAST(days - p_day > 0 AS INT) END AS start FROM lagged),
numbered AS (SELECT *, CAST(sum(start) OVER (PARTITION BY series ORDER BY t) AS BIGINT) AS storm FROM flags),
st AS (SELECT series, t, days, hours, y, current_speed, storm, t - min(t) OVER (PARTITION BY series, storm) + 1 AS k, count(*) OVER (PARTITION BY series, storm) AS length FROM numbered)"""


def user_storms() -> str:
    """CTE st: storms of all events of each user, from timestamps cut to six hours."""
    return """
recs AS (SELECT CAST(user_id AS VARCHAR) AS series, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, CAST(day(ts) AS INT) AS days,
  CAST(hour(ts) // 6 * 6 AS INT) AS hours, value AS y, value / 10 AS current_speed FROM events),
lagged AS""" + storms().partition("lagged AS")[2]


def cramer(a: dict[tuple[int, int], str], b: list[str]) -> list[str]:
    """The solution of a symmetric system of three equations by Cramer's rule; a holds the entries i <= j."""
    e = lambda i, j: f"({a[min(i, j), max(i, j)]})"

    def determinant(column: int | None) -> str:
        v = lambda i, j: f"({b[i]})" if j == column else e(i, j)
        return (
            f"({v(0, 0)} * ({v(1, 1)} * {v(2, 2)} - {v(1, 2)} * {v(2, 1)}) - {v(0, 1)} * ({v(1, 0)} * {v(2, 2)} - {v(1, 2)} * {v(2, 0)})"
            f" + {v(0, 2)} * ({v(1, 0)} * {v(2, 1)} - {v(1, 1)} * {v(2, 0)}))"
        )

    return [f"{determinant(k)} / {determinant(None)}" for k in range(3)]


def adaptive(rule: str) -> str:
    """CTE ad: training rows of m1 with the lag vector (z1, z2) of one row, k from 1: the last value and target, or the last error and 1."""
    z = "lag(m1) OVER w AS z1, lag(y) OVER w AS z2" if rule == "value" else "lag(m1) OVER w - lag(y) OVER w AS z1, 1.0 AS z2"
    return f"""
ad AS (SELECT *, 1.0 AS w0, z1 AS w1, z2 AS w2, t - first AS k FROM (
  SELECT series, t, first, last, m1, y, {z} FROM std WINDOW w AS (PARTITION BY series ORDER BY t)) WHERE t BETWEEN first + 1 AND last)"""


def adaptive_system(penalty: dict[tuple[int, int], str], source: str = "ad", extra: str = "") -> str:
    """SELECT of series and the weights v0, v1, v2 of m1 over w0, w1, w2: mean products, and the given penalties on top (SQL over the
    columns of source, aggregated)."""
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    sums = ", ".join(f"avg(m1 * w{i} * m1 * w{j}) + {penalty.get((i, j), '0')} AS a{i}{j}" for i, j in pairs)
    right = ", ".join(f"avg(m1 * w{i} * y) AS b{i}" for i in range(3))
    solved = cramer({(i, j): f"a{i}{j}" for i, j in pairs}, ["b0", "b1", "b2"])
    values = ", ".join(f"round({v}, 6) AS v{k}" for k, v in enumerate(solved))
    return f"SELECT series{extra}, {values} FROM (SELECT series, {sums}, {right} FROM {source} GROUP BY series)"
