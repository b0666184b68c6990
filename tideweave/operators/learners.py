"""Learners whose fit is a function of sums over rows: ridge, and ridge with weights that follow the lag vector.

Each partition adds up the outer products of its rows; one row for each series and partition is shuffled; the solve
of a series works on those sums. Nothing but the weights leaves the executors, and rows are never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUMS = "series string, n long, width int, sums binary"
PARAMS = "series string, method string, n_rows long, theta array<double>"


@dataclass(frozen=True)
class Penalty:
    """rho_beta on the weights of each row, rho on the constant part, rho_v on the part that follows the lags."""

    rho_beta: float = 0.01
    rho: float = 0.01
    rho_v: float = 0.1


def gram(rows: DataFrame, features: str = "f", target: str = "y", extra: str | None = None) -> DataFrame:
    """For each series the sums of (f, y)(f, y)' over its rows, and of w w' with `extra` as w, as one row.

    sums: the outer products of [f, y], then of w, flattened.
    """

    def partial(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for b in source:
            if not b.num_rows:
                continue
            names = np.array(b.column(0).to_pylist(), object)
            blocks = [np.array(b.column(k).to_pylist(), np.float64) for k in range(1, b.num_columns)]
            full = np.column_stack([blocks[0], blocks[1]])
            for s in dict.fromkeys(names):
                at = names == s
                add = [full[at].T @ full[at]] + [w[at].T @ w[at] for w in blocks[2:]]
                if s in held:
                    held[s][0] += int(at.sum())
                    held[s][1] = [p + q for p, q in zip(held[s][1], add)]
                else:
                    held[s] = [int(at.sum()), add]
        if held:
            yield _sums_batch([(s, n, len(a[0]), a) for s, (n, a) in held.items()])

    def merge(key: tuple, source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, width, total = 0, 0, None
        for b in source:
            for m, w, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                part = np.frombuffer(raw, np.float64)
                n, width, total = n + m, w, part.copy() if total is None else total + part
        yield _sums_batch([(key[0].as_py(), n, width, [total])])

    used = rows.select("series", features, target, *([extra] if extra else []))
    return used.mapInArrow(partial, SUMS).groupBy("series").applyInArrow(merge, SUMS)


def _sums_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()),
         pa.array([np.concatenate([np.asarray(a).ravel() for a in r[3]]).tobytes() for r in rows], pa.binary())],
        names=["series", "n", "width", "sums"],
    )


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution of a x = b; a is symmetric and not negative. Where a is singular, the least one after its diagonal is brought to one."""
    scale = 1 / np.sqrt(np.maximum(np.abs(np.diag(a)), 1e-300))
    scale[np.diag(a) == 0] = 1.0
    scaled = a * scale[:, None] * scale
    if not np.isfinite(scaled).all():
        raise ValueError("the sums are not finite")
    values, vectors = np.linalg.eigh((scaled + scaled.T) / 2)
    keep = values > 1e-12 * max(values[-1], 1e-300)
    if keep.all() and values[0] > 1e-9 * values[-1]:
        return np.linalg.solve(a, b)
    return scale * (vectors[:, keep] @ ((vectors[:, keep].T @ (scale * b)) / values[keep]))


def solve_square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution of a square system, not a number where it is singular."""
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.full(a.shape[1], np.nan)


def _fitted(sums: DataFrame, fits: list[tuple[str, object]]) -> DataFrame:
    """fits: method name and function (n, sums of [f, y], sums of w) -> weights."""

    def each(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            out = []
            for s, n, width, raw in zip(*(c.to_pylist() for c in b.columns)):
                flat = np.frombuffer(raw, np.float64)
                full, rest = flat[: width * width].reshape(width, width), flat[width * width :]
                w = rest.reshape(int(len(rest) ** 0.5), -1) if len(rest) else None
                out += [(s, name, n, [float(v) for v in fit(n, full, w)]) for name, fit in fits]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64(), pa.list_(pa.float64())))],
                    names=["series", "method", "n_rows", "theta"],
                )

    return sums.mapInArrow(each, PARAMS)


def ridge(rows: DataFrame, rho: float, method: str = "ridge", free_intercept: bool = False) -> DataFrame:
    """Least mean squared error + rho * |beta|^2; with free_intercept the first weight isn't penalised."""

    def fit(n, full, _):
        p = len(full) - 1
        penalty = np.full(p, rho)
        penalty[0] = 0.0 if free_intercept else rho
        return solve(full[:p, :p] / n + np.diag(penalty), full[:p, p] / n)

    return _fitted(gram(rows.withColumn("f", F.col("x"))), [(method, fit)])


def unsquared_ridge(rows: DataFrame, rho: float, method: str = "unsquared_ridge") -> DataFrame:
    """Least |y - X beta| / n + rho * |beta|, norms that aren't squared: ridge weights whose penalty balances itself."""

    def fit(n, full, _):
        p = len(full) - 1
        a, b, yy = full[:p, :p], full[:p, p], max(float(full[p, p]), 0.0)
        zero = np.zeros(p)
        if yy == 0.0 or np.linalg.norm(b) <= rho * n * np.sqrt(yy):
            return zero

        def at(log_ratio):
            """Weights for a ridge of exp(log_ratio), and how far this is over what the weights themselves ask for."""
            beta = solve(a + np.exp(log_ratio) * np.eye(p), b)
            miss = np.sqrt(max(yy - 2 * b @ beta + beta @ a @ beta, 0.0))
            return beta, np.exp(log_ratio) * np.linalg.norm(beta) - rho * n * miss

        low, high = np.log(max(np.trace(a), 1e-300)) - 40, np.log(max(np.trace(a), 1e-300)) + 20
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if at(middle)[1] < 0 else (low, middle)
        return at((low + high) / 2)[0]

    return _fitted(gram(rows.withColumn("f", F.col("x"))), [(method, fit)])


def free_path_ridge(rows: DataFrame, rho: float, rho_v: float, stable: int, method: str = "free_path") -> DataFrame:
    """Weights b0 for the first `stable` - 1 rows, then b0 + V_t z_t with a matrix V_t of its own for each row, near its neighbours':
    mean squared error + rho / (stable - 1) |b0|^2 + rho_v / (n - stable + 1) (sum |beta_t|^2 + sum |V_t+1 - V_t|^2).

    rows: series, t, x, y, z; the training rows of a series are a bounded group. A block-tridiagonal system: V_t has the form
    c_t z_t' plus neighbours, and is solved row by row. theta: b0, then the V of the last row.
    """
    import pandas as pd

    def path(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t")
        x, z, y = (np.stack(part[c].to_numpy()).astype(float) if c != "y" else part[c].to_numpy(float) for c in ("x", "z", "y"))
        b0, v = free_path(x, z, y, rho, rho_v, stable)
        last = v[-1].ravel() if len(v) else np.zeros(0)
        return pd.DataFrame([(key[0], method, len(y), [*b0.tolist(), *last.tolist()])], columns=["series", "method", "n_rows", "theta"])

    return rows.select("series", "t", "x", "z", "y").groupBy("series").applyInPandas(path, PARAMS)


def free_path(x: np.ndarray, z: np.ndarray, y: np.ndarray, rho: float, rho_v: float, stable: int) -> tuple[np.ndarray, np.ndarray]:
    """b0 and V_t of the rows from `stable` on (1-based)."""
    n, p = x.shape
    if stable == 1:
        rho, stable = 0.0, 2
    q, first = z.shape[1], stable - 1
    late = n - first
    tie = rho_v / late
    # unknowns: b0 (p), then V_t (p * q each); the coupling of the V is tie * second differences
    fixed = np.zeros((p, p)) + np.eye(p) * rho / max(1, first) + x[:first].T @ x[:first] / n
    right = x[:first].T @ y[:first] / n
    size = p * q
    inverse, to_b0, target = [], [], []
    carried, carried_b0, carried_y = np.zeros((size, size)), np.zeros((size, p)), np.zeros(size)
    for k in range(late):
        f = np.kron(x[first + k], z[first + k])
        spread = np.kron(np.eye(p), z[first + k][:, None])  # beta = b0 + spread' V
        ends = (k > 0) + (k < late - 1)
        a = np.outer(f, f) / n + tie * (spread @ spread.T) + tie * ends * np.eye(size)
        b = np.outer(f, x[first + k]) / n + tie * spread
        c = f * y[first + k] / n
        fixed = fixed + np.outer(x[first + k], x[first + k]) / n + tie * np.eye(p)
        right = right + x[first + k] * y[first + k] / n
        a, b, c = a - carried, b - carried_b0, c - carried_y
        inv = np.linalg.pinv(a, rcond=1e-11, hermitian=True)  # flat directions stay zero
        inverse.append(inv)
        to_b0.append(b)
        target.append(c)
        # the next block's system, less what this block explains of it (they touch by -tie * I)
        carried, carried_b0, carried_y = tie * tie * inv, -tie * (inv @ b), -tie * (inv @ c)
    for inv, b, c in zip(inverse, to_b0, target):
        fixed, right = fixed - b.T @ inv @ b, right - b.T @ inv @ c
    b0 = solve(fixed, right)
    v, after = [np.zeros(size)] * late, np.zeros(size)
    for k in range(late - 1, -1, -1):
        after = inverse[k] @ (target[k] - to_b0[k] @ b0 + tie * after)
        v[k] = after
    return b0, np.array(v).reshape(late, p, q)


def adaptive_features(rows: DataFrame) -> DataFrame:
    """Adds w = (1, z) and f, the products x_i * w_j with i outermost."""
    w = F.concat(F.array(F.lit(1.0)), F.col("z"))
    return rows.withColumn("w", w).withColumn("f", F.flatten(F.transform("x", lambda a: F.transform("w", lambda b: a * b))))


def adaptive_ridge(rows: DataFrame, fits: list[tuple[str, Penalty]]) -> DataFrame:
    """Weights beta_t = b0 + V z_t, row-major with 1 + |z| columns, for each named penalty; one Gram matrix serves all.

    Least (sum of squared errors + rho_beta * sum |beta_t|^2) / N + rho * |b0|^2 + rho_v * |V|^2.
    """

    def of(penalty: Penalty):
        def fit(n, full, w):
            q, d = len(w), len(full) - 1
            p = d // q
            ridge_part = np.full(q, penalty.rho_v)
            ridge_part[0] = penalty.rho
            a = full[:d, :d] / n + np.kron(np.eye(p), penalty.rho_beta / n * w + np.diag(ridge_part))
            return solve(a, full[:d, d] / n)

        return fit

    return _fitted(gram(adaptive_features(rows), extra="w"), [(name, of(p)) for name, p in fits])


def slowly_varying_ridge(rows: DataFrame, rho: float, rho_change: float, method: str = "slowly_varying") -> DataFrame:
    """Adaptive weights with a penalty on their change from row to row: mean squared error + rho * mean |beta_t|^2 +
    rho_change * mean |beta_t - beta_{t-1}|^2. rows: dense t, x, y, z."""
    from tideweave.operators.windows import blocked

    w = F.concat(F.array(F.lit(1.0)), F.col("z"))
    with_w = rows.withColumn("w", w)
    lagged = blocked(with_w, 1, lambda f, win: f.withColumn("_pw", F.lag("w").over(win)))
    dw = F.coalesce(F.zip_with("w", "_pw", lambda a, b: a - b), F.transform("w", lambda v: F.lit(0.0)))
    data = lagged.withColumn("f", F.flatten(F.transform("x", lambda a: F.transform("w", lambda b: a * b)))).withColumn("_both", F.concat("w", dw))

    def fit(n, full, both):
        q, d = len(both) // 2, len(full) - 1
        p = d // q
        small = rho / n * both[:q, :q] + rho_change / max(1, n - 1) * both[q:, q:]
        return solve(full[:d, :d] / n + np.kron(np.eye(p), small) + 1e-10 * np.eye(d), full[:d, d] / n)

    return _fitted(gram(data, extra="_both"), [(method, fit)])


def stable_part_ridge(rows: DataFrame, rho: float, rho_v: float, stable: int, method: str = "stable_part", over_all: bool = False) -> DataFrame:
    """The first `stable` - 1 rows share b0, later rows follow the lags; penalties are means over their own rows.

    over_all: the variant that takes rho over `stable`, and sums the penalty of the weights over all rows, over n - stable.
    """
    w = F.concat(F.array(F.lit(1.0)), F.when(F.col("k") < stable, F.transform("z", lambda v: F.lit(0.0))).otherwise(F.col("z")))
    late = F.col("w") if over_all else F.when(F.col("k") < stable, F.transform("w", lambda v: F.lit(0.0))).otherwise(F.col("w"))
    data = rows.withColumn("w", w).withColumn("late", late).withColumn("f", F.flatten(F.transform("x", lambda a: F.transform("w", lambda b: a * b))))

    def fit(n, full, ww):
        q, d = len(ww), len(full) - 1
        p = d // q
        first = np.zeros(q)
        first[0] = rho / (stable if over_all else stable - 1) if stable > 1 else 0.0
        late_rows = n - stable if over_all else n - stable + 1
        a = full[:d, :d] / n + np.kron(np.eye(p), rho_v / max(1, late_rows) * ww + np.diag(first))
        return solve(a, full[:d, d] / n)

    return _fitted(gram(data, extra="late"), [(method, fit)])


def rolling_ridge(panel: DataFrame, window: int, rho: float, first: int, width: int) -> DataFrame:
    """series, t, beta: ridge weights fitted anew on the `window` rows before each row t >= first; width: elements of x.

    Frames add up products; a row carries its sums to the solve, not the rows of its frame.
    """
    from tideweave.operators.windows import blocked

    schema = T.StructType([T.StructField("series", T.StringType()), T.StructField("t", T.LongType()), T.StructField("beta", T.ArrayType(T.DoubleType()))])
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    element = lambda k: F.get("x", F.lit(k))
    terms = [element(i) * element(j) for i, j in pairs] + [element(i) * F.col("y") for i in range(width)]

    def work(frame, w):
        before = w.rowsBetween(-window, -1)
        frame = frame.withColumns({f"_p{k}": p for k, p in enumerate(terms)})
        return frame.select("series", "t", "_block", F.count("y").over(before).alias("_n"), F.array(*(F.sum(f"_p{k}").over(before) for k in range(len(terms)))).alias("_sums"))

    def fit(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = np.array([i * width + j for i, j in pairs])
        for b in source:
            n, sums = b.column(2).to_numpy().astype(float), b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            a = np.zeros((b.num_rows, width * width))
            a[:, upper] = sums[:, : len(pairs)]
            a = a.reshape(-1, width, width)
            a = (a + np.triu(a, 1).transpose(0, 2, 1)) / n[:, None, None] + rho * np.eye(width)
            betas = [solve(m, v).tolist() for m, v in zip(a, sums[:, len(pairs) :] / n[:, None])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(betas, pa.list_(pa.float64()))], names=["series", "t", "beta"])

    rows = blocked(panel, window, work).filter(F.col("t") >= first).filter("_n > 0")
    return rows.select("series", "t", "_n", "_sums").mapInArrow(fit, schema)
