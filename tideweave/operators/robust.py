"""Learners with absolute losses and tail risk: least absolute deviation and conditional value at risk.

Absolute values and the tail are smoothed, |r| ~ sqrt(r^2 + eps^2); damped Newton steps solve the smooth problem, and eps
falls until it doesn't matter. The tail is that of Rockafellar and Uryasev: t + mean of max(loss - t, 0) / alpha. Penalties:
ridge (squares) or lasso (absolute values, smoothed too). The multipliers at the end give a lower bound of the least
objective, so each fit tells its own gap. Training rows are a bounded stretch of a series (past * num_past + 1 rows), so
each series is one small group, and series are fitted in parallel; a series whose fit fails gets an error, not the job.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideweave.operators.learners import PARAMS, solve, solve_square


@dataclass(frozen=True)
class Robust:
    """loss: `abs` or `square`; alpha: share of the largest losses that count, 1 for all; penalty: `ridge` or `lasso`;
    free: how many leading weights aren't penalised."""

    loss: str = "abs"
    alpha: float = 1.0
    penalty: str = "lasso"
    rho: float = 0.01
    rho_v: float | None = None
    free: int = 1


def sum_lad(rho: float, n: int) -> Robust:
    """Sum (not mean) of absolute errors + rho * sum of absolute weights, all penalised, over n rows."""
    return Robust("abs", 1.0, "lasso", rho / n, free=0)


#: The named methods of the dispatcher.
METHODS = {
    "ols_ridge": Robust("square", 1.0, "ridge"),
    "ols_ridge_CVaR": Robust("square", 0.15, "ridge"),
    "ols_lasso_CVaR": Robust("square", 0.15, "lasso"),
    "lad_lasso": Robust("abs", 1.0, "lasso"),
    "lad_lasso_CVaR": Robust("abs", 0.15, "lasso"),
    "adaptive_lad_ridge": Robust("abs", 1.0, "ridge", rho_v=0.1),
    "adaptive_lad_ridge_CVaR": Robust("abs", 0.15, "ridge", rho_v=0.1),
}


def tail_mean(loss: np.ndarray, alpha: float) -> float:
    """Mean of the largest alpha * n losses, the last of them in part."""
    k = alpha * len(loss)
    top = np.sort(loss)[::-1]
    whole = int(k)
    return float((top[:whole].sum() + (k - whole) * (top[whole] if whole < len(top) else 0.0)) / k)


def penalties(spec: Robust, width: int, adaptive: int) -> np.ndarray:
    """The factor of each weight; adaptive: columns 1 + |z| of the row-major weights, 0 if they don't follow lags."""
    out = np.full(width, spec.rho)
    if adaptive and spec.rho_v is not None:
        out = out.reshape(-1, adaptive)
        out[:, 1:] = spec.rho_v
        out[0] = 0.0 if spec.free else out[0]
        return out.ravel()
    out[: spec.free] = 0.0
    return out


def objective(beta: np.ndarray, x: np.ndarray, y: np.ndarray, spec: Robust, adaptive: int = 0, factor: np.ndarray | None = None) -> float:
    """What the learner makes least; factor: that of each weight's penalty, the method's own if there is none."""
    r = np.abs(y - x @ beta)
    penalty = penalties(spec, x.shape[1], adaptive) if factor is None else factor
    cost = penalty @ (beta * beta) if spec.penalty == "ridge" else penalty @ np.abs(beta)
    return tail_mean(r if spec.loss == "abs" else r * r, spec.alpha) + float(cost)


def _smooth(theta, x, y, spec, factor, eps):
    """Value, gradient and Hessian of the smoothed problem; theta: the weights, and the tail's threshold if alpha < 1."""
    n, p = x.shape
    beta = theta[:p]
    r = y - x @ beta
    if spec.loss == "abs":
        loss = np.sqrt(r * r + eps * eps)
        first, second = r / loss, eps * eps / loss**3
    else:
        loss, first, second = r * r, 2 * r, np.full(n, 2.0)
    if spec.alpha < 1:
        z = loss - theta[p]
        root = np.sqrt(z * z + eps * eps)
        value = theta[p] + (z + root).sum() / (2 * spec.alpha * n)
        count, bend = (1 + z / root) / (2 * spec.alpha * n), eps * eps / (2 * spec.alpha * n * root**3)
    else:
        value, count, bend = loss.mean(), np.full(n, 1.0 / n), np.zeros(n)
    if spec.penalty == "ridge":
        value, slope, curve = value + factor @ (beta * beta), 2 * factor * beta, 2 * factor
    else:
        size = np.sqrt(beta * beta + eps * eps)
        value, slope, curve = value + factor @ size, factor * beta / size, factor * eps * eps / size**3
    gradient = slope - x.T @ (count * first)
    hessian = (x.T * (count * second + bend * first * first)) @ x + np.diag(curve)
    if spec.alpha < 1:
        mixed = x.T @ (bend * first)
        gradient = np.append(gradient, 1 - count.sum())
        hessian = np.block([[hessian, mixed[:, None]], [mixed[None], np.array([[bend.sum()]])]])
    return value, gradient, hessian, count, count * first


def lower_bound(x: np.ndarray, y: np.ndarray, spec: Robust, factor: np.ndarray, count: np.ndarray, pull: np.ndarray, beta: np.ndarray) -> float:
    """A value that no weights undercut (free weights: none within ten times the fitted ones, which bounds what rounding leaves
    of their balance). count: shares of the rows, at most 1 / (alpha n), that sum to 1; pull: their slopes."""
    count = np.minimum(count, 1 / (spec.alpha * len(y)))
    count = count / max(1.0, count.sum())
    if spec.loss == "abs":
        pull = np.clip(pull, -count, count)
    held = x.T @ pull
    bound = held != 0
    if spec.penalty == "lasso":
        over = np.where((factor > 0) & bound, np.abs(held) / np.maximum(factor, 1e-300), 0.0).max(initial=1.0)
        pull, held = pull / max(1.0, over), held / max(1.0, over)
        cost = 0.0
    else:
        cost = float((held[factor > 0] ** 2 / (4 * factor[factor > 0])).sum())
    if spec.loss == "square":
        cost += float((pull[count > 0] ** 2 / (4 * count[count > 0])).sum())
    free = factor <= 0
    return float(pull @ y) - cost - float(np.abs(held[free]) @ (10 * np.abs(beta[free]) + 1))


def fit_arrays(x: np.ndarray, y: np.ndarray, spec: Robust, adaptive: int = 0, steps: int = 60, factor: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and the gap between their objective and a lower bound of the least one."""
    n, p = x.shape
    if not (np.isfinite(x).all() and np.isfinite(y).all()):
        raise ValueError("features or targets are not finite")
    factor = penalties(spec, p, adaptive) if factor is None else factor
    beta = solve(x.T @ x / n + np.diag(factor + 1e-9), x.T @ y / n)
    scale = float(np.abs(y).mean()) or 1.0
    theta = beta
    if spec.alpha < 1:
        r = np.abs(y - x @ beta)
        theta = np.append(beta, np.quantile(r if spec.loss == "abs" else r * r, 1 - spec.alpha))
    best, least, bound = beta, objective(beta, x, y, spec, adaptive, factor), -np.inf
    eps = 0.5 * scale
    while eps > 1e-8 * scale:
        for _ in range(steps):
            value, gradient, hessian, count, pull = _smooth(theta, x, y, spec, factor, eps)
            step = -solve(hessian + 1e-12 * max(1.0, float(np.trace(hessian)) / len(theta)) * np.eye(len(theta)), gradient)
            drop, size = float(gradient @ step), 1.0
            if -drop < 1e-12 * max(1.0, abs(value)):  # values can't tell steps from rounding here: gradients can
                if np.abs(_smooth(theta + step, x, y, spec, factor, eps)[1]).max() >= np.abs(gradient).max():
                    break
                theta = theta + step
                continue
            while size > 1e-8 and _smooth(theta + size * step, x, y, spec, factor, eps)[0] > value + 0.1 * size * drop:
                size /= 2
            if size <= 1e-8:
                break
            theta = theta + size * step
        count, pull = _smooth(theta, x, y, spec, factor, eps)[3:]
        for at in (theta[:p], _corner(theta[:p], x, y, spec, factor, scale)):
            if at is not None and (now := objective(at, x, y, spec, adaptive, factor)) < least:
                best, least = at, now
        bound = max(bound, lower_bound(x, y, spec, factor, count, pull, best))
        if least - bound < 1e-9 * max(1.0, abs(least)):
            break
        eps /= 4
    return best, max(0.0, least - bound)


def _corner(beta: np.ndarray, x: np.ndarray, y: np.ndarray, spec: Robust, factor: np.ndarray, scale: float) -> np.ndarray | None:
    """The corner near the weights at which as many residuals vanish as weights don't: where absolute losses are least."""
    if spec.loss != "abs" or spec.alpha < 1 or spec.penalty != "lasso":
        return None
    open_ = (factor <= 0) | (np.abs(beta) > 1e-3 * scale)
    k = int(open_.sum())
    if not 0 < k <= len(y):
        return np.zeros_like(beta) if k == 0 else None
    rows = np.argsort(np.abs(y - x @ beta), kind="stable")[:k]
    out = np.zeros_like(beta)
    out[open_] = solve_square(x[rows][:, open_], y[rows])
    return out if np.isfinite(out).all() else None


def drifting_offsets(x: np.ndarray, y: np.ndarray, rho: float, rho_a: float, rho_change: float, alpha: float, past: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Weights that each row may offset, the offsets near one another: tail risk of squared errors of x'(beta + a_t)
    + rho |beta|^2 + rho_a / n * sum |a_t|^2 over the first n - past rows + rho_change / n * sum of |a_t - a_t-k|^2, 0 < k < past, over the
    rows after the first `past`. x begins with the intercept, whose weight isn't penalised.

    The least penalty of offsets that move the forecasts by g is a quadratic form of g, so the offsets are n more features of a ridge.
    Gives beta, the movements g, the objective and its gap to a lower bound.
    """
    n, p = x.shape
    form = np.diag(np.where(np.arange(n) < n - past, rho_a / n, 0.0))
    for k in range(1, past):
        for t in range(past, n):
            at = np.zeros(n)
            at[t], at[t - k] = 1.0, -1.0
            form += rho_change / n * np.outer(at, at)
    spread = np.linalg.inv(form + 1e-12 * np.trace(form) * np.eye(n))
    values, vectors = np.linalg.eigh((x @ x.T) * spread)
    keep = values > 1e-12 * values[-1]
    moves = vectors[:, keep] * np.sqrt(values[keep])
    factor = np.concatenate([[0.0], np.full(p - 1, rho), np.ones(moves.shape[1])])
    spec, wide = Robust("square", alpha, "ridge"), np.column_stack([x, moves])
    theta, gap = fit_arrays(wide, y, spec, factor=factor)
    return theta[:p], moves @ theta[p:], objective(theta, wide, y, spec, factor=factor), gap


def drifting_series(rows: DataFrame, rho: float, rho_a: float, rho_change: float, alpha: float, past: int) -> DataFrame:
    """series, method, n_rows, theta (the common weights), objective, gap, error of drifting_offsets()."""

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t")
        try:
            x, y = np.stack(part["x"].to_numpy()).astype(float), part["y"].to_numpy(float)
            beta, _, least, gap = drifting_offsets(x, y, rho, rho_a, rho_change, alpha, past)
            row = (key[0], "drifting_offsets", len(y), beta.tolist(), least, gap, None)
        except (ValueError, np.linalg.LinAlgError) as e:
            row = (key[0], "drifting_offsets", len(part), None, None, None, str(e))
        return pd.DataFrame([row], columns=["series", "method", "n_rows", "theta", "objective", "gap", "error"])

    return rows.select("series", "t", "x", "y").groupBy("series").applyInPandas(fit, PARAMS + ", objective double, gap double, error string")


def box_path(x: np.ndarray, y: np.ndarray, base: np.ndarray, epsilon: float, delta: float, close: float = 1e-5, steps: int = 60_000) -> tuple[np.ndarray, float, float]:
    """Weights of each row with the least sum of absolute errors, within epsilon of base and delta of the row before, element by
    element; the sum, and its gap to a lower bound. Primal-dual steps; a path that moves too fast is drawn towards base."""
    n, p = x.shape
    pace = 0.99 / np.sqrt(float((x * x).sum(axis=1).max(initial=0.0)) + 4.0)
    beta = np.tile(base, (n, 1)).astype(float)
    ahead, u, v = beta.copy(), np.zeros(n), np.zeros((max(0, n - 1), p))
    best, least, bound = beta, float(np.abs(y - x @ base).sum()), -np.inf

    def turned(u, v):
        """What the multipliers put on each weight."""
        out = u[:, None] * x
        out[1:] -= v
        out[:-1] += v
        return out

    for step in range(steps):
        u = np.clip(u + pace * (y - (x * ahead).sum(axis=1)), -1, 1)
        moved = v + pace * (ahead[1:] - ahead[:-1])
        v = np.sign(moved) * np.maximum(np.abs(moved) - pace * delta, 0.0)
        new = np.clip(beta + pace * turned(u, v), base - epsilon, base + epsilon)
        ahead, beta = 2 * new - beta, new
        if step % 100 == 99:
            fast = float(np.abs(np.diff(beta, axis=0)).max(initial=0.0))
            path = base + (beta - base) * min(1.0, delta / fast if fast > 0 else 1.0)
            if (now := float(np.abs(y - (x * path).sum(axis=1)).sum())) < least:
                best, least = path, now
            pull = turned(u, v)
            bound = max(bound, float(u @ y - (pull * base).sum() - epsilon * np.abs(pull).sum() - delta * np.abs(v).sum()))
            if least - bound <= close * max(1.0, least):
                break
    return best, least, max(0.0, least - bound)


def box_paths(rows: DataFrame, epsilon: float, delta: float, rho: float = 0.01) -> DataFrame:
    """series, n_rows, theta (the last row's weights), objective, gap, error of box_path() around each series' ridge weights."""

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t")
        try:
            x, y = np.stack(part["x"].to_numpy()).astype(float), part["y"].to_numpy(float)
            base = solve(x.T @ x / len(y) + rho * np.eye(x.shape[1]), x.T @ y / len(y))
            path, least, gap = box_path(x, y, base, epsilon, delta)
            row = (key[0], "box_path", len(y), path[-1].tolist(), least, gap, None)
        except (ValueError, np.linalg.LinAlgError) as e:
            row = (key[0], "box_path", len(part), None, None, None, str(e))
        return pd.DataFrame([row], columns=["series", "method", "n_rows", "theta", "objective", "gap", "error"])

    return rows.select("series", "t", "x", "y").groupBy("series").applyInPandas(fit, PARAMS + ", objective double, gap double, error string")


def fit_series(rows: DataFrame, methods: dict[str, Robust], features: str = "x", adaptive: int = 0) -> DataFrame:
    """series, method, n_rows, theta, objective, gap, error: the training rows of a series (a bounded stretch) are one group;
    if a fit fails, theta is null and error says why."""

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t")
        out = []
        for m, spec in methods.items():
            try:
                x, y = np.stack(part["f"].to_numpy()).astype(float), part["y"].to_numpy(float)
                theta, gap = fit_arrays(x, y, spec, adaptive)
                out.append((key[0], m, len(y), theta.tolist(), objective(theta, x, y, spec, adaptive), gap, None))
            except (ValueError, np.linalg.LinAlgError, FloatingPointError) as e:
                out.append((key[0], m, len(part), None, None, None, str(e)))
        return pd.DataFrame(out, columns=["series", "method", "n_rows", "theta", "objective", "gap", "error"])

    fitted = PARAMS + ", objective double, gap double, error string"
    return rows.select("series", "t", F.col(features).alias("f"), "y").groupBy("series").applyInPandas(fit, fitted)
