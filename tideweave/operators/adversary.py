"""Weights against the worst targets of a box: an adversary by branch and bound, and cutting planes around it.

Given forecasts x_t of a horizon and common weights b, S(y) is the least sum of |y_t - x_t'beta_t| over weights of each step within
epsilon of b and within delta of the step before, element by element. The adversary picks y in lo .. hi where S is largest. S is
convex, so that is a corner of the box.

Branch and bound over all series at once: an open node is a row with its own box. A path of weights costs at most its loss at the
box's centre plus the box's half widths, so S(centre) + half widths is a bound of the node; the corner that the residuals at the
centre point to gives a value. A round bounds all open nodes, takes each series' best value, drops the nodes whose bound isn't over
it, and halves the widest side of the others. Values come from multipliers and bounds from paths, so both hold as they are.

Cutting planes: the weights have the least mean squared error of training + rho |b|^2 + reg * (what the adversary makes of them). The
multipliers of the adversary's answer are a plane under its value for all weights; the planes of a series are rows of a
pool. A round fits all open series to their planes, from sums of products, and asks the adversary of all of them; series
whose gap is small enough leave.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideweave.operators.learners import gram
from tideweave.sources.rounds import written


@dataclass(frozen=True)
class Tube:
    """epsilon, delta: as above; close: gap of S, relative, at which steps end; steps: how many they are at most."""

    epsilon: float = 0.1
    delta: float = 0.1
    close: float = 1e-4
    steps: int = 40_000


def losses(x: np.ndarray, ys: np.ndarray, base: np.ndarray, tube: Tube) -> tuple[np.ndarray, ...]:
    """S of several targets at once: upper and lower bounds, residuals of the paths, and the planes under S as a function of the base:
    S >= constant + slope'base. x: steps by weights; ys: targets by steps. Each target stops on its own."""
    m, (n, p) = len(ys), x.shape
    pace = 0.99 / np.sqrt(float((x * x).sum(axis=1).max(initial=0.0)) + 4.0)
    low, high = base - tube.epsilon, base + tube.epsilon
    beta = np.broadcast_to(base, (m, n, p)).copy()
    ahead, u, v = beta.copy(), np.zeros((m, n)), np.zeros((m, max(0, n - 1), p))
    rest = ys - x @ base
    upper, lower = np.abs(rest).sum(axis=1), np.full(m, -np.inf)
    constant, slope = np.zeros(m), np.zeros((m, p))
    active = np.arange(m)
    for step in range(1, tube.steps + 1):
        u = np.clip(u + pace * (ys[active] - (ahead * x).sum(axis=2)), -1, 1)
        moved = v + pace * np.diff(ahead, axis=1)
        v = np.sign(moved) * np.maximum(np.abs(moved) - pace * tube.delta, 0.0)
        pull = u[:, :, None] * x
        pull[:, 1:] -= v
        pull[:, :-1] += v
        new = np.clip(beta + pace * pull, low, high)
        ahead, beta = 2 * new - beta, new
        if step % 50 and step < tube.steps:
            continue
        fast = np.abs(np.diff(beta, axis=1)).max(axis=(1, 2), initial=0.0)
        share = np.where(fast > tube.delta, tube.delta / np.maximum(fast, 1e-300), 1.0)
        left = ys[active] - ((base + (beta - base) * share[:, None, None]) * x).sum(axis=2)
        now = np.abs(left).sum(axis=1)
        better = now < upper[active]
        upper[active[better]], rest[active[better]] = now[better], left[better]
        flat = (u * ys[active]).sum(axis=1) - tube.epsilon * np.abs(pull).sum(axis=(1, 2)) - tube.delta * np.abs(v).sum(axis=(1, 2))
        tilt = -pull.sum(axis=1)
        bound = flat + tilt @ base
        better = bound > lower[active]
        at = active[better]
        lower[at], constant[at], slope[at] = bound[better], flat[better], tilt[better]
        go = upper[active] - lower[active] > tube.close * np.maximum(1.0, upper[active])
        if not go.any():
            break
        active, u, v, beta, ahead = active[go], u[go], v[go], beta[go], ahead[go]
    return upper, lower, rest, constant, slope


NODES = (
    "series string, lo array<double>, hi array<double>, bound double, value double, worst array<double>, constant double, slope array<double>, widest int"
)


def _bounded(nodes: DataFrame, tube: Tube) -> DataFrame:
    """Bounds and values of nodes: series, lo, hi, and the series' x (flat) and base."""

    def work(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in source:
            for series, rows in part.groupby("series", sort=False):
                base = np.asarray(rows["base"].iloc[0], float)
                x = np.asarray(rows["x"].iloc[0], float).reshape(-1, len(base))
                lo, hi = (np.stack(rows[c].to_numpy()).astype(float) for c in ("lo", "hi"))
                half = (hi - lo) / 2
                upper, _, rest, _, _ = losses(x, (lo + hi) / 2, base, tube)
                corner = np.where(rest >= 0, hi, lo)
                _, value, _, constant, slope = losses(x, corner, base, tube)
                yield pd.DataFrame({
                    "series": series, "lo": list(lo), "hi": list(hi), "bound": upper + half.sum(axis=1), "value": value, "worst": list(corner), "constant": constant,
                    "slope": list(slope), "widest": np.where(half.max(axis=1) > 0, half.argmax(axis=1), -1),
                })

    return nodes.select("series", "lo", "hi", "x", "base").mapInPandas(work, NODES)


def adversary(cases: DataFrame, tube: Tube = Tube(), close: float = 1e-3) -> DataFrame:
    """series, worst (targets), value (the sum of errors there), bound (of the value at any targets), constant and slope (a plane under
    the value, over the weights), nodes (looked at) and pruned (of these, dropped with an open side). cases: series, x (flat), base, lo, hi.

    close: how much, relative, a dropped node may be over the best value. A series takes as many rounds as its horizon at most.
    """
    cases = written(cases.select("series", "x", "base", "lo", "hi"), "cases")
    fixed = cases.select("series", "x", "base")
    open_, log = cases.select("series", "lo", "hi"), []
    best = None
    while True:
        found = written(_bounded(open_.join(fixed, "series"), tube), "nodes")
        log.append(found)
        top = found.groupBy("series").agg(F.max_by(F.struct("value", "worst", "constant", "slope"), "value").alias("top"))
        if best is not None:
            both = best.select("series", "top").unionByName(top)
            top = both.groupBy("series").agg(F.max_by("top", F.col("top.value")).alias("top"))
        best = written(top, "best")
        limit = F.col("top.value") + close * F.greatest(F.lit(1.0), F.col("top.value"))
        kept = found.filter("widest >= 0").join(best, "series").filter(F.col("bound") > limit)
        log[-1] = found.join(kept.select("series", "lo", "hi", F.lit(True).alias("split")), ["series", "lo", "hi"], "left").select(
            "series", "bound", (F.col("split").isNull() & (F.col("widest") >= 0)).alias("pruned"), F.col("split").isNull().alias("leaf")
        )
        half = lambda keep, other: F.transform(keep, lambda v, k: F.when(k == F.col("widest"), F.get(other, k)).otherwise(v))
        down = kept.select("series", "lo", half("hi", "lo").alias("hi"))
        up = kept.select("series", half("lo", "hi").alias("lo"), "hi")
        open_ = written(down.unionByName(up), "open")
        if open_.isEmpty():
            break
    every = reduce(DataFrame.unionByName, log)
    counts = every.groupBy("series").agg(
        F.count("*").alias("nodes"), F.count_if("pruned").alias("pruned"), F.max(F.when(F.col("leaf"), F.col("bound"))).alias("leaves")
    )
    return best.join(counts, "series").select("series", "top.*", F.greatest("leaves", "top.value").alias("bound"), "nodes", "pruned")


def horizon_cases(rows: DataFrame, base: DataFrame, share: float) -> DataFrame:
    """Cases for adversary(): the rows of a horizon (series, t, x, y; few per series) and the series' weights (series, theta); the box of a
    target is y - share * |y| .. y + share * |y|."""
    sides = F.struct("t", "x", (F.col("y") - share * F.abs("y")).alias("lo"), (F.col("y") + share * F.abs("y")).alias("hi"))
    held = rows.groupBy("series").agg(F.array_sort(F.collect_list(sides)).alias("h"))
    return held.select("series", F.flatten("h.x").alias("x"), F.col("h.lo").alias("lo"), F.col("h.hi").alias("hi")).join(base.select("series", F.col("theta").alias("base")), "series")


MASTER = "series string, base array<double>, least double, below double"


def _fitted(sums: DataFrame, pool: DataFrame, rho: float, reg: float) -> DataFrame:
    """For each series the weights that are best for its planes: their part of the objective without the adversary's, and a lower bound of
    the whole objective. pool: series, planes (an array of constant and slope)."""

    def work(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in source:
            out = []
            for row in part.itertuples():
                full = np.frombuffer(row.sums, np.float64)[: row.width**2].reshape(row.width, -1) / row.n
                a, b, c = full[:-1, :-1] + rho * np.eye(row.width - 1), full[:-1, -1], float(full[-1, -1])
                constant = np.array([p["constant"] for p in row.planes])
                slope = np.array([p["slope"] for p in row.planes], float)
                beta, below = _least(a, b, c, reg * constant, reg * slope)
                out.append((row.series, beta.tolist(), float(beta @ a @ beta - 2 * b @ beta + c), below))
            yield pd.DataFrame(out, columns=["series", "base", "least", "below"])

    return sums.join(pool, "series").select("series", "n", "width", "sums", "planes").mapInPandas(work, MASTER)


def _least(a: np.ndarray, b: np.ndarray, c: float, constant: np.ndarray, slope: np.ndarray) -> tuple[np.ndarray, float]:
    """The weights with the least beta'A beta - 2 b'beta + c + the highest of the planes, and a lower bound of that, by shares of the planes."""
    inverse = np.linalg.inv(a)
    bend = slope @ inverse @ slope.T / 2
    pace = 1 / max(float(np.linalg.eigvalsh(bend)[-1]), 1e-12)
    share, ahead, speed = np.full(len(constant), 1 / len(constant)), np.full(len(constant), 1 / len(constant)), 1.0
    weights = lambda s: inverse @ (b - slope.T @ s / 2)
    below = lambda s: c + constant @ s - (b - slope.T @ s / 2) @ weights(s)
    for _ in range(5000):
        new = _simplex(ahead + pace * (constant + slope @ weights(ahead)))
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        ahead = new + (speed - 1) / faster * (new - share)
        done = np.abs(new - share).max() < 1e-13
        share, speed = new, faster
        if done:
            break
    return weights(share), float(below(share))


def _simplex(v: np.ndarray) -> np.ndarray:
    """The nearest shares that sum to one."""
    down = np.sort(v)[::-1]
    over = np.cumsum(down) - 1
    k = np.flatnonzero(down - over / np.arange(1, len(v) + 1) > 0)[-1]
    return np.maximum(v - over[k] / (k + 1), 0.0)


def worst_case_ridge(train: DataFrame, horizon: DataFrame, share: float, tube: Tube = Tube(), reg: float = 0.1, rho: float = 0.1, threshold: float = 1e-2, max_cuts: int = 10) -> DataFrame:
    """series, theta, objective (an upper bound), below (a lower bound of the least one), gap, rounds (a plane each), worst (targets) and value, nodes, pruned.

    train, horizon: series, t, x, y. The first plane is that losses aren't negative, so the first weights are the ridge's. A series leaves when its gap is under threshold, or after max_cuts rounds.
    """
    sums, horizon = written(gram(train.withColumn("f", F.col("x"))), "sums"), written(horizon, "horizon")
    none = sums.select("series", F.array(F.struct(F.lit(0.0).alias("constant"), F.array_repeat(F.lit(0.0), F.col("width") - 1).alias("slope"))).alias("planes"))
    pool = written(none.select("series", F.explode("planes").alias("plane")), "planes")  # S isn't negative: a first plane
    open_, done = sums, []
    for turn in range(1, max_cuts + 1):
        planes = pool.groupBy("series").agg(F.collect_list("plane").alias("planes"))  # max_cuts + 1 at most
        fits = written(_fitted(open_, planes, rho, reg), "fits")
        cases = horizon_cases(horizon, fits.select("series", F.col("base").alias("theta")), share)
        answer = adversary(cases, tube)
        now = fits.join(answer, "series").withColumn("objective", F.col("least") + reg * F.col("bound"))
        now = written(now.withColumns({"gap": F.col("objective") - F.col("below"), "rounds": F.lit(turn)}), "answers")
        left = F.lit(turn == max_cuts) | (F.col("gap") <= threshold)
        done.append(now.filter(left))
        more = now.filter(~left)
        if more.isEmpty():
            break
        added = more.select("series", F.struct("constant", "slope").alias("plane"))
        pool = written(pool.join(more.select("series"), "series", "left_semi").unionByName(added), "planes")
        open_ = open_.join(more.select("series"), "series", "left_semi")
    out = reduce(DataFrame.unionByName, done)
    return out.select("series", F.col("base").alias("theta"), "objective", "below", "gap", "rounds", "worst", "value", "nodes", "pruned")
