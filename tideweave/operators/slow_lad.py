"""Absolute losses under weights that change slowly: beta_t = b0 + V_t z_t with |V_t - V_t-1|^2 <= delta.

Least mean |y_t - x_t'beta_t| + rho |b0|^2 + rho_v * mean |V_t|^2; x begins with the intercept, whose weights (of b0 and of V) aren't
penalised. The chain of a series is cut into stretches of consecutive rows, one row of state each. In a round every
stretch solves its own part, drawn towards what it and its neighbours last made of the two ends of the edge between
them, and towards the series' mean of b0; then stretches exchange their ends, and add up their b0. So a series of any
length is many tasks, and a round shuffles two ends and one b0 for each stretch.

Inside a stretch, residuals and steps are split from the weights. The weights come from a linear system whose matrix is a
chain times an identity, plus one product of features per row: it is solved in the rows, whatever the number of weights.

At the end the objective (of a path that is drawn towards b0 until no step is too long) and a lower bound of the least one
(from the multipliers of all stretches) are summed over the stretches. The bound holds for all weights if the intercept's lie
within ten times the fitted ones.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideweave.sources.rounds import forgotten, written


@dataclass(frozen=True)
class Slow:
    """rho, rho_v, delta: as above; pull, stiff: weights of what holds residuals and steps to the weights; inner: passes over a
    stretch in a round."""

    rho: float = 0.01
    rho_v: float = 0.1
    delta: float = 0.01
    pull: float = 0.3
    stiff: float = 0.5
    inner: int = 60

    @property
    def longest(self) -> float:
        return float(np.sqrt(self.delta))

    @property
    def hold(self) -> float:
        return self.stiff / max(self.longest, 1e-4)


#: How far each pass goes beyond its answer.
RELAX = 1.6


def features(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The products of each row's x and z, x outermost."""
    return (x[:, :, None] * z[:, None, :]).reshape(len(x), -1)


def shortened(steps: np.ndarray, longest: float) -> np.ndarray:
    """Rows whose norm is over `longest` brought back to it."""
    norm = np.linalg.norm(steps, axis=-1, keepdims=True)
    return steps * np.minimum(1.0, longest / np.maximum(norm, 1e-300))


class Stretch:
    """Rows of a series with their weights, split residuals and steps, and the multipliers of both."""

    def __init__(self, x, z, y, head: bool, tail: bool, spec: Slow):
        self.x, self.y, self.head, self.tail, self.spec = x, y, head, tail, spec
        self.f, self.free = features(x, z), z.shape[1]
        n, d = self.f.shape
        self.v, self.r, self.ur = np.zeros((n, d)), y.copy(), np.zeros(n)
        self.step, self.us = np.zeros((max(0, n - 1), d)), np.zeros((max(0, n - 1), d))
        self.b, self.ub = np.zeros(x.shape[1]), np.zeros(x.shape[1])
        self.ends, self.u_ends = np.zeros((2, d)), np.zeros((2, d))

    def solve(self, mean: np.ndarray) -> None:
        """Passes over the rows, with the ends drawn towards self.ends - self.u_ends, b0 towards mean - self.ub."""
        s, k, hold = self.spec, self.spec.pull, self.spec.hold
        n, d = self.f.shape
        q, small = self.free, 1e-3 * k
        chain = np.zeros((n, n))
        if n > 1:
            at = np.arange(n - 1)
            chain[at, at] += hold
            chain[at + 1, at + 1] += hold
            chain[at, at + 1] = chain[at + 1, at] = -hold
        chain[0, 0] += hold * self.head
        chain[-1, -1] += hold * self.tail
        held, loose = np.linalg.inv(chain + 2 * s.rho_v * np.eye(n)), np.linalg.inv(chain + small * np.eye(n))
        ff, fp = self.f[:, :q], self.f[:, q:]
        pull_b = k * n
        kernel = held * (fp @ fp.T) + loose * (ff @ ff.T) + self.x @ self.x.T / pull_b
        system = np.linalg.inv(np.eye(n) + k * kernel)
        to_b, to_ends = mean - self.ub, self.ends - self.u_ends
        for _ in range(s.inner):
            right = np.zeros((n, d))
            goal = self.step - self.us
            right[1:] += hold * goal
            right[:-1] -= hold * goal
            right[0] += hold * self.head * to_ends[0]
            right[-1] += hold * self.tail * to_ends[1]
            right[:, :q] += small * self.v[:, :q]
            self.v_before = self.v
            v = np.concatenate([loose @ right[:, :q], held @ right[:, q:]], axis=1)
            miss = system @ (self.y - self.r + self.ur - self.x @ to_b - (self.f * v).sum(axis=1))
            self.b = to_b + k / pull_b * (self.x.T @ miss)
            add = k * miss[:, None] * self.f
            self.v = v + np.concatenate([loose @ add[:, :q], held @ add[:, q:]], axis=1)
            moved = np.diff(self.v, axis=0)
            # multipliers for which these weights are the best answer, before they are corrected
            self.u, self.edge = k * miss, hold * (moved - self.step + self.us)
            self.at_ends = hold * (self.v[[0, -1]] - to_ends) * np.array([[self.head], [self.tail]])
            self.on_b = pull_b * (self.b - to_b)
            rest = self.y - self.x @ self.b - (self.f * self.v).sum(axis=1)
            old_r, old_step = self.r, self.step
            a = RELAX * rest + (1 - RELAX) * old_r + self.ur
            self.r = np.sign(a) * np.maximum(np.abs(a) - 1 / k, 0.0)
            self.ur = a - self.r
            b = RELAX * moved + (1 - RELAX) * old_step + self.us
            self.step = shortened(b, s.longest)
            self.us = b - self.step

    def exchange(self, before: np.ndarray | None, after: np.ndarray | None, mean: np.ndarray) -> None:
        """What the neighbours made of their ends (weights plus multipliers), and the mean of b0, in place of the old ones."""
        own = self.v[[0, -1]] + self.u_ends
        for k, other in ((0, before), (1, after)):
            if other is not None:
                gap = shortened(other - own[k], self.spec.longest)
                self.ends[k] = (own[k] + other - gap) / 2
                self.u_ends[k] = own[k] - self.ends[k]
        self.ub = self.ub + self.b - mean


#: Rows of a stretch.
ROWS = 256
STATE = (
    "series string, stretch int, n int, state binary, with_b array<double>, head array<double>, tail array<double>, on_head array<double>,"
    " on_tail array<double>, head_v array<double>, tail_v array<double>, b array<double>, v_sum array<double>, fastest double"
)


def _row(series: str, number: int, s: Stretch) -> dict:
    """A stretch as a row: all of it, and what others read of it."""
    own = s.v[[0, -1]] + s.u_ends
    on = getattr(s, "at_ends", np.zeros_like(own))
    moves = np.linalg.norm(np.diff(s.v, axis=0), axis=1)
    return {
        "series": series, "stretch": number, "n": len(s.y), "state": pickle.dumps(s.__dict__), "with_b": (s.b + s.ub) * len(s.y), "head": own[0], "tail": own[1],
        "on_head": on[0], "on_tail": on[1], "head_v": s.v[0], "tail_v": s.v[-1], "b": s.b * len(s.y), "v_sum": s.v.sum(axis=0),
        "fastest": float(moves.max(initial=0.0)),
    }


def _stretch(state: bytes) -> Stretch:
    out = Stretch.__new__(Stretch)
    out.__dict__.update(pickle.loads(state))
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _vector_sum(name: str, width: int):
    return F.array(*(F.sum(F.get(name, F.lit(k))) for k in range(width))).alias(name)


def _start(rows: DataFrame, spec: Slow, block: int) -> DataFrame:
    """Stretches of the rows series, t (dense), x, z, y."""
    limits = rows.groupBy("series").agg(F.min("t").alias("_first"), F.max("t").alias("_last"))
    placed = rows.join(limits, "series").withColumn("stretch", F.floor((F.col("t") - F.col("_first")) / block).cast("int"))

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t")
        first, last, low, high = (part[c].iloc[k] for c, k in (("_first", 0), ("_last", 0), ("t", 0), ("t", -1)))
        s = Stretch(_matrix(part["x"]), _matrix(part["z"]), part["y"].to_numpy(float), bool(low > first), bool(high < last), spec)
        s.t = part["t"].to_numpy(np.int64)
        return pd.DataFrame([_row(key[0], key[1], s)])

    return placed.select("series", "stretch", "t", "_first", "_last", "x", "z", "y").groupBy("series", "stretch").applyInPandas(pack, STATE)


def _neighbours(state: DataFrame, columns: dict[str, str]) -> DataFrame:
    """series, stretch, and of the stretch before and of that after a column each: columns has their names by those."""
    out = state.select("series", "stretch")
    for (name, column), shift in zip(columns.items(), (1, -1)):
        out = out.join(state.select("series", (F.col("stretch") + shift).alias("stretch"), F.col(column).alias(name)), ["series", "stretch"], "left")
    return out


def _round(state: DataFrame, spec: Slow, width: int, first: bool) -> DataFrame:
    """Exchanges ends and means (not before the first round), and solves every stretch."""
    sums = state.groupBy("series").agg(_vector_sum("with_b", width), F.sum("n").cast("double").alias("rows"))
    ridge = F.array(F.lit(0.0), *(F.lit(2 * spec.rho / spec.pull),) * (width - 1))
    # the pull on b0 is pull * n in each stretch, the ridge on it 2 * rho * rows in all
    mean = F.transform(F.arrays_zip("with_b", ridge.alias("r")), lambda a: a["with_b"] / (F.col("rows") * (1 + a["r"])))
    inbox = _neighbours(state, {"before": "tail", "after": "head"}).join(sums.select("series", mean.alias("mean")), "series")

    def work(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        row = part.iloc[0]
        s = _stretch(row["state"])
        array = lambda v: None if v is None else np.asarray(v, float)
        mean = np.asarray(row["mean"], float)
        if not first:
            s.exchange(array(row["before"]), array(row["after"]), mean)
        s.solve(mean)
        return pd.DataFrame([_row(key[0], key[1], s)])

    return state.select("series", "stretch", "state").join(inbox, ["series", "stretch"]).groupBy("series", "stretch").applyInPandas(work, STATE)


def _proof(state: DataFrame, spec: Slow, width: int, size: int) -> DataFrame:
    """series, n_rows, b0, centre, share, objective, bound. Two passes over the stretches; only sums of each are shuffled.

    The path whose objective counts is centre + share * (V_t - centre), with the mean of V as the centre: no step is too long.
    """
    ends = state.select("series", "stretch", "tail_v", "head_v")
    across = ends.join(ends.select("series", (F.col("stretch") - 1).alias("stretch"), F.col("head_v").alias("next")), ["series", "stretch"])
    jump = F.sqrt(F.aggregate(F.zip_with("tail_v", "next", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    jumps = across.groupBy("series").agg(F.max(jump).alias("jump"))
    sums = state.groupBy("series").agg(_vector_sum("b", width), _vector_sum("v_sum", size), F.sum("n").alias("n_rows"), F.max("fastest").alias("fastest"))
    over = lambda c: F.transform(c, lambda v: v / F.col("n_rows"))
    fastest = F.greatest("fastest", F.coalesce("jump", F.lit(0.0)))
    share = F.when(fastest > spec.longest, F.lit(spec.longest) / fastest).otherwise(1.0)
    common = sums.join(jumps, "series", "left").select("series", "n_rows", over("b").alias("b0"), over("v_sum").alias("centre"), share.alias("share"))
    inbox = _neighbours(state, {"before": "on_tail", "after": "on_head"}).join(common, "series")
    sums_of = "series string, loss double, top double, gain double, way double, on_x array<double>, on_v double, loose double"

    def work(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        row = part.iloc[0]
        s = _stretch(row["state"])
        b0, centre, q = np.asarray(row["b0"], float), np.asarray(row["centre"], float), s.free
        v = centre + row["share"] * (s.v - centre)
        loss = np.abs(s.y - s.x @ b0 - (s.f * v).sum(axis=1)).sum() + spec.rho_v * (v[:, q:] ** 2).sum()
        # the multipliers of the steps: of those inside, and of the edges to the neighbours, on which both sides agree half-way
        lost, way = s.u[:, None] * s.f, np.linalg.norm(s.edge, axis=1).sum()
        lost[1:] -= s.edge
        lost[:-1] += s.edge
        if row["before"] is not None:
            lost[0] -= (s.at_ends[0] - np.asarray(row["before"], float)) / 2
        if row["after"] is not None:
            edge = (np.asarray(row["after"], float) - s.at_ends[1]) / 2
            lost[-1] += edge
            way += np.linalg.norm(edge)
        loose = (np.abs(lost[:, :q]) * (10 * np.abs(s.v[:, :q]) + 1)).sum()
        return pd.DataFrame([(
            key[0], float(loss), float(np.abs(s.u).max()), float(s.u @ s.y), float(way), (s.x.T @ s.u).tolist(),
            float((lost[:, q:] ** 2).sum() / (4 * spec.rho_v)), float(loose),
        )], columns=["series", "loss", "top", "gain", "way", "on_x", "on_v", "loose"])

    parts = state.select("series", "stretch", "state").join(inbox, ["series", "stretch"]).groupBy("series", "stretch").applyInPandas(work, sums_of)
    each = parts.groupBy("series").agg(
        *(F.sum(c).alias(c) for c in ("loss", "gain", "way", "on_v", "loose")), F.max("top").alias("top"), _vector_sum("on_x", width)
    ).join(common, "series")
    square = lambda c: F.aggregate(F.slice(c, 2, width - 1), F.lit(0.0), lambda s, x: s + x * x)
    linear = F.col("gain") - spec.longest * F.col("way") - F.col("loose") - F.abs(F.get("on_x", F.lit(0))) * (10 * F.abs(F.get("b0", F.lit(0))) + 1)
    curve = F.col("on_v") + square("on_x") / (4 * spec.rho * F.col("n_rows"))
    # multipliers may be made smaller: no larger than one, and as large as the bound is best
    scale = F.greatest(F.lit(0.0), F.least(1 / F.greatest("top", F.lit(1.0)), F.coalesce(F.try_divide(linear, 2 * curve), F.lit(1.0))))
    bound = (scale * linear - scale * scale * curve) / F.col("n_rows")
    objective = F.col("loss") / F.col("n_rows") + spec.rho * square("b0")
    return each.select("series", "n_rows", "b0", "centre", "share", objective.alias("objective"), F.greatest(bound, F.lit(0.0)).alias("bound"))


def _solved(rows: DataFrame, spec: Slow, rounds: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The stretches after all rounds, and what _proof() says of each series."""
    shape = rows.select(F.size("x").alias("p"), F.size("z").alias("q")).first()
    if shape is None:
        raise ValueError("there are no rows")
    width, size = shape["p"], shape["p"] * shape["q"]
    state = written(_start(rows, spec, block), "stretches")
    for k in range(rounds):
        older, state = state, written(_round(state, spec, width, k == 0), "stretches")
        forgotten(older)
    return state, written(_proof(state, spec, width, size), "stretches")


def slow_lad(rows: DataFrame, spec: Slow = Slow(), rounds: int = 20, block: int = ROWS, method: str = "slowly_varying_lad") -> DataFrame:
    """series, method, n_rows, theta (b0 and the last row's V, row-major with 1 + |z| columns, as adaptive_ridge() gives them),
    objective, gap (to a lower bound of the least objective). rows: series, t (dense), x, z, y."""
    state, proof = _solved(rows, spec, rounds, block)
    last = state.groupBy("series").agg(F.max_by("tail_v", "stretch").alias("v")).join(proof, "series")
    p, q = F.size("b0"), (F.size("v") / F.size("b0")).cast("int")
    drawn = F.zip_with("v", "centre", lambda a, c: c + F.col("share") * (a - c))
    theta = F.flatten(F.transform(F.sequence(F.lit(0), p - 1), lambda j: F.concat(F.array(F.get("b0", j)), F.slice("drawn", j * q + 1, q))))
    out = last.withColumn("drawn", drawn)
    return out.select("series", F.lit(method).alias("method"), "n_rows", theta.alias("theta"), "objective", (F.col("objective") - F.col("bound")).alias("gap"))


def slow_paths(rows: DataFrame, spec: Slow = Slow(), rounds: int = 20, block: int = ROWS) -> DataFrame:
    """series, t, b0, v of every row, in the path whose objective slow_lad() gives."""
    state, proof = _solved(rows, spec, rounds, block)

    def unpack(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in source:
            for row in part.itertuples():
                s, centre = _stretch(row.state), np.asarray(row.centre, float)
                v = centre + row.share * (s.v - centre)
                yield pd.DataFrame({"series": row.series, "t": s.t, "b0": [list(row.b0)] * len(v), "v": list(v)})

    held = state.select("series", "state").join(proof, "series").select("series", "state", "b0", "centre", "share")
    return held.mapInPandas(unpack, "series string, t long, b0 array<double>, v array<double>")
