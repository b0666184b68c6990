"""The robust learners of `robust` for training rows of any number: smoothed Newton steps as rounds over blocks of rows.

Values, slopes and curvatures of the smoothed problem, its true objective, and the lower bound that proves a fit are all
sums over rows. A round is one job over all series and methods: each task adds up its blocks and shuffles one small row for
each series and method that it meets, whatever the number of rows; the step is taken on executors. A round tries several step
lengths, and the next smoothing, at once. Series and methods that are proved, or that can't be fitted, leave.

The first point comes from the same steps over a bounded sample of a series' rows; the smoothing of the first round is as
large as the error of such a sample, none if it holds all rows. The rounds over all rows decide, prove and give every figure.

The tail's threshold is one more unknown, so no quantile is needed. Rows are packed into blocks where they lie: nothing
is grouped by series, and a series that holds a third of all rows is spread over all tasks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideweave.operators.learners import PARAMS, solve
from tideweave.operators.robust import Robust, penalties
from tideweave.sources.rounds import forgotten, written

#: Numbers in a block's features, about; sums that a task holds before it hands them on.
BLOCK, HELD = 2048, 1000
#: Step lengths that a round tries, and the factor by which the smoothing falls.
LENGTHS, FALL = (1.0, 0.3, 0.1), 0.2
#: Smoothing (of the mean target) above which a problem is solved roughly; below, its slopes must balance, which the bound needs.
LOOSE = 1e-5


def blocks(rows: DataFrame, features: str) -> DataFrame:
    """series, width, x, y: rows of a series in packed blocks, in the tasks where they lie."""

    def pack(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            series, x, y = batch.columns
            sizes, numbers = x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), x.flatten().to_numpy(zero_copy_only=False).astype(float)
            starts, targets = np.cumsum(sizes) - sizes, y.to_numpy(zero_copy_only=False).astype(float)
            names, place = np.unique(np.array(series.to_pylist(), dtype=object).astype(str), return_inverse=True)
            out = []
            for k, name in enumerate(names.tolist()):
                own = np.flatnonzero(place == k)
                for width in np.unique(sizes[own]).tolist():
                    alike = own[sizes[own] == width]
                    step = max(16, BLOCK // max(1, width))
                    for low in range(0, len(alike), step):
                        at = alike[low : low + step]
                        out.append((name, width, numbers[starts[at][:, None] + np.arange(width)].tobytes(), targets[at].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.binary(), pa.binary()))], names=["series", "width", "x", "y"])

    return rows.select("series", F.col(features).alias("f"), "y").filter("series IS NOT NULL").mapInArrow(pack, "series string, width int, x binary, y binary")


def _sums(x: np.ndarray, y: np.ndarray, theta: np.ndarray, eps: float, spec: Robust, n: int) -> np.ndarray:
    """What a block adds: smoothed value, objective, count, gain, curve, bend; pulls; mixed; curvature (row by row)."""
    p = x.shape[1]
    r = y - x @ theta[:p]
    if spec.loss == "abs":
        raw, loss = np.abs(r), np.hypot(r, eps)
        first, second = r / loss, eps * eps / loss**3
    else:
        raw = loss = r * r
        first, second = 2 * r, np.full(len(r), 2.0)
    if spec.alpha < 1:
        z, share = loss - theta[p], 1 / (spec.alpha * n)
        root = np.hypot(z, eps)
        value, true = share / 2 * (z + root).sum(), share * np.maximum(raw - theta[p], 0.0).sum()
        count, bend = share / 2 * (1 + z / root), share / 2 * eps * eps / root**3
    else:
        value, true, count, bend = loss.sum() / n, raw.sum() / n, np.full(len(r), 1.0 / n), np.zeros(len(r))
    pull = count * first
    curve = (count * first * first / 4).sum() if spec.loss == "square" else 0.0
    bowl = (x.T * (count * second + bend * first * first)) @ x
    return np.concatenate([[value, true, count.sum(), pull @ y, curve, bend.sum()], x.T @ pull, x.T @ (bend * first), bowl.ravel()])


class Fit:
    """What is known of one series and method, between rounds."""

    def __init__(self, spec: Robust, adaptive: int, n: int, gram: np.ndarray, size: float):
        """gram: sums of (x, y)(x, y)'; size: mean absolute target."""
        self.spec, self.n, self.error, self.open, self.rounds = spec, n, None, True, 0
        self.best, self.least, self.bound = None, np.inf, -np.inf
        if not (np.isfinite(gram).all() and np.isfinite(size)):
            self.open, self.error = False, "features or targets are not finite"
            return
        p = len(gram) - 1
        self.factor = penalties(spec, p, adaptive)
        beta = solve(gram[:p, :p] / n + np.diag(self.factor + 1e-9), gram[:p, p] / n)
        square = max(0.0, float(gram[p, p] - 2 * beta @ gram[:p, p] + beta @ gram[:p, :p] @ beta)) / n
        # the tail of normal errors, to begin with
        self.theta = np.append(beta, 1.5 * np.sqrt(square) if spec.loss == "abs" else 2 * square) if spec.alpha < 1 else beta
        self.scale = size or 1.0
        self.eps, self.value, self.back, self.way, self.drop = 0.5 * self.scale, None, 1.0, None, 0.0
        self.least_at = self.bound_at = self.other = None

    def begun(self, x: np.ndarray, y: np.ndarray, close: float, most: int) -> None:
        """Goes on to where a sample of the n rows leads, as far as its error allows; then all rows are to be met."""
        rough, n = 0.5 * self.scale * np.sqrt(max(0.0, len(self.factor) * (1 / len(y) - 1 / self.n))), self.n
        self.n = len(y)
        while self.open and self.eps > rough:
            self.step([_sums(x, y, t, e, self.spec, self.n) for t, e in self.trials()], close, most)
        # where the bound was highest, or where the sample's error ends; the weights of the least objective are looked at too
        self.other, (self.theta, self.eps) = self.least_at, self.bound_at if self.eps <= max(rough, LOOSE * self.scale) else (self.theta, self.eps)
        self.n, self.eps, self.open, self.value, self.back, self.rounds = n, max(self.eps, rough), True, None, 1.0, 0
        self.best, self.least, self.bound = None, np.inf, -np.inf

    def trials(self) -> list[tuple[np.ndarray, float]]:
        """The points and smoothings at which the next round adds up."""
        if self.value is None:
            return [(self.theta, self.eps), *([] if self.other is None else [(self.other, self.eps)])]
        ahead = [self.theta + self.back * f * self.way for f in LENGTHS]
        return [*((t, self.eps) for t in ahead), (ahead[0], self.eps * FALL)]

    def _problem(self, theta: np.ndarray, eps: float, sums: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Smoothed value, slope and curvature; remembers the objective and the bound found on the way."""
        p, tail, f = len(self.factor), self.spec.alpha < 1, self.factor
        value, true, count, gain, curve, bend = sums[:6]
        held, mixed, bowl = sums[6 : 6 + p], sums[6 + p : 6 + 2 * p], sums[6 + 2 * p :].reshape(p, p)
        beta, t = theta[:p], theta[p] if tail else 0.0
        if self.spec.penalty == "ridge":
            cost = smooth = f @ (beta * beta)
            slope, bowls = 2 * f * beta, 2 * f
        else:
            size = np.hypot(beta, eps)
            cost, smooth, slope, bowls = f @ np.abs(beta), f @ size, f * beta / size, f * eps * eps / size**3
        if true + cost + t < self.least:
            self.best, self.least, self.least_at = beta, float(true + cost + t), theta
        bound = self._lower(held / max(1.0, count), gain / max(1.0, count), curve / max(1.0, count), beta)
        if bound > self.bound:
            self.bound, self.bound_at = bound, (theta, eps)
        slope, bowl = slope - held, bowl + np.diag(bowls)
        if tail:
            slope = np.append(slope, 1 - count)
            bowl = np.block([[bowl, mixed[:, None]], [mixed[None], np.array([[bend]])]])
        return float(value + smooth + t), slope, bowl

    def _lower(self, held: np.ndarray, gain: float, curve: float, beta: np.ndarray) -> float:
        """A value that no weights undercut, free ones within ten times those at hand."""
        tied = self.factor > 0
        if self.spec.penalty == "lasso":
            over = max(1.0, float((np.abs(held[tied]) / self.factor[tied]).max(initial=0.0)))
            held, gain, cost = held / over, gain / over, curve / over**2
        else:
            cost = curve + float((held[tied] ** 2 / (4 * self.factor[tied])).sum())
        return float(gain - cost - np.abs(held[~tied]) @ (10 * np.abs(beta[~tied]) + 1))

    def _stand(self, theta: np.ndarray, eps: float, problem: tuple[float, np.ndarray, np.ndarray]) -> None:
        self.theta, self.eps, self.back = theta, eps, 1.0
        self.value, slope, bowl = problem
        small = 1e-12 * max(1.0, float(np.trace(bowl)) / len(theta))
        self.way = -solve(bowl + small * np.eye(len(theta)), slope)
        self.drop, self.tilt = float(slope @ self.way), float(np.abs(slope).max())

    def step(self, sums: list[np.ndarray], close: float, most: int) -> None:
        """Takes the best of the tried steps; smooths less where the smoothed problem is solved well enough."""
        self.rounds += 1
        tried = self.trials()
        found = [self._problem(t, e, s) for (t, e), s in zip(tried, sums)]
        if self.value is None:
            self._stand(*tried[0], found[0])
            self.other = None
        else:
            k = min(range(len(LENGTHS)), key=lambda j: found[j][0])
            if -self.drop < 1e-11 * max(1.0, abs(self.value)):  # values can't tell steps from rounding here: slopes can
                balanced = float(np.abs(found[0][1]).max()) >= 0.5 * self.tilt
                self._stand(*tried[-1 if balanced else 0], found[-1 if balanced else 0])
            elif found[k][0] <= self.value:
                self._stand(*tried[k], found[k])
                if k == 0 and self.eps > LOOSE * self.scale and -self.drop < 0.01 * self.eps:
                    self._stand(*tried[-1], found[-1])
            elif self.back < 1e-6:
                self._stand(*tried[-1], found[-1])
            else:
                self.back *= LENGTHS[-1] / 3
        self.open = self.least - self.bound > close * max(1.0, abs(self.least)) and self.eps > 1e-9 * self.scale and self.rounds < most


STATE = "series string, method string, open boolean, state binary"


def _begin(packed: DataFrame, methods: dict[str, Robust], adaptive: int, sample: int, close: float, most: int) -> DataFrame:
    """A Fit of each series and method, from sums of products and a sample of rows."""

    def products(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for part in source:
            for s, width, x, y in zip(part["series"], part["width"], part["x"], part["y"]):
                targets = np.frombuffer(y)
                full = np.column_stack([np.frombuffer(x).reshape(len(targets), width), targets])
                sums, xs, ys = held.get((s, width), (0.0, b"", b""))
                sums = sums + np.concatenate([[len(y) / 8, np.abs(targets).sum()], (full.T @ full).ravel()])
                held[s, width] = (sums, xs + x, ys + y) if len(ys) < 8 * sample else (sums, xs, ys)
            if len(held) > HELD:
                yield _rows(held)
                held = {}
        if held:
            yield _rows(held)

    def _rows(held: dict) -> pd.DataFrame:
        return pd.DataFrame([(s, w, v.tobytes(), x, y) for (s, w), (v, x, y) in held.items()], columns=["series", "width", "sums", "x", "y"])

    def start(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, xs, ys = {}, b"", b""
        for part in parts:
            for width, raw, x, y in zip(part["width"], part["sums"], part["x"], part["y"]):
                total[width] = total.get(width, 0.0) + np.frombuffer(raw)
                if len(ys) < 8 * sample:
                    xs, ys = xs + x, ys + y
        width, sums = total.popitem()
        n, size, gram = int(sums[0]), float(sums[1] / sums[0]), sums[2:].reshape(width + 1, width + 1)
        gram = gram * (np.nan if total else 1.0)  # rows of different widths can't be fitted
        out = []
        for m, spec in methods.items():
            try:
                fit = Fit(spec, adaptive, n, gram, size)
                if fit.open and ys:
                    fit.begun(np.frombuffer(xs).reshape(-1, width), np.frombuffer(ys), close, most)
            except (ValueError, np.linalg.LinAlgError) as e:
                fit = Fit(spec, adaptive, n, gram * np.nan, size)
                fit.error = str(e)
            out.append((key[0], m, fit.open, pickle.dumps(fit)))
        yield pd.DataFrame(out, columns=["series", "method", "open", "state"])

    rows = packed.mapInPandas(products, "series string, width int, sums binary, x binary, y binary")
    return rows.groupBy("series").applyInPandas(start, STATE)


def _round(packed: DataFrame, state: DataFrame, close: float, most: int) -> DataFrame:
    """The state one round later."""
    open_ = state.filter("open")
    fits = open_.groupBy("series").agg(F.collect_list("state").alias("fits"), F.collect_list("method").alias("methods"))

    def add(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        known: dict = {}
        for part in source:
            for s, x, y, raw, names in zip(part["series"], part["x"], part["y"], part["fits"], part["methods"]):
                if s not in known:
                    known[s] = list(zip(names, (pickle.loads(f) for f in raw)))
                y = np.frombuffer(y)
                x = np.frombuffer(x).reshape(len(y), -1)
                for m, fit in known[s]:
                    held[s, m] = held.get((s, m), 0.0) + np.array([_sums(x, y, t, e, fit.spec, fit.n) for t, e in fit.trials()])
            if len(held) > HELD:
                yield _rows(held)
                held, known = {}, {}
        if held:
            yield _rows(held)

    def _rows(held: dict) -> pd.DataFrame:
        return pd.DataFrame([(s, m, v.tobytes()) for (s, m), v in held.items()], columns=["series", "method", "sums"])

    def step(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fit, total = None, 0.0
        for part in parts:
            for raw, state in zip(part["sums"], part["state"]):
                if state is not None:
                    fit = pickle.loads(state)
                else:
                    total = total + np.frombuffer(raw)
        try:
            fit.step(list(total.reshape(len(fit.trials()), -1)), close, most)
        except (ValueError, np.linalg.LinAlgError) as e:
            fit.open, fit.error = False, str(e)
        yield pd.DataFrame([(key[0], key[1], fit.open, pickle.dumps(fit))], columns=["series", "method", "open", "state"])

    sums = packed.select("series", "x", "y").join(fits, "series").mapInPandas(add, "series string, method string, sums binary")
    both = sums.withColumn("state", F.lit(None).cast("binary")).unionByName(open_.select("series", "method", F.lit(None).cast("binary").alias("sums"), "state"))
    return both.groupBy("series", "method").applyInPandas(step, STATE).unionByName(state.filter("NOT open"))


def fit_rounds(rows: DataFrame, methods: dict[str, Robust], features: str = "x", adaptive: int = 0, close: float = 1e-7, most: int = 150, sample: int = 1000) -> DataFrame:
    """series, method, n_rows, theta, objective, gap, error, rounds of each series of rows (series, `features`, y).

    A fit is done when its gap is at most `close` (of an objective above one: that part of it), or after `most` rounds: the gap
    tells. sample: rows of a series, about, from which the first point comes. Features or targets that are null or not finite give an error and no weights; rows without a series are left out.
    """
    packed = written(blocks(rows, features), "blocks")
    state = written(_begin(packed, methods, adaptive, sample, close, most), "fits")
    while not state.filter("open").isEmpty():
        older, state = state, written(_round(packed, state, close, most), "fits")
        forgotten(older)
    forgotten(packed)

    def tell(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in source:
            out = []
            for s, m, raw in zip(part["series"], part["method"], part["state"]):
                fit = pickle.loads(raw)
                ok = fit.error is None and fit.best is not None
                out.append((s, m, fit.n, fit.best.tolist() if ok else None, fit.least if ok else None, max(0.0, fit.least - fit.bound) if ok else None, fit.error, fit.rounds))
            yield pd.DataFrame(out, columns=["series", "method", "n_rows", "theta", "objective", "gap", "error", "rounds"])

    return state.mapInPandas(tell, PARAMS + ", objective double, gap double, error string, rounds int")
