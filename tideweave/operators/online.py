"""Sequential learners, and the weights that all learners give to the rows they are scored on."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideweave.functions.vectors import dot, matvec, mean
from tideweave.operators.windows import blocked, running_sums, sliding_sums

WEIGHTS = "series string, t long, beta array<double>"


def exponential_weights(panel: DataFrame, members: int, history: int | None, delay: int = 1) -> DataFrame:
    """Adds beta over the members (without the intercept): softmax of -eta times their squared losses over the rows
    t - history .. t - delay, eta = sqrt(8 ln p / n) with n such rows; equal weights where there are none. A history of
    None is all rows up to t - delay, by running sums instead of frames."""
    loss = [F.get("x", F.lit(k)) - F.col("y") for k in range(1, members + 1)]

    def late(frame, w):
        return frame.withColumns({c: F.lag(c, delay - 1).over(w) for c in ("_n", *(f"_s{k}" for k in range(members)))})

    def work(frame, w):
        return sliding_sums(frame, w, {"_n": F.lit(1.0)} | {f"_s{k}": d * d for k, d in enumerate(loss)}, delay, history)

    if history is None:
        out = blocked(running_sums(panel, {"_n": F.lit(1.0)} | {f"_s{k}": d * d for k, d in enumerate(loss)}), delay - 1, late)
    else:
        out = blocked(panel, history, work)
    sums = [F.col(f"_s{k}") for k in range(members)]
    out = out.withColumns({"_eta": F.sqrt(F.try_divide(F.lit(8 * math.log(members)), F.col("_n"))), "_low": F.least(*sums) if members > 1 else sums[0]})
    out = out.withColumns({f"_e{k}": F.exp(-F.col("_eta") * (c - F.col("_low"))) for k, c in enumerate(sums)})
    out = out.withColumn("_whole", reduce(lambda a, b: a + b, (F.col(f"_e{k}") for k in range(members))))
    beta = F.when(F.col("_n") > 0, F.array(*(F.col(f"_e{k}") / F.col("_whole") for k in range(members))))
    out = out.withColumn("beta", F.coalesce(beta, F.array_repeat(F.lit(1.0 / members), members)))
    return out.drop("_n", "_eta", "_low", "_whole", *(f"_{c}{k}" for k in range(members) for c in "se"))


def passive_aggressive_step(w: np.ndarray, x: np.ndarray, y: float, epsilon: float) -> np.ndarray:
    """The least change of w that brings x'w within epsilon of y."""
    miss = y - w @ x
    loss = max(abs(miss) - epsilon, 0.0)
    square = x @ x
    return w + np.sign(miss) * loss / square * x if loss > 0 and square > 0 else w


def _passive_aggressive_lists(w: list[float], x: list[float], y: float, epsilon: float) -> list[float]:
    """passive_aggressive_step() for a few members: lists take a small part of the time of arrays."""
    miss = y - math.sumprod(w, x)
    loss = abs(miss) - epsilon
    if loss > 0 and (square := math.sumprod(x, x)) > 0:
        step = math.copysign(loss, miss) / square
        return [u + step * v for u, v in zip(w, x)]
    return w


def passive_aggressive(panel: DataFrame, epsilon: float, first: DataFrame, delay: int = 1) -> DataFrame:
    """series, t, beta of the rows first < t <= end: equal weights at first, updated with the row t - delay before t.

    first: series, first, end. The recurrence is sequential, so a series is one task; its rows come sorted, a batch at a time,
    and only the last `delay` of them are held, whatever the length of the series.
    """

    def fold(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, w, held = None, [], {}
        for batch in source:
            series, t, x, y, start = batch.columns
            ends = np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False)).tolist()
            numbers, targets = x.flatten().to_numpy(zero_copy_only=False).tolist(), y.to_numpy(zero_copy_only=False).tolist()
            rows, flat, offsets, low = [], [], [0], 0
            for k, (s, now, begin, end) in enumerate(zip(series.to_pylist(), t.to_pylist(), start.to_pylist(), ends)):
                own, low = numbers[low:end], end
                if s != name:
                    name, w, held = s, [1.0 / len(own)] * len(own), {}
                held[now] = own, targets[k]
                while (oldest := next(iter(held))) < now - delay:
                    del held[oldest]
                if now <= begin:
                    continue
                if now - delay in held and now - delay >= begin + (delay > 1):
                    w = _passive_aggressive_lists(w, *held[now - delay], epsilon)
                rows.append(k)
                flat += w
                offsets.append(len(flat))
            if rows:
                beta = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.float64()))
                yield pa.RecordBatch.from_arrays([series.take(pa.array(rows)), t.take(pa.array(rows)), beta], names=["series", "t", "beta"])

    rows = panel.select("series", "t", "x", "y").join(first, "series").filter("t >= first AND t <= end")
    ordered = rows.select("series", F.col("t").cast("long").alias("t"), "x", "y", "first").repartition("series").sortWithinPartitions("series", "t")
    return ordered.mapInArrow(fold, WEIGHTS)


def errors_of(rows: DataFrame, method: str, value) -> DataFrame:
    """series, t, method, y, pred, err of a standardised forecast `value`; rows have y_true, mu, sigma."""
    pred = value * F.col("sigma") + F.col("mu")
    return rows.select("series", "t", F.lit(method).alias("method"), F.col("y_true").alias("y"), pred.alias("pred"), (F.col("y_true") - pred).alias("err"))


def ensemble_mean(rows: DataFrame, method: str = "mean") -> DataFrame:
    return errors_of(rows, method, mean(F.slice("x", 2, F.size("x") - 1)))


def weighted(rows: DataFrame, method: str, members_only: bool = False) -> DataFrame:
    """Errors of x'beta, or of the members' part of x."""
    x = F.slice("x", 2, F.size("x") - 1) if members_only else F.col("x")
    return errors_of(rows, method, dot(x, "beta"))


def adaptive_weights(rows: DataFrame, params: DataFrame, width: int) -> DataFrame:
    """Adds method and beta = b0 + V z to rows with z; width is 1 + |z|. Joins one row of parameters for each series and method."""
    w = F.concat(F.array(F.lit(1.0)), F.col("z"))
    return rows.join(params.select("series", "method", "theta"), "series").withColumn("beta", matvec("theta", width, w)).drop("theta")


def adaptive_errors(rows: DataFrame, params: DataFrame) -> DataFrame:
    """series, t, method, y, pred, err of x'(b0 + V z) for rows with x, z, y_true, mu, sigma, and every method of the series' parameters.

    Products of arrays, a batch at a time. A series' parameters are one binary value, of which only the first in a run of rows is read.
    """

    def pack(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            each = [sorted((p["method"], p["theta"]) for p in v) for v in b.column(1).to_pylist()]
            packed = [np.array([t for _, t in v], np.float64).tobytes() for v in each]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[m for m, _ in v] for v in each], pa.list_(pa.string())), pa.array(packed, pa.binary())], names=["series", "methods", "theta"])

    def score(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            names = b.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            bounds = [0, *(np.flatnonzero(np.diff(names)) + 1).tolist(), b.num_rows]
            for low, high in zip(bounds, bounds[1:]):
                if low == high:
                    continue
                part = b.slice(low, high - low)
                n, methods = high - low, part.column(7)[0].as_py()
                flat = [part.column(k).flatten() for k in (2, 3)]
                x, z = (c.to_numpy(zero_copy_only=False).reshape(n, -1) for c in flat)
                y, mu, sigma = (part.column(k).to_numpy(zero_copy_only=False) for k in (4, 5, 6))
                unknown = np.zeros(n, bool)  # null, not only not a number
                for c in (*flat, *(part.column(k) for k in (4, 5, 6))):
                    if c.null_count:
                        unknown |= c.is_null().to_numpy(zero_copy_only=False).reshape(n, -1).any(axis=1)
                w = np.column_stack([np.ones(n), z])
                theta = np.frombuffer(part.column(8)[0].as_py(), np.float64).reshape(len(methods), x.shape[1], w.shape[1])
                for method, v in zip(methods, theta):
                    pred = np.einsum("ni,ni->n", w @ v.T, x) * sigma + mu
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), pa.array([method] * n, pa.string()), part.column(4), pa.array(pred, mask=unknown), pa.array(y - pred, mask=unknown)],
                        names=["series", "t", "method", "y", "pred", "err"],
                    )

    own = params.groupBy("series").agg(F.collect_list(F.struct("method", "theta")).alias("p"))
    packed = own.mapInArrow(pack, "series string, methods array<string>, theta binary")
    used = rows.select("series", F.col("t").cast("long").alias("t"), "x", "z", F.col("y_true").cast("double").alias("y_true"), "mu", "sigma")
    joined = used.join(packed, "series").select("series", "t", "x", "z", "y_true", "mu", "sigma", "methods", "theta")
    return joined.mapInArrow(score, "series string, t long, method string, y double, pred double, err double")


def persistence(panel: DataFrame) -> DataFrame:
    """Adds last, the value of y one row before."""
    return blocked(panel, 1, lambda f, w: f.withColumn("last", F.lag("y").over(w)))
