"""Live twins of the sequential learners: keyed state over a stream of rows (series, t, x, y)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideweave.operators.online import passive_aggressive_step

OUT = "series string, t long, pred double, y double, beta array<double>"
STATE = "t long, beta array<double>"


def stream_passive_aggressive(rows: DataFrame, epsilon: float) -> DataFrame:
    """For each arriving row the forecast x'w made before its target is used, then the update. State: the weights of a
    series, however long it runs. Rows of a series that arrive late (t not above the last one) are left out."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, w = (state.get[0], np.array(state.get[1])) if state.exists else (-1, None)
        out = []
        for row in pd.concat(list(parts)).sort_values("t").itertuples():
            if row.t <= last:
                continue
            x = np.array(row.x, float)
            w = np.full(len(x), 1.0 / len(x)) if w is None else w
            out.append((key[0], row.t, float(w @ x), float(row.y), w.tolist()))
            w, last = passive_aggressive_step(w, x, float(row.y), epsilon), row.t
        if w is not None:
            state.update((int(last), w.tolist()))
        yield pd.DataFrame(out, columns=["series", "t", "pred", "y", "beta"])

    return rows.groupBy("series").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


RING = "t long, losses array<array<double>>"


def stream_exponential_weights(rows: DataFrame, history: int) -> DataFrame:
    """For each arriving row the weights of the members from the last `history` losses. State: those losses."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, losses = (state.get[0], [np.array(v) for v in state.get[1]]) if state.exists else (-1, [])
        out = []
        for row in pd.concat(list(parts)).sort_values("t").itertuples():
            if row.t <= last:
                continue
            x = np.array(row.x, float)[1:]
            p = len(x)
            if losses:
                v = -np.sqrt(8 * np.log(p) / len(losses)) * np.sum(losses, axis=0)
                w = np.exp(v - v.max())
                w /= w.sum()
            else:
                w = np.full(p, 1.0 / p)
            out.append((key[0], row.t, float(w @ x), float(row.y), w.tolist()))
            losses = [*losses, (x - row.y) ** 2][-history:]
            last = row.t
        state.update((int(last), [v.tolist() for v in losses]))
        yield pd.DataFrame(out, columns=["series", "t", "pred", "y", "beta"])

    return rows.groupBy("series").applyInPandasWithState(step, OUT, RING, "append", GroupStateTimeout.NoTimeout)
