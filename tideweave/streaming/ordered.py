"""Live operators that read each series' rows in the order of their times, however they arrive.

A row waits in the state of its series until the watermark has passed its time; an event-time timer then hands all rows that
are due to the operator, in order. Rows that come after the watermark has passed them aren't dropped: they leave through
the same output, marked `late`, and `outputs` splits a batch of it. Learners get forecasts and labels as rows of one stream, so
that a label may come any time after its forecast. All state is in Spark's state store: a query that is stopped goes on
from its checkpoint. Needs the session's state store to be RocksDB (`rocksdb_state`).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tideweave.operators.online import passive_aggressive_step
from tideweave.operators.segments import starts_storm
from tideweave.sources.rounds import shared_dir


_STORE, _END = "spark.sql.streaming.stateStore.providerClass", "\x00end"


def rocksdb_state(spark: SparkSession) -> None:
    """Sets the state store that these operators need."""
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Ordered(StatefulProcessor):
    """Rows of a series by time, then `rank`. Subclasses: WAITING (schema of what of a row waits: at, rank first), OUT, begin(), each(), end()."""

    WAITING: str
    OUT: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.WAITING)
        self.columns = [c.strip().split(" ")[0] for c in self.WAITING.split(",")]
        self.begin(handle)

    def begin(self, handle: StatefulProcessorHandle) -> None:
        """Opens the operator's own state."""

    def each(self, series: str, rows: list[tuple]) -> list[tuple]:
        """What the rows that are due, in order, give."""
        raise NotImplementedError

    def late(self, series: str, row: tuple) -> tuple:
        """The output row of a late one."""
        raise NotImplementedError

    def closing(self, series: str, watermark: int) -> list[tuple]:
        """What the passing of time alone gives."""
        return []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark, fresh, late = timerValues.getCurrentWatermarkInMs(), [], []
        for part in rows:
            part = part[self.columns].astype(object)
            for row in part.where(part.notna(), None).itertuples(index=False, name=None):
                (late if row[0] <= watermark and watermark > 0 else fresh).append(tuple(_plain(v) for v in row))
        if fresh:
            self.waiting.appendList(fresh)
            self.handle.registerTimer(min(r[0] for r in fresh))
        yield self._frame([self.late(key[0], r) for r in late])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get())
        due = sorted((r for r in held if r[0] <= watermark), key=lambda r: r[:3])
        left = [r for r in held if r[0] > watermark]
        out = self.each(key[0], due) if due else []
        if due and left:
            self.waiting.put(left)
        elif due:
            self.waiting.clear()
        if left:
            self.handle.registerTimer(min(r[0] for r in left))
        yield self._frame(out + self.closing(key[0], watermark))

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in self.OUT.split(",")])

    def close(self) -> None:
        pass


def _plain(value):
    """Arrays as lists, numbers as Python's own."""
    return value.tolist() if isinstance(value, (np.ndarray, np.generic)) else value


def _run(rows: DataFrame, processor: Ordered) -> DataFrame:
    """rows: series, at (milliseconds, not the watermarked column itself: late rows have to arrive), and the processor's columns."""
    return rows.groupBy("series").transformWithStateInPandas(processor, outputStructType=processor.OUT, outputMode="append", timeMode="eventTime")


FORECAST, LABEL = 1, 0  # labels of a moment count before its forecasts


class Learner(Ordered):
    """Forecasts with the weights that the labels up to their time have made; scores when a label comes."""

    WAITING = "at long, rank int, t long, x array<double>, y double"
    OUT = "series string, kind string, t long, pred double, y double, beta array<double>"

    def begin(self, handle):
        self.open = handle.getMapState("open", "t long", "x array<double>, pred double")

    def late(self, series, row):
        return series, "late_forecast" if row[1] == FORECAST else "late_label", row[2], None, row[4], row[3]

    def each(self, series, rows):
        out = []
        self.load()
        for _, rank, t, x, y in rows:
            if rank == FORECAST:
                used, beta = self.weights(np.array(x, float), t)
                pred = float(used @ beta)
                self.open.updateValue((t,), (list(x), pred))
                out.append((series, "forecast", t, pred, None, beta.tolist()))
            elif self.open.containsKey((t,)):
                x, pred = self.open.getValue((t,))
                self.learn(np.array(x, float), float(y), t)
                self.open.removeKey((t,))
                out.append((series, "scored", t, pred, y, None))
            else:  # its forecast was late, or there is none
                out.append((series, "unmatched_label", t, None, y, None))
        self.save()
        return out


class PassiveAggressive(Learner):
    def __init__(self, epsilon: float):
        self.epsilon = epsilon

    def begin(self, handle):
        super().begin(handle)
        self.held = handle.getValueState("weights", "w array<double>")

    def load(self):
        self.w = np.array(self.held.get()[0], float) if self.held.exists() else None

    def save(self):
        if self.w is not None:
            self.held.update((self.w.tolist(),))

    def weights(self, x, t):
        self.w = np.full(len(x), 1.0 / len(x)) if self.w is None else self.w
        return x, self.w

    def learn(self, x, y, t):
        self.w = passive_aggressive_step(self.w, x, y, self.epsilon)


class Exponential(Learner):
    """Weights from the members' losses at t - history .. t, as far as their labels have come."""

    def __init__(self, history: int):
        self.history = history

    def begin(self, handle):
        super().begin(handle)
        self.held = handle.getListState("losses", "t long, losses array<double>")

    def load(self):
        self.ring = {t: np.array(v, float) for t, v in self.held.get()} if self.held.exists() else {}

    def save(self):
        last = max(self.ring, default=0)
        kept = [(t, v.tolist()) for t, v in sorted(self.ring.items()) if t > last - self.history]
        if kept:
            self.held.put(kept)

    def weights(self, x, t):
        members, losses = x[1:], [v for k, v in self.ring.items() if t - self.history <= k < t]
        if not losses:
            return members, np.full(len(members), 1.0 / len(members))
        v = -np.sqrt(8 * np.log(len(members)) / len(losses)) * np.sum(losses, axis=0)
        v = np.exp(v - v.max())
        return members, v / v.sum()

    def learn(self, x, y, t):
        self.ring[t] = (x[1:] - y) ** 2


class Storms(Ordered):
    """Storms of six-hourly records; a storm's rows leave when it has ended: at the record that begins the next one, or after `quiet`."""

    WAITING = "at long, rank int, t long, days int, hours int"
    OUT = "series string, kind string, t long, storm long, k long, length long"

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def begin(self, handle):
        self.rows = handle.getListState("rows", "t long")
        self.last = handle.getValueState("last", "storm long, at long, days int, hours int, ended boolean")

    def late(self, series, row):
        return series, "late", row[2], None, None, None

    def _ended(self, series: str, storm: int, places: list[int]) -> list[tuple]:
        return [(series, "storm", t, storm, k, len(places)) for k, t in enumerate(places, 1)]

    def each(self, series, rows):
        storm, at, day, hour, ended = self.last.get() if self.last.exists() else (0, None, None, None, True)
        places, out = [r[0] for r in self.rows.get()] if self.rows.exists() else [], []
        for now, _, t, days, hours in rows:
            if ended or starts_storm(day, hour, days, hours):
                out += self._ended(series, storm, places)
                storm, places = storm + 1, []
            places.append(t)
            at, day, hour, ended = now, days, hours, False
        self.rows.put([(t,) for t in places])
        self.last.update((storm, at, day, hour, False))
        self.handle.registerTimer(at + self.quiet_ms)
        return out

    def closing(self, series, watermark):
        if not self.last.exists():
            return []
        storm, at, day, hour, ended = self.last.get()
        if ended or at + self.quiet_ms > watermark:
            return []
        out = self._ended(series, storm, [r[0] for r in self.rows.get()])
        self.rows.clear()
        self.last.update((storm, at, day, hour, True))
        return out


def in_order(rows: DataFrame, time: str, allowed: str) -> DataFrame:
    """rows with `at`, the milliseconds of a watermarked time; the operator tells which are late, Spark drops none of them."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, allowed).withColumn("at", F.unix_millis(time)).drop(time)


def live_learner(forecasts: DataFrame, labels: DataFrame, learner: Learner, allowed: str = "0 seconds", time: str = "ts") -> DataFrame:
    """series, kind (forecast, scored, late_forecast, late_label, unmatched_label), t, pred, y, beta.

    forecasts: series, t, x and the time they are asked for; labels: series, t, y and the time they become known. Both are streams.
    """
    asked = forecasts.select("series", F.col(time).alias("_time"), F.lit(FORECAST).alias("rank"), "t", "x", F.lit(None).cast("double").alias("y"))
    known = labels.select("series", F.col(time).alias("_time"), F.lit(LABEL).alias("rank"), "t", F.lit(None).cast("array<double>").alias("x"), "y")
    return _run(in_order(asked.unionByName(known), "_time", allowed), learner)


def live_storms(records: DataFrame, quiet_ms: int, allowed: str = "0 seconds", time: str = "ts") -> DataFrame:
    """series, kind (storm or late), t, storm, k, length. records: series, t, days, hours and their time, a stream."""
    rows = records.select("series", F.col(time).alias("_time"), F.lit(0).alias("rank"), "t", "days", "hours")
    return _run(in_order(rows, "_time", allowed), Storms(quiet_ms))


DAY_MS = 24 * 3_600_000


def drained(rows: DataFrame, live: Callable[[DataFrame], DataFrame], time: str = "ts", key: str = "series") -> DataFrame:
    """What a live operator gives for a whole table, as if it came as a stream that ends: the table and then a row far in the future, which
    moves the watermark past everything, are written to the shared folder and streamed from there."""
    spark = rows.sparkSession
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/in")
    end = rows.agg((F.max(time) + F.expr("INTERVAL 40000 DAYS")).alias(time))
    last = end.select(*(F.lit(_END).alias(c) if c == key else F.col(c) if c == time else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes))
    held = spark.conf.get(_STORE, None)
    rocksdb_state(spark)
    try:
        for part in (None, last):  # two runs of one query: it goes on from its checkpoint
            if part is not None:
                part.write.mode("append").parquet(f"{folder}/in")
            source = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
            out = live(source).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
            out.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(_STORE) if held is None else spark.conf.set(_STORE, held)
    return spark.read.parquet(f"{folder}/out").filter(F.col(key) != _END)


def outputs(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The results of a batch (as foreachBatch gives it), and its late rows."""
    late = F.col("kind").startswith("late")
    return batch.filter(~late), batch.filter(late)
