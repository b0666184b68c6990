"""Projection, splitting, scaling and encoding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideweave.functions.vectors import scaled
from tideweave.operators.windows import blocked


@dataclass(frozen=True)
class Split:
    """fraction: rows before the split; past * num_past: rows of training; val: test rows, None for all that remain."""

    fraction: float = 0.5
    past: int = 3
    num_past: int = 50
    val: int | None = 100

    @property
    def history(self) -> int:
        return self.past * self.num_past


def project_range(df: DataFrame, begin: int, end: int = -1) -> DataFrame:
    """Columns begin .. end by 1-based position; -1 or anything beyond the width is the last one."""
    last = len(df.columns) if end == -1 else min(end, len(df.columns))
    return df.select(*df.columns[begin - 1 : last])


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def add_constant(df: DataFrame, name: str = "intercept", value: float = 1.0) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def rows_between(df: DataFrame, first: int, last: int, t: str = "t") -> DataFrame:
    return df.filter(F.col(t).between(first, last))


def masked(df: DataFrame, name: str, keep: Column, other: Column | None = None) -> DataFrame:
    """The column where `keep` holds, `other` (null by default) elsewhere."""
    return df.withColumn(name, F.when(keep, F.col(name)).otherwise(other))


def columns_with_mean_above(df: DataFrame, names: list[str], bound: float) -> list[str]:
    """Names of the columns whose mean is over the bound: one aggregate over the data."""
    means = df.agg(*(F.avg(c).alias(c) for c in names)).first()
    return [c for c in names if means[c] is not None and means[c] > bound]


def null_profile(df: DataFrame, names: list[str]) -> DataFrame:
    """One row for each column: how many nulls it has."""
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in names))
    return counts.unpivot([], names, "column", "n_null")


def dense_columns(df: DataFrame, names: list[str], share: float = 0.95) -> list[str]:
    """Names of the columns with at least int(share * n + 1) values."""
    row = df.agg(F.count("*").alias("_n"), *(F.count(c).alias(c) for c in names)).first()
    return [c for c in names if row[c] >= int(share * row["_n"] + 1)]


def bounds(panel: DataFrame, split: Split) -> DataFrame:
    """For each series: n, split, first and last row of training, last row of the test (which begins after training)."""
    at = F.floor(F.col("n") * split.fraction)
    sizes = panel.groupBy("series").agg(F.max("t").alias("n")).withColumn("split", at.cast("long"))
    most = F.col("n") - F.col("split") - 1
    val = most if split.val is None else F.least(F.lit(split.val), most)
    return sizes.withColumns({
        "first": F.greatest(F.col("split") - split.history + 1, F.lit(1)),
        "last": F.greatest(F.col("split") - split.history + 1, F.lit(1)) + F.least(F.lit(split.history), F.col("split")),
        "end": F.col("split") + 1 + F.greatest(val, F.lit(0)),
    })


def standardised(panel: DataFrame, split: Split, population: bool = False, keep_intercept: bool = True) -> DataFrame:
    """x and y less the mean of y, over its deviation, both from the rows up to the split; the intercept stays 1.

    Adds mu, sigma and the columns of bounds(). One aggregate of one row for each series, joined back.
    """
    limits = bounds(panel, split)
    spread = F.stddev_pop if population else F.stddev_samp
    head = panel.join(limits.select("series", "split"), "series").filter("t <= split")
    stats = limits.join(head.groupBy("series").agg(F.avg("y").alias("mu"), spread("y").alias("sigma")), "series")
    z = scaled("x", F.try_divide(F.lit(1.0), "sigma"), F.col("mu"))
    x = F.concat(F.array(F.lit(1.0)), F.slice(z, 2, F.size("x") - 1)) if keep_intercept else z
    return panel.join(stats, "series").withColumns({"x": x, "y": F.try_divide(F.col("y") - F.col("mu"), "sigma"), "y_true": F.col("y")})


def training(rows: DataFrame) -> DataFrame:
    """The training rows of a frame with the columns of bounds()."""
    return rows.filter("t BETWEEN first AND last")


def testing(rows: DataFrame) -> DataFrame:
    """The test rows of a frame with the columns of bounds()."""
    return rows.filter("t > split + 1 AND t <= end")


def supervised(df: DataFrame, names: list[str], target: str, past: int, future: int) -> DataFrame:
    """series, t, columns name_0 .. name_{past-1} (lagged), target: the value past + future - 1 rows after the oldest lag."""

    def work(frame, w):
        lags = [F.lag(c, k).over(w).alias(f"{c}_{k}") for k in range(past) for c in names]
        return frame.select("series", "t", "_block", *lags, F.col(target).alias("_now"))

    shift = future
    lagged = blocked(df, past, work)
    ahead = df.select("series", (F.col("t") - shift).alias("t"), F.col(target).alias("target"))
    return lagged.drop("_now").filter(F.col("t") >= past).join(ahead, ["series", "t"])


def differences(df: DataFrame, value: str = "y") -> DataFrame:
    """Adds diff and ret, the change from the row before and its share of that row."""
    out = blocked(df, 1, lambda f, w: f.withColumn("_p", F.lag(value).over(w)))
    return out.withColumns({"diff": F.col(value) - F.col("_p"), "ret": F.try_divide(F.col(value) - F.col("_p"), "_p")}).drop("_p")


def interpolated(df: DataFrame, value: str = "y", name: str = "filled") -> DataFrame:
    """Linear between the nearest values; after the last value it stays, before the first one it is null.

    Gaps take their ends from runs of nulls (numbered by a running count), not from frames of unbounded width.
    """
    from tideweave.operators.windows import running_sum

    has = F.col(value).isNotNull()
    marked = running_sum(df, F.when(has, 1.0).otherwise(0.0), "_run").withColumn("_run", F.coalesce("_run", F.lit(0.0)) + F.when(has, 1.0).otherwise(0.0))
    ends = marked.filter(has).select("series", F.col("_run"), F.col("t").alias("_t0"), F.col(value).alias("_v0"))
    after = ends.select("series", (F.col("_run") - 1).alias("_run"), F.col("_t0").alias("_t1"), F.col("_v0").alias("_v1"))
    out = marked.join(ends, ["series", "_run"], "left").join(after, ["series", "_run"], "left")
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("t") - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))
    filled = F.when(F.col("_t0").isNull(), F.lit(None)).when(has, F.col(value)).otherwise(F.coalesce(line, F.col("_v0")))
    return out.withColumn(name, filled).drop("_run", "_t0", "_v0", "_t1", "_v1")


def cyclic_time(df: DataFrame, ts: str, hours: int = 24) -> DataFrame:
    """Adds sine and cosine of the day of the year over 365 and of the hour over `hours`."""
    day, hour = 2 * F.pi() * F.dayofyear(ts) / 365, 2 * F.pi() * F.hour(ts) / hours
    return df.withColumns({"sin_day": F.sin(day), "cos_day": F.cos(day), "sin_hour": F.sin(hour), "cos_hour": F.cos(hour)})


def one_hot(df: DataFrame, name: str, values: list[str]) -> DataFrame:
    """Adds a 0/1 column for each value."""
    return df.withColumns({f"{name}_{v}": F.coalesce((F.col(name) == v).cast("double"), F.lit(0.0)) for v in values})


def random_split(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """Adds `part`: train or test by a hash of the key, the same in every run whatever the partitions."""
    bucket = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long") % 10_000
    return df.withColumn("part", F.when(bucket < int(share * 10_000), "train").otherwise("test"))


def scale(df: DataFrame, names: list[str], fit: Column) -> DataFrame:
    """Columns less mean over population deviation, both fitted on the rows where `fit` holds."""
    stats = df.filter(fit).agg(*(s(c).alias(f"_{n}_{c}") for c in names for n, s in (("m", F.avg), ("s", F.stddev_pop))))
    out = df.crossJoin(F.broadcast(stats))  # one row
    return out.withColumns({c: F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in names}).drop(*stats.columns)


def uncertainty_box(rows: DataFrame, share: float) -> DataFrame:
    """Adds the interval y - share * |y| .. y + share * |y|."""
    return rows.withColumns({"d_min": F.col("y") - share * F.abs("y"), "d_max": F.col("y") + share * F.abs("y")})
