"""Experiment tables: grids of settings, selection on validation, wins, gaps, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The grid's settings, in the order of its loops.
RHOS = (0.0, 0.001, 0.01, 0.1, 1.0)
PASTS = (2, 3, 4, 5)

#: Columns of the results table.
RESULTS = (
    "Dataset string, Train_Length long, Test_Length long, End_id long, Rho_beta double, Rho double, Rho_V double, Past double, "
    "Num_past double, Val double, Train_test_split double, Method string, MAE double, MAPE double, RMSE double, R2 double, "
    "CVAR_05 double, CVAR_15 double, Time long"
)


def grid(spark: SparkSession) -> DataFrame:
    """param_combo (from 1), rho_beta, rho, rho_V, past: all combinations, the last varying fastest."""
    sizes = (len(RHOS), len(RHOS), len(RHOS), len(PASTS))
    rows = spark.range(sizes[0] * sizes[1] * sizes[2] * sizes[3])
    out, step = {"param_combo": F.col("id") + 1}, 1
    for name, values in reversed((("rho_beta", RHOS), ("rho", RHOS), ("rho_V", RHOS), ("past", PASTS))):
        index = (F.floor(F.col("id") / step) % len(values)).cast("int")
        out[name] = F.element_at(F.array(*(F.lit(v) for v in values)), index + 1)
        step *= len(values)
    return rows.select(*(c.alias(n) for n, c in out.items())).select("param_combo", "rho_beta", "rho", "rho_V", "past")


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, minimum, sample deviation and count of a value for each key."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.stddev_samp(value).alias("std"), F.count(value).alias("count"))


def least_rows(df: DataFrame, keys: list[str], value: str, ties: list[str]) -> DataFrame:
    """The row with the least value for each key; ties by the given columns. A minimum of structs, no sort of groups."""
    rest = [c for c in df.columns if c not in keys and c != value and c not in ties]
    best = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(F.struct(value, *ties, *rest)).alias("_b"))
    return best.select(*keys, *(F.col(f"_b.{c}").alias(c) for c in (value, *ties, *rest)))


def least_overall(df: DataFrame, value: str) -> DataFrame:
    """All rows with the least value."""
    least = df.agg(F.min(value).alias("_least"))  # one row
    return df.join(F.broadcast(least), F.col(value) == F.col("_least"), "left_semi")


def validation_to_test(results: DataFrame, keys: list[str], validation: Column, test: Column, value: str = "MAE") -> DataFrame:
    """Validation rows with their test rows: value_x and value_y for each key."""
    v = results.filter(validation).select(*keys, F.col(value).alias(f"{value}_x"))
    t = results.filter(test).select(*keys, F.col(value).alias(f"{value}_y"))
    return v.join(t, keys, "left")


def selected(joined: DataFrame, by: list[str], value: str = "MAE") -> DataFrame:
    """For each group the row that is best on validation."""
    return least_rows(joined, by, f"{value}_x", [c for c in joined.columns if c not in by and not c.startswith(value)])


def wins(results: DataFrame, methods: list[str], unit: str, value: str = "MAE") -> DataFrame:
    """How many units each of the methods wins, zeros included; ties go to the first name."""
    best = least_rows(results.filter(F.col("Method").isin(methods)).select(unit, "Method", value), [unit], value, ["Method"])
    counts = best.groupBy("Method").agg(F.count("*").alias("wins"))
    names = results.sparkSession.createDataFrame([(m,) for m in methods], "Method string")
    return names.join(counts, "Method", "left").select("Method", F.coalesce("wins", F.lit(0)).alias("wins"))


def gap_to(results: DataFrame, unit: str, baseline: str, value: str = "MAE") -> DataFrame:
    """Adds gap, the share by which each method's value exceeds the baseline's in its unit."""
    base = results.filter(F.col("Method") == baseline).groupBy(unit).agg(F.max(value).alias("_b"))
    return results.join(base, unit, "left").withColumn("gap", F.try_divide(F.col(value) - F.col("_b"), "_b")).drop("_b")


def pivoted(results: DataFrame, row: str, methods: list[str], value: str = "MAE") -> DataFrame:
    """One row for each value of `row`, one column with the mean for each method."""
    return results.groupBy(row).pivot("Method", methods).agg(F.avg(value))


def best_setting(results: DataFrame, keys: list[str], setting: str, value: str = "MAE") -> DataFrame:
    """For each key the least mean over the settings, and the deviation at that setting."""
    each = results.groupBy(*keys, setting).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return each.groupBy(*keys).agg(F.min("mean").alias("mean"), F.min_by("std", F.struct("mean", setting)).alias("std"))


def folded(df: DataFrame, index: str, width: int, value: str) -> DataFrame:
    """Sums of values whose index agrees modulo `width`."""
    return df.groupBy((F.col(index) % width).alias("slot")).agg(F.sum(value).alias("total"))


def ranked_slice(df: DataFrame, keys: list[str], order: list[Column], first: int, last: int) -> DataFrame:
    """Rows first .. last of each group in the given order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).filter(F.col("place").between(first, last))


def combo(index: int) -> tuple[float, float, float, int]:
    """rho_beta, rho, rho_V, past of a number of the grid, from 1."""
    at, sizes = index - 1, (len(RHOS), len(RHOS), len(RHOS), len(PASTS))
    if not 0 <= at < sizes[0] * sizes[1] * sizes[2] * sizes[3]:
        raise ValueError(f"no setting {index}")
    at, past = divmod(at, sizes[3])
    at, c = divmod(at, sizes[2])
    a, b = divmod(at, sizes[1])
    return RHOS[a], RHOS[b], RHOS[c], PASTS[past]


def sweep(results: DataFrame, by: str, methods: list[str], value: str = "MAE") -> DataFrame:
    """A sweep's curves: for each value of `by` the mean and the sample deviation of each method, method_mean and method_std."""
    return results.groupBy(by).pivot("Method", methods).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def bands(results: DataFrame, by: str, value: str = "MAE") -> DataFrame:
    """The same as a tidy frame, for a line with its band: Method, by, mean, low, high (a deviation to either side)."""
    each = results.groupBy("Method", by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("_s"))
    return each.select("Method", by, "mean", (F.col("mean") - F.col("_s")).alias("low"), (F.col("mean") + F.col("_s")).alias("high"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """bin (from 0), n of the values between low and high, high in the last one; empty bins are left out."""
    at = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(value).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def timings(results: DataFrame, by: str, time: str = "Time") -> DataFrame:
    """Mean seconds of each method for each value of `by`, of times in milliseconds."""
    return results.groupBy("Method", by).agg((F.avg(time) / 1000).alias("seconds"))


def labelled(results: DataFrame, labels: dict[str, str], name: str = "label") -> DataFrame:
    """Adds the legend of each method; methods without one keep their names."""
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    return results.withColumn(name, F.coalesce(F.create_map(*pairs)[F.col("Method")], F.col("Method")))


def features(rows: DataFrame, value: str = "y") -> DataFrame:
    """Features of each series: n, mean, deviation, least, most, energy (sum of squares), mean change and mean absolute change
    from row to row, autocorrelation at one row, slope over t. rows: series, t (dense), value."""
    from tideweave.operators.windows import blocked

    each = blocked(rows.select("series", "t", F.col(value).alias("v")), 1, lambda f, w: f.withColumn("p", F.lag("v").over(w)))
    change = F.col("v") - F.col("p")
    return each.groupBy("series").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("low"), F.max("v").alias("high"),
        F.sum(F.col("v") * F.col("v")).alias("energy"), F.avg(change).alias("mean_change"), F.avg(F.abs(change)).alias("mean_abs_change"),
        F.corr("v", "p").alias("autocorrelation"), F.try_divide(F.covar_pop("t", "v"), F.var_pop("t")).alias("slope"),
    )
