"""Features of series: dependence over lags, order patterns, periods, change and runs; a row for each series and variable.

Rows are series, of (which variable), t (dense), v. Lags come from blocks with a halo, numbers of runs from running sums over blocks,
periods from segments of a fixed length; everything else is one aggregate, so that a long series is many tasks. Null and
non-finite values don't count: series have to be dense in t after they are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideweave.operators.windows import blocked, running_sum

KEYS = ("series", "of")


def variables(panel: DataFrame, members: list[str] | tuple[str, ...]) -> DataFrame:
    """series, of, t, v of a wide panel: the target y, each member, and each member's error (member less target)."""
    each = [("y", F.col("y")), *((m, F.col(m)) for m in members), *((f"{m}_error", F.col(m) - F.col("y")) for m in members)]
    held = F.explode(F.array(*(F.struct(F.lit(n).alias("of"), c.cast("double").alias("v")) for n, c in each)))
    return panel.select("series", "t", held.alias("_e")).select("series", "_e.of", "t", "_e.v")


def centred(rows: DataFrame) -> DataFrame:
    """Adds n, d (v less its mean) and sd (population deviation), from one small row for each key."""
    stats = rows.groupBy(*KEYS).agg(F.count("v").alias("n"), F.avg("v").alias("_m"), F.stddev_pop("v").alias("sd"))
    return rows.join(stats, list(KEYS)).withColumn("d", F.col("v") - F.col("_m")).drop("_m")


def lagged(rows: DataFrame, most: int) -> DataFrame:
    """Adds d_1 .. d_most and v_1, v_2: the values so many rows before."""

    def work(frame, w):
        return frame.withColumns({f"d_{k}": F.lag("d", k).over(w) for k in range(1, most + 1)} | {f"v_{k}": F.lag("v", k).over(w) for k in (1, 2)})

    return blocked(rows, max(most, 2), work, series=KEYS)


def partial_autocorrelations(r: Column, most: int) -> Column:
    """Partial autocorrelations of 1 .. most from the autocorrelations r (an array from lag 1 on), by the recursion over orders that
    keeps the coefficients of the order before."""
    start = F.struct(F.array().cast("array<double>").alias("phi"), F.array().cast("array<double>").alias("out"))

    def order(state: Column, k: Column) -> Column:
        phi = state["phi"]
        back = F.reverse(F.slice(r, 1, k - 1))
        explained = F.aggregate(F.zip_with(phi, back, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        known = F.aggregate(F.zip_with(phi, F.slice(r, 1, k - 1), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        last = F.try_divide(F.get(r, k - 1) - explained, 1 - known)
        new = F.zip_with(phi, F.reverse(phi), lambda a, b: a - last * b)
        return F.struct(F.concat(new, F.array(last)).alias("phi"), F.concat(state["out"], F.array(last)).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, order, lambda s: s["out"])


def dependence(rows: DataFrame, most: int = 10) -> DataFrame:
    """n, autocovariance, autocorrelation and partial autocorrelation (arrays from lag 1 on, sums over n), and what
    neighbours tell: mean_change, complexity (root of summed squared changes), c3, asymmetry, crossings of the mean, peaks, beyond_1 and beyond_2
    (share over so many deviations), slope over t."""
    v, v1, v2, d = F.col("v"), F.col("v_1"), F.col("v_2"), F.col("d")
    sums = [F.sum(d * F.col(f"d_{k}")).alias(f"s{k}") for k in range(1, most + 1)]
    found = lagged(centred(rows), most).groupBy(*KEYS).agg(
        F.count("v").alias("n"), F.avg(d * d).alias("variance"), *sums,
        F.avg(F.abs(v - v1)).alias("mean_change"), F.sqrt(F.sum((v - v1) * (v - v1))).alias("complexity"), F.avg(v * v1 * v2).alias("c3"),
        F.avg(v * v * v1 - v1 * v2 * v2).alias("asymmetry"), F.count_if((d > 0) != (F.col("d_1") > 0)).alias("crossings"),
        F.count_if((v1 > v) & (v1 > v2)).alias("peaks"), *(F.avg((F.abs(d) > k * F.col("sd")).cast("double")).alias(f"beyond_{k}") for k in (1, 2)),
        F.try_divide(F.covar_pop("t", "d"), F.var_pop("t")).alias("slope"),
    )
    covariance = F.array(*(F.coalesce(F.col(f"s{k}"), F.lit(0.0)) / F.col("n") for k in range(1, most + 1)))
    found = found.withColumn("autocovariance", covariance)
    found = found.withColumn("autocorrelation", F.transform("autocovariance", lambda c: F.try_divide(c, F.col("variance"))))
    return found.withColumn("partial", partial_autocorrelations(F.col("autocorrelation"), most)).drop(*(f"s{k}" for k in range(1, most + 1)))


def permutation_entropy(rows: DataFrame, order: int = 3) -> DataFrame:
    """entropy of the order patterns of `order` successive values, 0 to 1; of equal values the earlier counts as the smaller."""

    def work(frame, w):
        return frame.withColumns({f"_o{k}": F.lag("v", order - 1 - k).over(w) for k in range(order - 1)} | {f"_o{order - 1}": F.col("v")})

    held = blocked(rows, order - 1, work, series=KEYS).filter(F.col("_o0").isNotNull())
    value = [F.col(f"_o{k}") for k in range(order)]
    rank = [sum((((value[j] <= value[k]) if j < k else (value[j] < value[k])).cast("int") for j in range(order) if j != k), F.lit(0)) for k in range(order)]
    counts = held.groupBy(*KEYS, F.concat_ws(",", *(r.cast("string") for r in rank)).alias("_p")).agg(F.count("*").alias("_c"))
    c = F.col("_c")  # at most order! patterns for each key
    whole = F.log(F.sum(c)) - F.sum(c * F.log(c)) / F.sum(c)
    return counts.groupBy(*KEYS).agg((whole / math.log(math.factorial(order))).alias("entropy"))


def periodogram(rows: DataFrame, length: int = 64, most: int = 8) -> DataFrame:
    """power (an array of frequencies 1 .. most over `length` rows), the mean over all full segments of that length, each less its mean."""
    at, place = F.floor((F.col("t") - 1) / length), (F.col("t") - 1) % length
    turn = [2 * math.pi * f / length for f in range(1, most + 1)]
    waves = [s(place * a) for a in turn for s in (F.cos, F.sin)]  # over a full segment each sums to zero, so its mean drops out
    parts = rows.groupBy(*KEYS, at.alias("_s")).agg(F.count("v").alias("_n"), *(F.sum(F.col("d") * w).alias(f"_w{k}") for k, w in enumerate(waves)))
    square = [(F.col(f"_w{2 * f}") * F.col(f"_w{2 * f}") + F.col(f"_w{2 * f + 1}") * F.col(f"_w{2 * f + 1}")) / length for f in range(most)]
    full = parts.filter(F.col("_n") == length)
    return full.groupBy(*KEYS).agg(F.array(*(F.avg(s) for s in square)).alias("power"))


def longest_above(rows: DataFrame) -> DataFrame:
    """longest_above: rows of the longest run over the mean (0 if there is none). rows: with d."""
    up = F.col("d") > 0
    marked = blocked(rows.withColumn("_u", up), 1, lambda f, w: f.withColumn("_b", (F.col("_u") & ~F.coalesce(F.lag("_u").over(w), F.lit(False))).cast("int")), series=KEYS)
    numbered = running_sum(marked, F.col("_b"), "_r", series=KEYS).withColumn("_r", F.coalesce("_r", F.lit(0.0)) + F.col("_b"))
    runs = numbered.groupBy(*KEYS, "_r").agg(F.count_if("_u").alias("_c"))
    return runs.groupBy(*KEYS).agg(F.max("_c").alias("longest_above"))


def series_features(rows: DataFrame, most: int = 10, order: int = 3, length: int = 64, frequencies: int = 8) -> DataFrame:
    """All features, one row for each series and variable. power is null where no segment is full."""
    rows = rows.filter(F.abs("v") < float("inf"))
    d = centred(rows)
    out = dependence(rows, most)
    for part in (permutation_entropy(rows, order), periodogram(d, length, frequencies), longest_above(d)):
        out = out.join(part, list(KEYS), "left")
    return out
