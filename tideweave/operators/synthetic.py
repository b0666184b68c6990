"""Synthetic series and ensembles. Noise comes from hashes of (seed, series of draws, place), not from a generator's
state: the same in every run, whatever the partitions, and the same in any engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCALE = float(1 << 52)


def uniform(*key: Column | str | int) -> Column:
    """A number in (0, 1) for a key."""
    parts = [F.lit(str(k)) if isinstance(k, (str, int)) else k.cast("string") for k in key]
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") + 0.5) / _SCALE


def normal(*key: Column | str | int) -> Column:
    """A standard normal number for a key (Box-Muller)."""
    return F.sqrt(-2 * F.ln(uniform("a", *key))) * F.cos(2 * F.pi() * uniform("b", *key))


def target(spark: SparkSession, length: int, period: float, sigma: float, seed: int) -> DataFrame:
    """t = 1 .. 2 * length, y = sin(2 pi period t / length) + noise."""
    t = (F.col("id") + 1).alias("t")
    rows = spark.range(2 * length).select(t)
    return rows.select("t", (F.sin(2 * F.pi() * period * F.col("t") / length) + sigma * normal(seed, "y", F.col("t"))).alias("y"))


def ensemble(
    y: DataFrame, models: int, length: int, seed: int, bias: float = 0.5, spread: float = 0.5, drift_bias: float = 0.0,
    drift_spread: float = 0.0, p_discrete: float = 1.0,
) -> DataFrame:
    """t, model (1 .. models), x, y: each model has its own bias and noise, and a drift: a ramp of t / length, or, for
    p_discrete < 1, present at a share of the steps."""
    m, t = F.col("model"), F.col("t")
    rows = y.withColumn("model", F.explode(F.sequence(F.lit(1), F.lit(models))))
    b, s = (2 * uniform(seed, "bias", m) - 1) * bias, uniform(seed, "spread", m) * spread
    db, ds = drift_bias * normal(seed, "drift", m), uniform(seed, "dspread", m) * drift_spread
    step = t / length if p_discrete >= 1 else (uniform(seed, "on", m, t) < p_discrete).cast("double")
    x = F.col("y") + b + s * normal(seed, "x", m, t) + step * (db + ds * normal(seed, "dx", m, t))
    return rows.select("t", "model", x.alias("x"), "y")


def drifted_target(y: DataFrame, length: int, seed: int, mu: float, sigma: float) -> DataFrame:
    """y with a drift of its own, after the ensemble was made."""
    return y.withColumn("y", F.col("y") + F.col("t") / length * (mu + sigma * normal(seed, "ydrift", F.col("t"))))


def perturbed(ensemble_rows: DataFrame, first: int, last: int, size: float, kind: str = "abrupt") -> DataFrame:
    """A perturbation of x in rows first .. last: at once, or growing from the first row (`gradual`)."""
    span = max(1, last - first)
    amount = F.lit(size) if kind == "abrupt" else size * (F.col("t") - first) / span
    return ensemble_rows.withColumn("x", F.when(F.col("t").between(first, last), F.col("x") + amount).otherwise(F.col("x")))


def wide(rows: DataFrame, models: int, series: str = "synthetic") -> DataFrame:
    """series, t, y, m1 .. m<models>."""
    out = rows.groupBy("t").pivot("model", list(range(1, models + 1))).agg(F.first("x")).join(rows.filter("model = 1").select("t", "y"), "t")
    return out.select(F.lit(series).alias("series"), "t", "y", *(F.col(str(k)).alias(f"m{k}") for k in range(1, models + 1)))
