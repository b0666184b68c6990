"""Scores of forecasts: one pass of aggregates, and conditional value at risk from sorted errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideweave.sources.rounds import written

KEYS = ("series", "method")


def mae(err: Column) -> Column:
    return F.avg(F.abs(err))


def mape(err: Column, y: Column) -> Column:
    """Per cent; rows with y = 0 don't count."""
    return 100 * F.avg(F.abs(F.try_divide(err, y)))


def rmse(err: Column) -> Column:
    return F.sqrt(F.avg(err * err))


def r2(err: Column, y: Column) -> Column:
    return 1 - F.try_divide(F.avg(err * err), F.var_pop(y))


def scores(errors: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """n, MAE, MAPE, RMSE, R2 for each key. errors: keys, y, err."""
    e, y = F.col("err"), F.col("y")
    return errors.groupBy(*keys).agg(F.count("*").alias("n"), mae(e).alias("mae"), mape(e, y).alias("mape"), rmse(e).alias("rmse"), r2(e, y).alias("r2"))


ALPHAS = (0.05, 0.15)
#: Buckets of losses for each power of two: a bucket's width is under a thousandth of its losses.
FINE = 1024


def cvar(errors: DataFrame, alphas: tuple[float, ...] = ALPHAS, keys: tuple[str, ...] = KEYS, loss: Column | None = None) -> DataFrame:
    """For each key and alpha the least over tau of tau + sum(max(loss - tau, 0)) / (alpha * n). Losses aren't negative.

    The least is taken at the ceil(alpha * n)-th largest loss. A histogram, by buckets of the logarithm, tells in which bucket
    that loss lies and what the buckets above it hold; only that bucket's losses are shuffled, equal ones counted together, and
    sorted. Losses are worked out once and written, as both passes read them.
    """
    at = loss if loss is not None else F.abs("err")
    return _cvar(written(errors.select(*keys, at.alias("_e")), "losses"), alphas, keys)


def _cvar(losses: DataFrame, alphas: tuple[float, ...], keys: tuple[str, ...]) -> DataFrame:
    """cvar() of keys, _e in two passes."""
    placed = losses.filter("_e IS NOT NULL").withColumn("_b", F.coalesce(F.floor(F.log2("_e") * FINE), F.lit(-(1 << 40))))
    histogram = placed.groupBy(*keys, "_b").agg(F.count("*").alias("_m"), F.sum("_e").alias("_s"))
    down = Window.partitionBy(*keys).orderBy(F.desc("_b"))
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    ranked = histogram.withColumns(
        {"_n": F.sum("_m").over(Window.partitionBy(*keys)), "_over": F.coalesce(F.sum("_m").over(before), F.lit(0)), "_above": F.coalesce(F.sum("_s").over(before), F.lit(0.0))}
    )
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("no"), (F.lit(a) * F.col("_n")).alias("k")) for k, a in enumerate(alphas)))).alias("_a")
    cuts = ranked.select(*(F.col(c).alias(f"_k{k}") for k, c in enumerate(keys)), F.col("_b").alias("_at"), "_m", "_over", "_above", each).filter("_over < _a.k AND _a.k <= _over + _m")
    same = [F.col(c).eqNullSafe(F.col(f"_k{k}")) for k, c in enumerate(keys)] + [F.col("_b") == F.col("_at")]
    own = placed.join(F.broadcast(cuts), same).groupBy(*keys, "_a", "_over", "_above", "_e").agg(F.count("*").alias("_c"))
    inner = own.select(*keys, "_e", "_c", "_over", "_above", "_a")
    to = F.col("_over") + F.sum("_c").over(Window.partitionBy(*keys, "_a.no").orderBy(F.desc("_e")))
    share = F.greatest(F.least(F.col("_to").cast("double"), F.col("_a.k")) - (F.col("_to") - F.col("_c")), F.lit(0.0))
    part = inner.withColumn("_to", to).groupBy(*keys, "_a").agg((F.first("_above") + F.sum(share * F.col("_e"))).alias("_v"))
    own = [F.max(F.when(F.col("_a.no") == k, F.col("_v") / F.col("_a.k"))).alias(f"cvar_{round(a * 100):02d}") for k, a in enumerate(alphas)]
    return part.groupBy(*keys).agg(*own)


def exceedances(errors: DataFrame, bounds: tuple[float, ...] = (1.5, 2.0, 2.5, 3.0), keys: tuple[str, ...] = KEYS) -> DataFrame:
    """How many absolute errors are over each bound."""
    return errors.groupBy(*keys).agg(*(F.count_if(F.abs("err") > b).alias(f"over_{str(b).replace('.', '_')}") for b in bounds))


def report(errors: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """scores() and cvar() together, over errors that are worked out once and written to the shared folder."""
    errors = written(errors.select(*keys, "y", "err"), "errors")
    return scores(errors, keys).join(_cvar(errors.select(*keys, F.abs("err").alias("_e")), ALPHAS, keys), list(keys))


def member_errors(rows: DataFrame, first: int = 2) -> DataFrame:
    """series, t, model (place in x, 0 the intercept), y, err of each member; rows have x, y and y_true, mu, sigma."""
    each = rows.select("series", "t", "y_true", "mu", "sigma", F.posexplode("x").alias("model", "v"))
    pred = F.col("v") * F.col("sigma") + F.col("mu")
    return each.filter(F.col("model") >= first - 1).select("series", "t", "model", F.col("y_true").alias("y"), (F.col("y_true") - pred).alias("err"))


def best_member(errors: DataFrame) -> DataFrame:
    """series, model, mape: the member with the least MAPE in hindsight; ties go to the lowest place."""
    each = errors.groupBy("series", "model").agg(mape(F.col("err"), F.col("y")).alias("mape"))
    least = each.groupBy("series").agg(F.min(F.struct("mape", "model")).alias("b"))
    return least.select("series", F.col("b.model").alias("model"), F.col("b.mape").alias("mape"))
