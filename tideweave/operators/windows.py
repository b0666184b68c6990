"""Order-dependent operators that stay parallel within a long series.

A window over a whole series is one task. Here a series is cut into blocks of consecutive rows; each block also gets
the last rows of the block before it (its halo), so that frames of bounded width are complete, and the blocks of the
longest series spread over the cluster. Running sums go in two levels, within blocks and over the much smaller table of
block totals; so does numbering, within ranges and over their sizes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideweave.sources.rounds import written

#: Rows of a block.
BLOCK = 1 << 16


def dense_index(df: DataFrame, series: list[str], order: list[str], name: str = "t") -> DataFrame:
    """Adds the 1-based position of each row in its series; rows whose order is the same are numbered in any order.

    Rows are dealt out by ranges of series and order, from sampled bounds, so that a series of any length or a busy day is many
    tasks, and written once to the shared folder with their place in their range. How many rows of a series lie in the ranges before is a
    running count over one small row for each series and range.
    """
    ranged = df.repartitionByRange(*series, *order).sortWithinPartitions(*series, *order).withColumn("_m", F.monotonically_increasing_id())
    rows = written(ranged, "ranges")
    part = F.shiftright("_m", 33).alias("_part")
    sizes = rows.groupBy(*series, part).agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = Window.partitionBy(*series).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
    starts = sizes.select(*(F.col(c).alias(f"_k{k}") for k, c in enumerate(series)), "_part", start.alias("_start"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{k}")) for k, c in enumerate(series)] + [F.shiftright("_m", 33) == F.col("_part")]
    return rows.join(starts, same).select(*df.columns, (F.col("_m") + F.col("_start") + 1).cast("long").alias(name))


def blocked(df: DataFrame, width: int, work: Callable[[DataFrame, Window], DataFrame], series: tuple[str, ...] = ("series",), t: str = "t", block: int = BLOCK) -> DataFrame:
    """Applies work(frame, window) with windows over blocks; its frames may look at most `width` rows back."""
    block = max(block, width)
    at = F.floor((F.col(t) - 1) / block)
    late = (F.col(t) - 1) % block >= block - width
    spread = df.withColumn("_block", F.explode(F.when(late, F.array(at, at + 1)).otherwise(F.array(at))))
    done = work(spread, Window.partitionBy(*series, "_block").orderBy(t))
    return done.filter(F.col("_block") == at).drop("_block")


def running_sum(df: DataFrame, value: Column, name: str, series: tuple[str, ...] = ("series",), t: str = "t", block: int = BLOCK) -> DataFrame:
    """Adds the sum of `value` over all earlier rows of the series (null in the first)."""
    rows = df.withColumn("_block", F.floor((F.col(t) - 1) / block)).withColumn("_v", value)
    earlier = Window.partitionBy(*series).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*series, "_block").agg(F.sum("_v").alias("_s")).withColumn("_before", F.sum("_s").over(earlier)).drop("_s")
    own = F.sum("_v").over(Window.partitionBy(*series, "_block").orderBy(t).rowsBetween(Window.unboundedPreceding, -1))
    both = F.when(F.col("_before").isNull() & own.isNull(), F.lit(None)).otherwise(F.coalesce("_before", F.lit(0.0)) + F.coalesce(own, F.lit(0.0)))
    return rows.join(sums, [*series, "_block"]).withColumn(name, both).drop("_block", "_before", "_v")


def running_sums(df: DataFrame, values: dict[str, Column], series: tuple[str, ...] = ("series",), t: str = "t", block: int = BLOCK) -> DataFrame:
    """Adds the sums of several values over all earlier rows of the series (0 in the first), in one pass over the blocks."""
    rows = df.withColumn("_block", F.floor((F.col(t) - 1) / block)).withColumns({f"_v{n}": v for n, v in values.items()})
    earlier = Window.partitionBy(*series).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*series, "_block").agg(*(F.sum(f"_v{n}").alias(f"_t{n}") for n in values))
    totals = totals.select(*series, "_block", *(F.coalesce(F.sum(f"_t{n}").over(earlier), F.lit(0.0)).alias(f"_b{n}") for n in values))
    own = Window.partitionBy(*series, "_block").orderBy(t).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({n: F.coalesce(F.sum(f"_v{n}").over(own), F.lit(0.0)) for n in values}).join(totals, [*series, "_block"])
    return out.withColumns({n: F.col(n) + F.col(f"_b{n}") for n in values}).drop("_block", *(f"_{c}{n}" for n in values for c in "vb"))


def sliding_sums(frame: DataFrame, window: Window, values: dict[str, Column], first: int, last: int) -> DataFrame:
    """Adds the sums of several values over the rows `first` .. `last` before each row (null where there is none).

    Spark adds a sliding frame up anew for each row. Here sums of 1, 2, 4, ... rows come from two of half the length, and the
    frame's from those that its length has in binary: a few lags for each row, and nothing is subtracted.
    """
    plus = lambda a, b: F.coalesce(a + b, a, b)
    out = frame.withColumns({f"_p{n}": v for n, v in values.items()} | {n: F.lit(None).cast("double") for n in values})
    at, size, left = first, 1, last - first + 1
    while left > 0:
        step = {n: plus(F.col(n), F.lag(f"_p{n}", at).over(window)) for n in values} if left % 2 else {}
        step |= {f"_p{n}": plus(F.col(f"_p{n}"), F.lag(f"_p{n}", size).over(window)) for n in values} if left > 1 else {}
        out = out.withColumns(step)
        at, size, left = at + size * (left % 2), size * 2, left // 2
    return out.drop(*(f"_p{n}" for n in values))
