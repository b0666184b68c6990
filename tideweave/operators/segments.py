"""Segmentation of irregular six-hourly records into storms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideweave.operators.windows import blocked, running_sum

#: A row starts a storm, given day, hour and those of the row before.
BREAK = """CASE
  WHEN p_day IS NULL THEN true
  WHEN abs(days - p_day) > 1 AND days <> 1 THEN true
  WHEN abs(days - p_day) > 1 THEN NOT (hours = p_hour + 6 OR (hours = 0 AND p_hour = 18))
  WHEN hours <> p_hour + 6 THEN NOT (hours = 0 AND p_hour = 18)
  ELSE days - p_day > 0 END"""


def starts_storm(p_day: int | None, p_hour: int | None, days: int, hours: int) -> bool:
    """BREAK for one row, for live operators."""
    follows = p_day is not None and (hours == p_hour + 6 or (hours == 0 and p_hour == 18))
    if p_day is None or (abs(days - p_day) > 1 and days != 1):
        return True
    if hours == p_hour + 6 and abs(days - p_day) <= 1:
        return days > p_day
    return not follows


def storms(rows: DataFrame) -> DataFrame:
    """Adds storm (1, 2, ... in each series), k (place in the storm) and length. rows: series, t (dense), days, hours."""
    lagged = blocked(rows, 1, lambda f, w: f.withColumns({"p_day": F.lag("days").over(w), "p_hour": F.lag("hours").over(w)}))
    flagged = lagged.withColumn("_start", F.expr(BREAK).cast("int")).drop("p_day", "p_hour")
    numbered = running_sum(flagged, F.col("_start"), "_earlier")
    numbered = numbered.withColumn("storm", (F.coalesce("_earlier", F.lit(0.0)) + F.col("_start")).cast("long")).drop("_earlier")
    extent = numbered.groupBy("series", "storm").agg(F.min("t").alias("_first"), F.count("*").alias("length"))
    return numbered.join(extent, ["series", "storm"]).withColumn("k", F.col("t") - F.col("_first") + 1).drop("_first", "_start")


def long_storms(rows: DataFrame, past: int, flush_last: bool = True) -> DataFrame:
    """Rows of the storms with more than past + 1 rows, numbered anew. flush_last=False leaves out each series' last storm."""
    found = storms(rows).filter(F.col("length") > past + 1)
    if not flush_last:
        last = storms(rows).groupBy("series").agg(F.max("storm").alias("_last"))
        found = found.join(last, "series").filter("storm < _last").drop("_last")
    return renumbered(found)


def renumbered(rows: DataFrame, name: str = "pos") -> DataFrame:
    """Adds the position in the series of the rows that are left: storms first, then places in them."""
    sizes = rows.groupBy("series", "storm").agg(F.count("*").alias("_n"), F.min("k").alias("_k"))
    before = Window.partitionBy("series").orderBy("storm").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return rows.join(sizes, ["series", "storm"]).withColumn(name, F.col("_before") + F.col("k") - F.col("_k") + 1).drop("_n", "_k", "_before")


def storm_parts(rows: DataFrame, forecasts: list[str], truth: str = "truth", speed: str = "current_speed") -> DataFrame:
    """The parts of a storm's records: series, storm, k, x (the forecasts, the constant last), y (the truth), current_speed."""
    x = F.array(*(F.col(c).cast("double") for c in forecasts), F.lit(1.0))
    return rows.select("series", "storm", "k", x.alias("x"), F.col(truth).cast("double").alias("y"), F.col(speed).cast("double").alias("current_speed"))
