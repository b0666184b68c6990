"""Forecast panels: (series, t, x, y), x an array that begins with the intercept 1.0, t dense from 1.

Everything reads a panel several times (bounds, means, lags, scores), so it is built once and written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideweave.operators.windows import blocked, dense_index, running_sum
from tideweave.sources.rounds import written

#: Rows that the longest member looks back; earlier rows have no complete forecasts.
WARM_UP = 7
MEMBERS = ("m1", "m2", "m3", "m4", "m5", "m6")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def members(rows: DataFrame) -> DataFrame:
    """Six forecasts of y from earlier rows only: the last value, means of 3 and 7, minimum and maximum of 7, mean of all."""

    def work(df, w):
        last = lambda n: w.rowsBetween(-n, -1)
        return df.select(
            "*", F.lag("y").over(w).alias("m1"), F.avg("y").over(last(3)).alias("m2"), F.avg("y").over(last(7)).alias("m3"),
            F.min("y").over(last(7)).alias("m4"), F.max("y").over(last(7)).alias("m5"),
        )

    out = blocked(rows, WARM_UP, work)
    out = running_sum(out, F.col("y"), "_sum").withColumn("m6", F.try_divide("_sum", F.col("t") - 1)).drop("_sum")
    return out.filter(F.col("t") > WARM_UP).withColumn("t", F.col("t") - WARM_UP).select("series", "t", "y", *MEMBERS)


def wide_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series (event type), t, y (value), m1 .. m6 from the table of events."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), "ts", "event_id", F.col("value").alias("y"))
    return written(members(dense_index(rows, ["series"], ["ts", "event_id"]).select("series", "t", "y")), "panel")


def orders_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series (order priority), t (day), y (revenue of the day), m1 .. m6 from the table of orders."""
    day = F.date_trunc("day", "o_orderdate").alias("day")
    daily = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series"), day).agg(F.sum("o_totalprice").alias("y"))
    return written(members(dense_index(daily, ["series"], ["day"]).select("series", "t", "y")), "panel")


def to_panel(wide: DataFrame, forecasts: list[str] | tuple[str, ...] = MEMBERS, intercept: str = "prepend") -> DataFrame:
    """series, t, x, y of a wide table. intercept: `prepend` adds 1.0; `replace_first` overwrites the first forecast."""
    cols: list[Column] = [F.col(c).cast("double") for c in forecasts]
    x = [F.lit(1.0), *(cols if intercept == "prepend" else cols[1:])]
    return wide.select("series", "t", F.array(*x).alias("x"), F.col("y").cast("double").alias("y"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events panel in array form."""
    return to_panel(wide_panel(spark, sf_dir))
