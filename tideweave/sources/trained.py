"""Ensemble members from trained models: regressions on lags, fitted in folds that walk forward.

A fold is a stretch of rows of each series; its forecasts come from models that saw only the rows before it, of all series. The
first stretch has no forecasts. Lags are taken relative to the last one and over the mean absolute step of the lags, so that one model
serves series of any level and scale; forecasts are brought back. Each model is one distributed fit a fold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Estimator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, GeneralizedLinearRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideweave.operators.windows import blocked
from tideweave.sources.rounds import written


def regressors() -> dict[str, Estimator]:
    """The members by name."""
    return {
        "linear": LinearRegression(regParam=0.01), "lasso": LinearRegression(regParam=0.01, elasticNetParam=1.0), "huber": LinearRegression(loss="huber", regParam=0.01),
        "gaussian": GeneralizedLinearRegression(family="gaussian", regParam=0.1), "tree": DecisionTreeRegressor(maxDepth=4, seed=1),
        "forest": RandomForestRegressor(numTrees=10, maxDepth=4, seed=1), "boosted": GBTRegressor(maxIter=5, maxDepth=3, seed=1),
    }


def lag_table(rows: DataFrame, lags: int) -> DataFrame:
    """series, t, y, base (the last value), unit (mean absolute step of the lags), l1 .. (lags on that scale), goal (y on it)."""
    names = [f"_v{k}" for k in range(1, lags + 1)]
    out = blocked(rows, lags, lambda f, w: f.withColumns({n: F.lag("y", k).over(w) for k, n in enumerate(names, 1)}))
    out = out.filter(F.col(names[-1]).isNotNull())
    steps = [F.abs(F.col(a) - F.col(b)) for a, b in zip(names, names[1:])]
    unit = reduce(lambda a, b: a + b, steps) / len(steps)
    out = out.withColumns({"base": F.col("_v1"), "unit": F.when(unit > 0, unit).otherwise(1.0)})
    scaled = {f"l{k}": (F.col(n) - F.col("base")) / F.col("unit") for k, n in enumerate(names, 1) if k > 1}
    return out.withColumns(scaled | {"goal": (F.col("y") - F.col("base")) / F.col("unit")}).drop(*names)


def walk_forward(rows: DataFrame, models: dict[str, Estimator] | None = None, lags: int = 5, folds: int = 3) -> DataFrame:
    """series, t (from 1), y and a column for each model: forecasts of the rows after the first of folds + 1 equal stretches.

    rows: series, t (dense), y. A model of fold k is fitted to the rows of all series in stretches before k.
    """
    models = models or regressors()
    table = lag_table(rows.select("series", "t", "y"), lags)
    size = rows.groupBy("series").agg(F.max("t").alias("_n"))
    stretch = F.least(F.floor((F.col("t") - 1) * (folds + 1) / F.col("_n")), F.lit(folds)).cast("int")
    table = table.join(size, "series").withColumn("fold", stretch).drop("_n")
    table = VectorAssembler(inputCols=[f"l{k}" for k in range(2, lags + 1)], outputCol="features").transform(table)
    table = written(table.select("series", "t", "y", "base", "unit", "goal", "fold", "features"), "lags")
    parts = []
    for k in range(1, folds + 1):
        known, asked = table.filter(F.col("fold") < k), table.filter(F.col("fold") == k)
        for name, model in models.items():
            fitted = model.copy({model.labelCol: "goal", model.featuresCol: "features", model.predictionCol: "_p"}).fit(known)
            asked = fitted.transform(asked).withColumn(name, F.col("_p") * F.col("unit") + F.col("base")).drop("_p")
        parts.append(asked.select("series", "t", "y", *models))
    out = written(reduce(DataFrame.unionByName, parts), "members")
    first = out.groupBy("series").agg((F.min("t") - 1).alias("_f"))
    return out.join(first, "series").select("series", (F.col("t") - F.col("_f")).alias("t"), "y", *models)
