"""Lag vectors: the features that the adaptive weights follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideweave.functions.vectors import total
from tideweave.operators.windows import blocked


def lag_matrix(
    panel: DataFrame,
    past: int,
    rule: str = "value",
    lead: int = 1,
    constant: bool = False,
    present: bool = False,
    keys: tuple[str, ...] = ("series",),
) -> DataFrame:
    """Adds z for the rows t >= past + lead of each series.

    rule `value`: x of the rows t - 1 .. t - past (latest first), then y of t - lead - past + 1 .. t - lead (oldest first);
    `error`: x - y of those rows, then `past` ones; `error_norm`: each block of errors over the sum of its absolute values.
    constant appends 1.0; present puts the row's own x first.
    """

    def work(frame, w):
        lags = {f"_x{k}": F.lag("x", k).over(w) for k in range(1, past + 1)}
        ys = {f"_y{k}": F.lag("y", k).over(w) for k in range(1, past + lead)}
        return frame.withColumns(lags | ys)

    out = blocked(panel, past + lead, work, series=keys)
    parts: list[Column] = [F.col("x")] if present else []
    for k in range(1, past + 1):
        block, y = F.col(f"_x{k}"), F.col(f"_y{k}")
        if rule != "value":
            block = F.transform(F.zip_with(block, F.array_repeat(y, F.size(block)), lambda a, b: a - b), lambda v: v)
        if rule == "error_norm":
            norm = total(F.transform(block, lambda v: F.abs(v)))
            block = F.zip_with(block, F.array_repeat(norm, F.size(block)), lambda v, s: F.try_divide(v, s))
        parts.append(block)
    tail = [F.col(f"_y{k}") for k in range(past + lead - 1, lead - 1, -1)] if rule == "value" else [F.lit(1.0)] * past
    parts.append(F.array(*tail, *([F.lit(1.0)] if constant else [])))
    kept = [c for c in panel.columns]
    return out.filter(F.col("t") >= past + lead).select(*kept, F.concat(*parts).alias("z"))


def storm_lags(rows: DataFrame, past: int) -> DataFrame:
    """Adds z for rows k > past of each storm: x of the rows before, latest first, then the current speeds of the last
    `past` rows with the present one, oldest first. Targets aren't used: they are known only later."""

    def work(frame, w):
        lags = {f"_x{k}": F.lag("x", k).over(w) for k in range(1, past + 1)}
        return frame.withColumns(lags | {f"_c{k}": F.lag("current_speed", k).over(w) for k in range(1, past)})

    out = blocked(rows, past, work, series=("series", "storm"), t="k")
    speeds = [F.col(f"_c{k}") for k in range(past - 1, 0, -1)] + [F.col("current_speed")]
    z = F.concat(*(F.col(f"_x{k}") for k in range(1, past + 1)), F.array(*speeds))
    return out.filter(F.col("k") > past).select(*rows.columns, z.alias("z"))
