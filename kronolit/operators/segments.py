"""Piecewise constant scale of a series: exact penalised changepoints, and the factor of a day by segment or nearest segment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def optimal_partition(y: np.ndarray, weight: np.ndarray, penalty: float) -> list[int]:
    """Starts of the segments that minimise the weighted squares around segment means plus ``penalty`` a segment. Exact, O(n^2)."""
    n = len(y)
    w, s, q = (np.concatenate(([0.0], np.cumsum(v))) for v in (weight, weight * y, weight * y * y))
    best, back = np.zeros(n + 1), np.zeros(n + 1, dtype=np.int64)
    best[0] = -penalty
    for j in range(1, n + 1):
        i = np.arange(j)
        cost = best[:j] + q[j] - q[i] - (s[j] - s[i]) ** 2 / (w[j] - w[i]) + penalty
        back[j] = int(cost.argmin())
        best[j] = cost[back[j]]
    starts, j = [], n
    while j > 0:
        j = int(back[j])
        starts.append(j)
    return starts[::-1]


def scale_segments(ratios: DataFrame, key: str, day: str, ratio: str, penalty: float = 1.0, sigma: float = 0.05) -> DataFrame:
    """key, start, end, factor, n: the stretches of months in which the ratios of a key stand at one level.

    The ratios of a key and month are first reduced to their median and number, so that a key is as many points as the calendar
    has months, however many rows it has; those points are segmented exactly on the log scale (``sigma``: spread of a month's
    median). Ratios that are null, NaN or not positive and rows without key or day are left out.
    """
    ok = F.col(key).isNotNull() & F.col(day).isNotNull() & (F.col(ratio) > 0) & ~F.isnan(ratio)
    m = ratios.where(ok).groupBy(F.col(key).alias("k"), F.trunc(F.col(day).cast("date"), "MM").alias("month"))
    m = m.agg(F.percentile(F.log(F.col(ratio)), F.lit(0.5)).alias("y"), F.count("*").alias("n"), F.min(F.col(day).cast("date")).alias("a"), F.max(F.col(day).cast("date")).alias("b"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("month")
        y = p["y"].to_numpy()
        starts = optimal_partition(y, np.full(len(y), 1 / (2 * sigma**2)), penalty)
        ends = [*starts[1:], len(p)]
        rows = [(p["k"].iloc[0], p["a"].iloc[i], p["b"].iloc[j - 1], float(np.exp(np.median(y[i:j]))), int(p["n"].iloc[i:j].sum())) for i, j in zip(starts, ends, strict=True)]
        return pd.DataFrame(rows, columns=["k", "start", "end", "factor", "n"])

    kind = dict(m.dtypes)["k"]
    return m.groupBy("k").applyInPandas(run, f"k {kind}, start date, end date, factor double, n long").withColumnRenamed("k", key)


def factor_at(points: DataFrame, segments: DataFrame, key: str, day: str, name: str = "factor") -> DataFrame:
    """``points`` with the factor of the segment that contains the day, else of the nearest one (the earlier on a tie), else 1.

    A key's segments, which are few, travel as one array, so a point meets one row.
    """
    s = segments.groupBy(F.col(key).alias("_k")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "factor"))).alias("_segs"))

    def gap(x: Column) -> Column:
        return F.greatest(F.datediff(x["start"], F.col(day)), F.datediff(F.col(day), x["end"]), F.lit(0))

    near = F.array_min(F.transform("_segs", lambda x, i: F.struct(gap(x).alias("gap"), i.alias("i"), x["factor"].alias("factor"))))
    return points.join(s, F.col(key) == F.col("_k"), "left").select(*points.columns, F.coalesce(F.when(F.col(day).isNotNull(), near["factor"]), F.lit(1.0)).alias(name))
