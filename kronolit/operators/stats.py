"""Statistics of effects by cell: iid, one- and two-way clustered t values, calendar time, minimal detectable effect, bootstrap."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: quantile of a two-sided test at 5 % plus that of 80 % power.
POWER = 1.959964 + 0.841621


def _clean(df: DataFrame, cell: str, value: str, *more: str) -> DataFrame:
    return df.select(F.col(cell).alias("cell"), F.col(value).cast("double").alias("x"), *[F.col(m).alias(n) for m, n in zip(more, ("g1", "g2"), strict=False)]).where(F.col("x").isNotNull() & ~F.isnan("x"))


def _t(mean: Column, variance: Column) -> Column:
    return F.when(variance > 0, mean / F.sqrt(variance))


def t_iid(df: DataFrame, cell: str, value: str) -> DataFrame:
    """cell, n, mean, sd, t, mde: mean over its standard error; null t with fewer than two values or no spread."""
    g = _clean(df, cell, value).groupBy("cell").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    enough = (F.col("n") >= 2) & (F.col("sd") > 1e-12)
    return g.select("cell", "n", "mean", F.when(F.col("n") >= 2, F.col("sd")).alias("sd"), F.when(enough, F.col("mean") / (F.col("sd") / F.sqrt("n"))).alias("t"), F.when(enough, F.lit(POWER) * F.col("sd") / F.sqrt("n")).alias("mde"))


def _sums(x: DataFrame, *by: str) -> DataFrame:
    """cell, the clusters, s and k: sum and number of values of each combination; every clustering adds these up further."""
    return x.groupBy("cell", *by).agg(F.sum("x").alias("s"), F.count("*").alias("k"))


def _cluster_variance(x: DataFrame, by: list[str], name: str) -> DataFrame:
    """cell, groups, variance of the mean with errors clustered by ``by``: G/(G-1) * sum of squared group sums of errors / n^2.

    The group sum of errors is sum(x) - n_g * mean, so one pass of partial sums per group suffices and no row is joined to its
    mean.
    """
    g = x.groupBy("cell", *by).agg(F.sum("s").alias("s"), F.sum("k").alias("k"))
    t = g.groupBy("cell").agg(F.count("*").alias("gr"), F.sum("k").alias("n"), (F.sum("s") / F.sum("k")).alias("m"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("s") * F.col("k")).alias("sk"), F.sum(F.col("k") * F.col("k")).alias("kk"))
    v = (F.col("ss") - 2 * F.col("m") * F.col("sk") + F.col("m") * F.col("m") * F.col("kk")) / (F.col("n") * F.col("n"))
    return t.select("cell", F.col("gr").alias(f"{name}_groups"), F.when(F.col("gr") > 1, v * F.col("gr") / (F.col("gr") - 1)).alias(f"{name}_var"), F.col("n").alias(f"{name}_n"), F.col("m").alias(f"{name}_mean"))


def t_clustered(df: DataFrame, cell: str, value: str, cluster: str, least: int = 10) -> DataFrame:
    """cell, n, groups, mean, t: errors clustered one way; null t with fewer than ``least`` groups or no variance."""
    v = _cluster_variance(_sums(_clean(df, cell, value, cluster), "g1"), ["g1"], "c")
    return v.select("cell", F.col("c_n").alias("n"), F.col("c_groups").alias("groups"), F.col("c_mean").alias("mean"), F.when(F.col("c_groups") >= least, _t(F.col("c_mean"), F.when(F.col("c_var") > 1e-18, F.col("c_var")))).alias("t"))


def t_two_way(df: DataFrame, cell: str, value: str, first: str, second: str, least: int = 10) -> DataFrame:
    """cell, n, mean, t: variance by the first clustering plus the second minus their intersection."""
    x = _sums(_clean(df, cell, value, first, second), "g1", "g2")
    a, b, ab = _cluster_variance(x, ["g1"], "a"), _cluster_variance(x, ["g2"], "b"), _cluster_variance(x, ["g1", "g2"], "i")
    j = a.join(b, "cell").join(ab, "cell")
    v = F.col("a_var") + F.col("b_var") - F.col("i_var")
    ok = (F.col("a_groups") >= least) & (F.col("b_groups") >= least)
    return j.select("cell", F.col("a_n").alias("n"), F.col("a_mean").alias("mean"), F.when(ok, _t(F.col("a_mean"), F.when(v > 1e-18, v))).alias("t"))


def calendar_time(df: DataFrame, cell: str, value: str, period: str) -> DataFrame:
    """cell, n (periods), mean, sd, t, mde of the series of period means."""
    m = _clean(df, cell, value, period).groupBy("cell", "g1").agg(F.avg("x").alias("x"))
    return t_iid(m, "cell", "x")


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number (multiply, shift, exclusive or), by which draws are told apart without a generator a row."""
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x


def bootstrap_interval(df: DataFrame, cell: str, value: str, order: str, draws: int = 1000, level: float = 0.95, seed: int = 7, rows: int = 256) -> DataFrame:
    """cell, low, high: percentile interval of the mean, by a Poisson bootstrap: every row enters each draw with its own Poisson
    weight, a function of (seed, order, draw), so that any split of the rows gives the same draws and only draws x 2 sums a
    cell are moved. Weights are made for ``rows`` rows and all draws at once."""
    x = df.select(F.col(cell).alias("cell"), F.col(value).cast("double").alias("x"), F.xxhash64(F.col(order), F.lit(seed)).alias("h")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    upto = np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(19)])

    def partial(batches):  # noqa: ANN001, ANN202
        steps = _mix(np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for pdf in batches:
            for c, part in pdf.groupby("cell", dropna=False):
                s, w = np.zeros(draws), np.zeros(draws)
                for i in range(0, len(part), rows):
                    p = part.iloc[i : i + rows]
                    even = _mix(p["h"].to_numpy().view(np.uint64)[:, None] ^ steps) >> np.uint64(11)
                    k = np.searchsorted(upto, even * 2.0**-53, side="right")
                    s += p["x"].to_numpy() @ k
                    w += k.sum(axis=0)
                yield pd.DataFrame({"cell": c, "draw": np.arange(draws), "s": s, "w": w})

    kind = dict(x.dtypes)["cell"]
    sums = x.mapInPandas(partial, f"cell {kind}, draw int, s double, w double").groupBy("cell", "draw").agg(F.try_divide(F.sum("s"), F.sum("w")).alias("m"))
    tail = (1 - level) / 2
    return sums.groupBy("cell").agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))
