"""Operators whose result for a row depends on earlier rows or earlier decisions."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def occurrence_ids(rows: DataFrame, fields: list[str], order: list[str], digits: int = 20, name: str = "record_id") -> DataFrame:
    """``rows`` with an id made of the hash of the fields and the number of equal rows before it (from 0).

    Nulls count as empty texts. The number is a position among equal rows only, so other rows never change an id. Equal rows
    are ordered by ``order``, which should be unique.
    """
    digest = F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]), 256), 1, digits)
    w = Window.partitionBy("_digest").orderBy(*order)
    return rows.withColumn("_digest", digest).withColumn(name, F.concat_ws(":", "_digest", (F.row_number().over(w) - 1).cast("string"))).drop("_digest")


def cooldown(events: DataFrame, key: str, day: str, days: int) -> DataFrame:
    """key, day: the days kept when a day is dropped that lies no more than ``days`` after the last KEPT one.

    A greedy choice, so no window function tells it; it is a fold over the sorted distinct days of a key. Their number is
    bounded by the calendar (some thousand), however many rows a key has. Null keys are one key, null days are left out.
    """
    d = events.where(F.col(day).isNotNull()).select(F.col(key).alias("_k"), F.col(day).cast("date").alias("_d")).distinct()
    lists = d.groupBy("_k").agg(F.array_sort(F.collect_list("_d")).alias("_all"))
    start = F.struct(F.array().cast("array<date>").alias("kept"), F.lit(None).cast("date").alias("last"))

    def step(acc: Column, x: Column) -> Column:
        take = acc["last"].isNull() | (F.datediff(x, acc["last"]) > days)
        return F.when(take, F.struct(F.concat(acc["kept"], F.array(x)).alias("kept"), x.alias("last"))).otherwise(acc)

    return lists.select(F.col("_k").alias(key), F.explode(F.aggregate("_all", start, step)["kept"]).alias(day))


def window_distinct(rows: DataFrame, key: str, who: str, day: str, days: int, least: int) -> DataFrame:
    """key, day, n: the anchor days with at least ``least`` distinct ``who`` in [day, day + days].

    Each distinct (key, who, day) covers the anchors of the ``days`` days before it; distinct (key, who, anchor) are counted.
    That is linear in the distinct days (days + 1 rows each), needs no frame of rows in memory and splits a hot key by anchor.
    Null keys, persons or days are left out.
    """
    r = rows.select(F.col(key).alias("k"), F.col(who).alias("p"), F.col(day).cast("date").alias("d")).dropna().distinct()
    anchors = r.select("k", F.col("d").alias("a")).distinct()
    cover = r.select("k", "p", F.explode(F.sequence(F.date_sub("d", days), F.col("d"))).alias("a")).distinct()
    n = cover.groupBy("k", "a").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return n.join(anchors, ["k", "a"], "left_semi").select(F.col("k").alias(key), F.col("a").alias(day), "n")


def find_window(rows: list[tuple], least: int, days: int) -> int | None:
    """The earliest anchor day (ordinal) with ``least`` distinct persons in [day, day + days]; rows (ordinal day, person) sorted.

    Anchors are tried from the last to the first. Of each person only the next day on or after the anchor matters; these days are
    kept in order, so that the ``least``-th of them tells whether a window is full.
    """
    coming: dict[str, int] = {}
    days_of: list[int] = []
    found = None
    for day, person in reversed(rows):
        if person in coming:
            del days_of[bisect_left(days_of, coming[person])]
        coming[person] = day
        insort(days_of, day)  # no other is earlier
        if len(days_of) >= least and days_of[least - 1] <= day + days:
            found = day
    return found


def episode_end(anchor: int, last: int, days: int, end: str) -> int:
    """The day from which the gap to the next episode counts: the ``last`` day acted on in the window, or the ``window``'s own end."""
    if end not in ("last", "window"):
        raise ValueError(f"end must be 'last' or 'window', got {end!r}")
    return last if end == "last" else anchor + days


def _detector(least: int, days: int, gap: int, lookback: int, end: str):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, seen, ended, at, waiting = None, [], None, None, []
        out: list[tuple] = []

        def decide() -> None:
            nonlocal seen, ended, waiting
            if not waiting:
                return
            now = at.toordinal()
            # rows before the next possible anchor are never needed again, so what stays has too few persons in every window
            low = now - lookback if ended is None else max(now - lookback, ended + gap)
            rows = seen = sorted(r for r in (*seen, *waiting) if r[0] >= low)
            waiting = []
            if len({p for _, p in rows}) < least:
                return
            a = find_window(rows, least, days)
            if a is None:
                return
            inside = [r for r in rows if a <= r[0] <= a + days]
            last = max(d for d, _ in inside)
            ended = episode_end(a, last, days, end)
            out.append((key, at, a, len({p for _, p in inside}), now - last))

        for pdf in batches:
            for k, t, d, p in zip(pdf["k"], pdf["t"], pdf["d"], pdf["p"], strict=True):
                if k != key:
                    decide()
                    key, seen, ended, at, waiting = k, [], None, t, []
                if t != at:
                    decide()
                    at = t
                waiting.append((d.toordinal(), p))
            if out:
                yield _episodes(out)
                out = []
        decide()
        if out:
            yield _episodes(out)

    return run


def _episodes(out: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(out, columns=["k", "as_of", "anchor", "n_persons", "staleness"])
    df["anchor"] = [pd.Timestamp.fromordinal(a).date() for a in df["anchor"]]
    return df


def detect_episodes(rows: DataFrame, key: str, who: str, day: str, visible: str, least: int = 3, days: int = 30, gap: int = 31, lookback: int = 365, end: str = "window") -> DataFrame:
    """key, as_of, anchor, n_persons, staleness: one row per episode of ``least`` persons acting within ``days`` days, at the
    instant when enough of them had become visible.

    Instants are processed in order of ``visible``; at each, the rows of the last ``lookback`` days that are visible then are
    searched for the earliest window; a new episode's anchor lies ``gap`` days or more after the end of the last episode. That
    end is the last day inside the found window (``end="last"``) or anchor + ``days`` (``end="window"``).
    Repeated (key, person, day) count from their first visibility. Rows stream through in order; kept are only those of one
    lookback that come after the last window and form none, which are fewer than ``least`` persons in any window. Keys with fewer
    than ``least`` persons in all are dropped before. Nulls in any of the four columns are left out.
    """
    r = rows.select(F.col(key).alias("k"), F.col(who).alias("p"), F.col(day).cast("date").alias("d"), F.col(visible).alias("t")).dropna()
    r = r.groupBy("k", "p", "d").agg(F.min("t").alias("t"))
    able = r.select("k", "p").distinct().groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("k")
    r = r.join(able, "k", "left_semi")
    tt = dict(r.dtypes)["t"]
    kt = dict(r.dtypes)["k"]
    got = r.repartition("k").sortWithinPartitions("k", "t", "d", "p").select("k", "t", "d", "p").mapInPandas(_detector(least, days, gap, lookback, end), f"k {kt}, as_of {tt}, anchor date, n_persons int, staleness int")
    return got.withColumnRenamed("k", key)


def replace_window(old: DataFrame, new: DataFrame, at: str, start: str, end: str, ids: list[str], order: str) -> DataFrame:
    """``old`` without its rows of [start, end) by ``at`` (null times stay), plus ``new``; of equal ``ids`` the last by
    (new before old, ``order``) is kept."""
    keep = old.where(F.col(at).isNull() | (F.col(at) < F.lit(start).cast("timestamp_ntz")) | (F.col(at) >= F.lit(end).cast("timestamp_ntz"))).withColumn("_rank", F.lit(0))
    both = keep.unionByName(new.withColumn("_rank", F.lit(1)))
    best = both.groupBy(*ids).agg(F.max(F.struct("_rank", order)).alias("_m"))
    win = best.select(*[F.col(i).alias(f"_{i}") for i in ids], F.col("_m._rank").alias("_mr"), F.col(f"_m.{order}").alias("_mo"))
    on = (F.col("_rank") == F.col("_mr")) & (F.col(order) == F.col("_mo"))
    for i in ids:
        on = on & F.col(i).eqNullSafe(F.col(f"_{i}"))
    return both.join(win, on, "left_semi").drop("_rank")


def factor_after(points: DataFrame, splits: DataFrame, key: str, day: str, ratio: str) -> DataFrame:
    """``points`` with ``factor``: the product of the key's ratios of days strictly after the point's day (1 without any).

    Ratios are first multiplied per (key, day); the suffix product is a window over those few rows, and the points find
    theirs by an as-of join, so points never meet splits in pairs.
    """
    from kronolit.operators.asof import asof_forward

    s = splits.where(F.col(ratio) > 0).groupBy(F.col(key).alias("_sk"), F.col(day).alias("_sd")).agg(F.product(ratio).alias("_r"))
    w = Window.partitionBy("_sk").orderBy(F.col("_sd").desc()).rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_f", F.product("_r").over(w)).withColumnRenamed("_sk", key)
    out = asof_forward(points, s, key=key, left_on=day, right_on="_sd", values=["_f"], strict=True)
    return out.select(*points.columns, F.coalesce("_f", F.lit(1.0)).alias("factor"))
