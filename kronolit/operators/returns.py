"""Returns around events on the calendar of a benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kronolit.operators.asof import asof_backward, asof_forward
from kronolit.operators.intervals import bucketed_interval_join
from kronolit.operators.sequence import factor_after


def sessions(bench: DataFrame, day: str = "day", close: str = "close") -> DataFrame:
    """n (from 0), day, bench: the sessions of the calendar. One benchmark's days, so the numbering is of bounded size."""
    d = bench.where(F.col(day).isNotNull() & (F.col(close) > 0)).groupBy(F.col(day).cast("date").alias("day")).agg(F.max(close).alias("bench"))
    return d.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("day")) - 1).alias("n"), "day", "bench")


def day_sessions(cal: DataFrame) -> DataFrame:
    """d, n: every calendar day from the first session to the last with the last session on or before it; one row a day."""
    to = F.coalesce(F.date_sub(F.lead("day").over(Window.partitionBy(F.lit(0)).orderBy("day")), 1), F.col("day"))
    return cal.select("n", "day", to.alias("_to")).select("n", F.explode(F.sequence("day", "_to")).alias("d"))


def _bars_at(asked: DataFrame, bars: DataFrame, session: str, first: bool, stale: int, names: tuple[str, str]) -> DataFrame:
    """key, session, close and session (``names``) of the first bar from the session on, or the last up to it, no more than ``stale``
    sessions away. The distinct sessions that are asked for are exploded, not the bars."""
    n = F.col(session)
    reach = F.sequence(n, n + stale) if first else F.sequence(n - stale, n)
    q = asked.select("key", session).dropna().distinct().select("key", session, F.explode(reach).alias("at"))
    hit = q.join(bars, ["key", "at"]).groupBy("key", session).agg((F.min if first else F.max)(F.struct("at", "c")).alias("b"))
    return hit.select("key", session, F.col("b.c").alias(names[0]), F.col("b.at").alias(names[1]))


def event_returns(events: DataFrame, bars: DataFrame, bench: DataFrame, *, event_id: str, key: str, event_day: str, day: str, close: str, bench_day: str = "day", bench_close: str = "close", horizons: tuple[int, ...] = (1, 3, 6), stale: int = 1, artefact: float = 5.0) -> DataFrame:
    """event_id, horizon, status, stock, market, excess: the return of the event's key from the first bar after its day.

    The calendar is the benchmark's. i0 is the first session after the event day, entry the first bar from i0 on, exit the last
    bar up to i0 + horizon (a late entry does not move the exit). Status, in this order: TOO_RECENT (the calendar ends before
    i0 + horizon), NO_HISTORY (no bar of the key at all), NO_ENTRY_BAR (entry more than ``stale`` sessions late),
    ENDED_IN_WINDOW (exit more than ``stale`` sessions early or before entry), ARTEFACT (return beyond ``artefact``), OK. The
    market goes from the entry bar's session to the exit session. Null keys or days have NO_HISTORY or TOO_RECENT.
    """
    cal = sessions(bench, bench_day, bench_close)
    days = day_sessions(cal)
    e = events.select(F.col(event_id).alias("event_id"), F.col(key).alias("key"), F.col(event_day).cast("date").alias("d"))
    e = e.join(F.broadcast(days), "d", "left")  # the calendar: one row a day
    before = F.col("d") < cal.agg(F.min("day")).scalar()
    e = e.withColumn("i0", F.coalesce(F.col("n") + 1, F.when(before, 0))).drop("n")
    e = e.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("i1", F.col("i0") + F.col("horizon"))
    b = bars.where(F.col(close) > 0).groupBy(F.col(key).alias("key"), F.col(day).cast("date").alias("day")).agg(F.max(close).alias("c")).join(F.broadcast(cal.select("n", "day")), "day").select("key", F.col("n").alias("at"), "c")
    known = bars.where(F.col(close) > 0).select(F.col(key).alias("key")).distinct().withColumn("_known", F.lit(True))
    e = e.join(_bars_at(e, b, "i0", True, stale, ("c0", "n0")), ["key", "i0"], "left").join(_bars_at(e, b, "i1", False, stale, ("c1", "n1")), ["key", "i1"], "left").join(known, "key", "left")
    last = cal.agg(F.max("n")).scalar()
    small = F.broadcast(cal.select("n", "bench"))  # one row a session
    e = e.join(small.withColumnsRenamed({"n": "_n0", "bench": "b0"}), F.col("n0") == F.col("_n0"), "left").join(small.withColumnsRenamed({"n": "_n1", "bench": "b1"}), F.col("i1") == F.col("_n1"), "left")
    r, m = F.col("c1") / F.col("c0") - 1, F.col("b1") / F.col("b0") - 1
    status = (
        F.when(F.col("i0").isNull() | last.isNull() | (F.col("i1") > last), "TOO_RECENT").when(F.col("_known").isNull(), "NO_HISTORY").when(F.col("c0").isNull(), "NO_ENTRY_BAR")
        .when(F.col("c1").isNull() | (F.col("n1") <= F.col("n0")), "ENDED_IN_WINDOW").when(F.abs(r) > artefact, "ARTEFACT").otherwise("OK")
    )
    e = e.withColumn("status", status)
    ok = F.col("status") == "OK"
    return e.select("event_id", "horizon", "status", F.when(ok, r).alias("stock"), F.when(ok, m).alias("market"), F.when(ok, r - m).alias("excess"))


def period_returns(bars: DataFrame, key: str, day: str, close: str) -> DataFrame:
    """key, month, ret: change of the last close of each month against that of the month before it that has one."""
    m = bars.where(F.col(close) > 0).groupBy(F.col(key).alias("key"), F.trunc(F.col(day).cast("date"), "MM").alias("month")).agg(F.max(F.struct(F.col(day).alias("d"), F.col(close).alias("c")))["c"].alias("c"))
    prev = F.lag("c").over(Window.partitionBy("key").orderBy("month"))
    return m.select("key", "month", (F.col("c") / prev - 1).alias("ret"))


def shifted_events(events: DataFrame, bench: DataFrame, event_day: str, by: int, day: str = "day", close: str = "close") -> DataFrame:
    """``events`` moved ``by`` sessions (negative: earlier) along the benchmark's calendar, from the last session on or before their day; events that
    leave the calendar are left out. The calendar has one row a session and is broadcast."""
    cal = sessions(bench, day, close)
    moved = day_sessions(cal).join(cal.select((F.col("n") - by).alias("n"), F.col("day").alias("_moved")), "n").select(F.col("d").alias("_d"), "_moved")
    # the calendar's last session stands for all later days
    end = cal.agg(F.max("day")).scalar()
    on = F.least(F.col(event_day).cast("date"), end)
    return events.where(F.col(event_day).isNotNull()).join(F.broadcast(moved), on == F.col("_d")).withColumn(event_day, F.col("_moved")).drop("_d", "_moved")


def own_bar_returns(events: DataFrame, bars: DataFrame, *, event_id: str, key: str, event_day: str, day: str, close: str, horizons: tuple[int, ...]) -> DataFrame:
    """event_id, horizon, entry_day, exit_day, ret: from the key's first bar after the event's day to the bar ``horizon`` bars later, on
    the key's own calendar. Events without an entry or an exit bar do not come out."""
    b = bars.where((F.col(close) > 0) & F.col(key).isNotNull() & F.col(day).isNotNull()).groupBy(F.col(key).alias("key"), F.col(day).cast("date").alias("day")).agg(F.max(close).alias("c"))
    b = b.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("day")))
    e = events.select(F.col(event_id).alias("event_id"), F.col(key).alias("key"), F.col(event_day).cast("date").alias("d"))
    e = asof_forward(e, b, key="key", left_on="d", right_on="day", values=["k", "c"], strict=True).where("k is not null")
    e = e.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("k", F.col("k") + F.col("horizon"))
    out = e.join(b.select("key", "k", F.col("c").alias("c1"), F.col("day").alias("exit_day")), ["key", "k"])
    return out.select("event_id", "horizon", F.col("day_matched").alias("entry_day"), "exit_day", (F.col("c1") / F.col("c") - 1).alias("ret"))


def _inside(windows: DataFrame, bars: DataFrame, key: str) -> DataFrame:
    """Every bar (key, day, c) with the windows (wid, key, entry, end) that hold it; the last day is inside."""
    iv = windows.select(F.col(key), "wid", F.col("entry").alias("_a"), F.date_add("end", 1).alias("_b"))
    return bucketed_interval_join(bars, iv, key, "day", "_a", "_b", width=64)


def largest_moves(windows: DataFrame, bars: DataFrame) -> DataFrame:
    """wid, move: the largest absolute change from one bar to the key's next, both inside the window; 0 with a single bar. ``windows``:
    wid, key, entry, end (last day); ``bars``: key, day, c (one a day)."""
    before = Window.partitionBy("key").orderBy("day")
    b = bars.withColumns({"_was": F.lag("c").over(before), "_on": F.lag("day").over(before)})
    return _inside(windows, b, "key").groupBy("wid").agg(F.coalesce(F.max(F.when(F.col("_on") >= F.col("_a"), F.abs(F.col("c") / F.col("_was") - 1))), F.lit(0.0)).alias("move"))


def _month_changes(windows: DataFrame, bars: DataFrame) -> DataFrame:
    """wid, month, ret: change of the last bar of each month of a window against that of the month before, first against the first bar."""
    m = _inside(windows, bars, "key").groupBy("wid", F.trunc("day", "MM").alias("month")).agg(F.max(F.struct("day", "c"))["c"].alias("c"), F.min(F.struct("day", "c"))["c"].alias("c0"))
    w = Window.partitionBy("wid").orderBy("month")
    return m.select("wid", "month", (F.col("c") / F.coalesce(F.lag("c").over(w), F.col("c0")) - 1).alias("ret"))


def monthly_excess(windows: DataFrame, bars: DataFrame, bench: DataFrame) -> DataFrame:
    """wid, month, excess: monthly returns between a window's first and last day less those of the benchmark over the same days; months
    that one of the two lacks are left out. ``bench``: day, c."""
    one = windows.withColumn("key", F.lit("bench"))
    market = _month_changes(one, bench.withColumn("key", F.lit("bench"))).withColumnRenamed("ret", "market")
    return _month_changes(windows, bars).join(market, ["wid", "month"]).select("wid", "month", (F.col("ret") - F.col("market")).alias("excess"))


def aligned_months(a: DataFrame, b: DataFrame) -> DataFrame:
    """month, a, b: two monthly series (month, ret) side by side, months of either kept."""
    return a.select("month", F.col("ret").alias("a")).join(b.select("month", F.col("ret").alias("b")), "month", "full")


def market_caps(days: DataFrame, prices: DataFrame, shares: DataFrame, splits: DataFrame, *, key: str, lag: int, stale: int = 10) -> DataFrame:
    """``days`` (key, day) with cap, shares, shares_date, price, reason: price of the last ten days times the share count that had been
    public for ``lag`` days, carried over the splits since. ``prices``: key, day, price; ``shares``: key, day, shares; ``splits``:
    key, day, ratio. Reasons: NO_PRICE_AT_DATE, SHARES_NOT_YET_PUBLIC, NON_POSITIVE, OK."""
    d = asof_backward(days, prices.withColumnRenamed("day", "_pd"), key=key, left_on="day", right_on="_pd", values=["price"], max_age=stale).drop("_pd_matched")
    d = asof_backward(d, shares.withColumnsRenamed({"day": "_sd", "shares": "_obs"}), key=key, left_on="day", right_on="_sd", values=["_obs"], lag=lag).withColumnRenamed("_sd_matched", "shares_date")
    later = factor_after(d.withColumn("_at", F.col("shares_date")), splits.withColumnRenamed("day", "_at"), key, "_at", "ratio").withColumnRenamed("factor", "_since")
    d = factor_after(later, splits, key, "day", "ratio").withColumn("shares", F.col("_obs") * F.col("_since") / F.col("factor"))
    ok = F.when(F.col("price").isNull(), "NO_PRICE_AT_DATE").when(F.col("_obs").isNull(), "SHARES_NOT_YET_PUBLIC").when(~(F.col("shares") > 0), "NON_POSITIVE").otherwise("OK")
    d = d.withColumn("reason", ok)
    return d.select(*days.columns, F.when(F.col("reason") == "OK", F.col("shares") * F.col("price")).alias("cap"), "shares", "shares_date", "price", "reason")
