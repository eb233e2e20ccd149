"""Quantities recorded in different units (problem 1)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kronolit.functions.units import UNITS, is_share, mcap_unit, note_unit, price_unit, stated_number
from kronolit.operators.intervals import bucketed_interval_join

#: Segmentation of log ratios: spread of a true ratio, most that one point can cost, penalty of a changepoint, cost of assuming a unit that nobody stated.
SIGMA, CAP, PENALTY, UNSTATED = 0.08, 25.0, 6.0, {"SEK": 0.0, "ORE": 1.0, "TSEK": 1.0, "MSEK": 1.0, "BSEK": 1.0, "MEUR": 1.5, "MUSD": 1.5, "EUR": 6.0, "USD": 6.0, "GBP": 6.0, "GBX": 6.0, "CHF": 6.0, "DKK": 8.0}
#: Cost of what is impossible.
FAR = 1e9


def point_costs(y: np.ndarray, levels: np.ndarray, prior: np.ndarray, sigma: float = SIGMA, cap: float = CAP, wide: float | None = None) -> np.ndarray:
    """n x m: what each level costs each point: its misfit (at most ``cap``) and its prior. Column 0 is the level that a history
    starts from and the only one that a point may have which fits none."""
    off = (y[:, None] - levels) ** 2 / 2
    misfit = off / sigma**2 if wide is None else np.minimum(off / sigma**2, cap / 2 + off / wide**2)
    misfit[:, 1:][misfit[:, 1:] >= cap] = FAR
    return np.minimum(misfit, np.where(np.arange(levels.shape[1]) == 0, cap, FAR)) + prior


def sure_points(cost: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Points that every best segmentation leaves on level 0: it saves two changepoints there against every other level."""
    rest = cost[:, 1:].min(axis=1) if cost.shape[1] > 1 else np.full(len(cost), np.inf)
    return (cost.argmin(axis=1) == 0) & (rest - cost[:, 0] >= 2 * penalty)


class Trail:
    """The recursion of the changepoint search over the undecided points of a history, from a known level before them.

    ``step`` adds a point, ``settle`` decides all held points given the level after them. Of a very long undecided stretch
    ``prefix`` decides the points on which the best paths to all levels agree, so what is held does not grow with it.
    """

    def __init__(self, level: int, m: int, penalty: float) -> None:
        self.m, self.penalty = m, penalty
        self.restart(level)

    def restart(self, level: int) -> None:
        self.cost, self.back = np.full(self.m, FAR * 1e6), []
        self.cost[level] = 0.0

    def step(self, cost: np.ndarray) -> None:
        j = int(self.cost.argmin())
        jump = self.cost[j] + self.penalty
        stay = self.cost <= jump
        self.back.append(np.where(stay, np.arange(self.m), j).astype(np.int16))
        self.cost = np.where(stay, self.cost, jump) + cost

    def _walk(self, s: int, upto: int) -> list[int]:
        out = []
        for i in range(upto, -1, -1):
            out.append(s)
            s = int(self.back[i][s])
        return out[::-1]

    def settle(self, level: int | None, after: bool) -> list[int]:
        """Levels of the held points: with the last of them on ``level``, or (``after``) with level 0 on the point that follows."""
        if not self.back:
            return []
        c = self.cost
        if after:
            c = c + self.penalty
            c[0] -= self.penalty
        out = self._walk(int(c.argmin()) if level is None else level, len(self.back) - 1)
        self.back = []
        return out

    def prefix(self) -> list[int]:
        s = np.arange(self.m)
        for i in range(len(self.back) - 1, 0, -1):
            s = self.back[i][s]
            if (s == s[0]).all():
                out = self._walk(int(s[0]), i - 1)
                self.back = self.back[i:]
                return out
        return []


def segment_levels(y: np.ndarray, levels: np.ndarray, prior: np.ndarray, block: np.ndarray, sigma: float = SIGMA, cap: float = CAP, penalty: float = PENALTY, wide: float | None = None) -> np.ndarray:
    """Exact penalised changepoint search with segment levels from a known set, in memory.

    ``y``: n log ratios in order; ``levels``: n x m, the log level of each known factor at each point; ``prior``: n x m, what
    a factor costs a point beyond its misfit; ``block``: history of each point. Returns the index of the level of each point
    under the segmentation of least total cost: misfit (at most ``cap`` a point) + prior + ``penalty`` a changepoint.
    The recursion is exact over all segmentations (every level at every point, O(n m)); histories are independent.
    """
    n, m = levels.shape
    cost = point_costs(y, levels, prior, sigma, cap, wide)
    sure, out, trail, held = sure_points(cost, penalty), np.zeros(n, dtype=np.int64), Trail(0, m, penalty), []
    for i in range(n):
        if i and block[i] != block[i - 1]:
            out[held] = trail.settle(None, False)
            held = []
            trail.restart(0)
        if sure[i]:
            out[held] = trail.settle(None, True)
            held = []
            trail.restart(0)
        else:
            trail.step(cost[i])
            held.append(i)
    out[held] = trail.settle(None, False)
    return out


def _costed(units: list[str], sigma: float, wide: float | None, penalty: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows with y (log of value over reference, null: the word stands), stated, firm and fx_*: unit and sek as stated, whether that is
    ``sure``, and for a row where it is not the ``cost`` and ``worth`` of each level: the unit as stated, then all units.

    A value in unit u is worth value x factor(u), so its misfit is the square of y + log factor(u), whatever was stated. A unit
    without a rate of the day is impossible; where the stated one has none, the word stands."""
    scale, money = np.array([UNITS[u][0] for u in units]), [UNITS[u][1] for u in units]
    fee, place = np.array([0.0, *(UNSTATED.get(u, FAR) for u in units)]), {u: i for i, u in enumerate(units)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = len(pdf)
            factor = np.ones((n, len(units))) * scale
            for i, c in enumerate(money):
                if c:
                    factor[:, i] *= pdf[f"fx_{c}"].to_numpy(dtype=float)
            s = pdf["stated"].map(place).to_numpy(dtype=np.int64)
            factor = np.concatenate((factor[np.arange(n), s][:, None], factor), axis=1)
            worth = pdf["value"].to_numpy(dtype=float)[:, None] * factor
            level = np.log(factor)
            y = pdf["y"].to_numpy(dtype=float)
            known = np.isfinite(y + level[:, 0])
            prior = fee + np.where(pdf["firm"].to_numpy(dtype=bool), 6.0, 0.0)[:, None] * (np.arange(len(fee)) > 0)
            prior[np.arange(n), s + 1] = FAR
            cost = point_costs(np.where(known, y, 0.0), -np.where(np.isfinite(level), level, 1e6), prior, sigma, CAP, wide)
            sure = sure_points(cost, penalty) | ~known
            spread = (pdf["id"] % 4096).astype(str)  # rows without a history go anywhere
            some = pdf[["kind", "id", "value", "day"]].assign(unit=pdf["stated"], sek=worth[:, 0], hist=pdf["hist"].where(known, None), part=pdf["part"].where(known, spread), known=known, sure=sure, cost=None, worth=None)
            at = np.flatnonzero(~sure)
            for name, x in (("cost", cost), ("worth", worth)):
                column = np.empty(n, dtype=object)
                column[at] = list(x[at])
                some[name] = column
            some["sek"] = some["sek"].astype("Float64").mask(np.isnan(factor[:, 0]), pd.NA)
            yield some

    return run


def _runs(pdf: pd.DataFrame) -> Iterator[tuple[tuple, int, int]]:
    """(history, part), first and last row + 1 of each run of equal ones."""
    h, p = pdf["hist"].to_numpy(), pdf["part"].to_numpy()
    cut = np.flatnonzero((h[1:] != h[:-1]) | (p[1:] != p[:-1])) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(pdf)], strict=True):
        yield (h[a], p[a]), a, b


def _summaries(m: int, penalty: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """hist, part, head, tail of each part of a history: the cost of getting through it. ``head`` is the cost from each level before
    the part to its first sure point, ``tail`` that from its last sure point to each level at its end. A part without a sure point
    has its whole matrix as ``head`` (from level x to level, row by row) and no ``tail``.

    Rows are the undecided points (cost) and the first of a part if it is sure (cost null); ``cut`` and ``stop`` say whether the
    point right before and right after one is sure."""
    start = np.where(np.eye(m, dtype=bool), 0.0, FAR * 1e6)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, full, head, tail = None, start, None, None

        def close() -> list[tuple]:
            return [] if key is None else [(*key, full.ravel() if head is None else head, tail)]

        for pdf in batches:
            if not len(pdf):
                continue
            out = []
            cost, cut, stop = pdf["cost"].to_numpy(), pdf["cut"].to_numpy(dtype=bool), pdf["stop"].to_numpy(dtype=bool)
            for k, a, b in _runs(pdf):
                if k != key:
                    out += close()
                    key, full, head, tail = k, start, None, None
                for i in range(a, b):
                    sure = cost[i] is None
                    if sure or cut[i]:
                        head = np.minimum(full[:, 0], full.min(axis=1) + penalty) if head is None else head
                        tail = start[0]
                    if not sure:
                        if tail is None:
                            full = np.minimum(full, full.min(axis=1, keepdims=True) + penalty) + cost[i]
                        else:
                            tail = np.minimum(tail, tail.min() + penalty) + cost[i]
                    if stop[i]:
                        head = np.minimum(full[:, 0], full.min(axis=1) + penalty) if head is None else head
                        tail = start[0]
            if out:
                yield pd.DataFrame(out, columns=["hist", "part", "head", "tail"])
        yield pd.DataFrame(close(), columns=["hist", "part", "head", "tail"])

    return run


def _chain(m: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """hist, part, first, last: the level before each part and at its end on the best path through the whole history. Parts come in
    order; a part with a sure point settles all before it, so what is held are the parts since the last one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, cost, held, out = None, None, [], []

        def settle(s: int) -> None:
            for part, back in reversed(held):
                before = int(back[s])
                out.append((key, part, before, s))
                s = before
            held.clear()

        for pdf in batches:
            for h, part, head, tail in zip(pdf["hist"], pdf["part"], pdf["head"], pdf["tail"], strict=True):
                if h != key:
                    if held:
                        settle(int(cost.argmin()))
                    key, cost = h, np.where(np.arange(m) == 0, 0.0, FAR * 1e6)
                if tail is None:
                    through = cost[:, None] + np.asarray(head).reshape(m, m)
                    held.append((part, through.argmin(axis=0)))
                    cost = through.min(axis=0)
                else:
                    s = int((cost + head).argmin())
                    settle(s)
                    held.append((part, np.full(m, s)))
                    cost = np.asarray(tail) + (cost[s] + head[s])
            if out:
                yield pd.DataFrame(out, columns=["hist", "part", "first", "last"])
                out = []
        if held:
            settle(int(cost.argmin()))
        yield pd.DataFrame(out, columns=["hist", "part", "first", "last"])

    return run


def _deciding(units: list[str], penalty: float, hold: int = 50_000) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Points of the parts in order, each with the levels before (``first``) and at the end (``last``) of its part: kind, id, value,
    day, unit, sek. Those without ``cost`` keep what is stated."""

    def chosen(rows: pd.DataFrame, levels: list[int]) -> pd.DataFrame:
        unit = [units[s - 1] if s else u for u, s in zip(rows["unit"], levels, strict=True)]
        sek = pd.Series([w[s] for w, s in zip(rows["worth"], levels, strict=True)], index=rows.index, dtype=float)
        return rows[["kind", "id", "value", "day"]].assign(unit=unit, sek=sek)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, end, trail, held = None, 0, Trail(0, len(units) + 1, penalty), []

        def give(levels: list[int]) -> Iterator[pd.DataFrame]:
            """The first held points with their levels; the others stay."""
            if levels:
                rows = held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held[:] = [rows.iloc[len(levels) :]] if len(levels) < len(rows) else []
                yield chosen(rows.iloc[: len(levels)], levels)

        for pdf in batches:
            open_ = pdf["cost"].notna()
            yield pdf.loc[~open_, ["kind", "id", "value", "day", "unit", "sek"]]
            pdf = pdf[open_]
            if not len(pdf):
                continue
            cost, cut = pdf["cost"].to_numpy(), pdf["cut"].to_numpy(dtype=bool)
            first, last, stop = pdf["first"].to_numpy(), pdf["last"].to_numpy(), pdf["stop"].to_numpy(dtype=bool)
            levels: list[int] = []  # of the rows of this batch so far, after those that were held
            for k, a, b in _runs(pdf):
                if k != key:
                    levels += trail.settle(end, False)
                    key, end = k, int(last[a])
                    trail.restart(int(first[a]))
                for i in range(a, b):
                    if cut[i]:
                        levels += trail.settle(None, True)
                        trail.restart(0)
                    trail.step(cost[i])
                    if stop[i]:
                        levels += trail.settle(None, True)
                        trail.restart(0)
            if len(trail.back) > hold:
                levels += trail.prefix()
            held.append(pdf)
            yield from give(levels)
        yield from give(trail.settle(end, False))

    return run


def daily_rates(fx: DataFrame, until: dt.date) -> DataFrame:
    """One row a calendar day up to ``until`` with a map of currency to the last rate on or before it, however old.

    Size: days x currencies of the rate table, which the test data fix; of repeated rows of a day the greatest rate counts.
    """
    f = fx.where(F.col("rate").isNotNull() & (F.col("rate") > 0) & F.col("currency").isNotNull() & F.col("fx_date").isNotNull()).groupBy("currency", "fx_date").agg(F.max("rate").alias("rate"))
    nxt = F.lead("fx_date").over(Window.partitionBy("currency").orderBy("fx_date"))
    f = f.withColumn("to", F.coalesce(F.date_sub(nxt, 1), F.greatest("fx_date", F.lit(until))))
    return f.select("currency", "rate", F.explode(F.sequence("fx_date", "to")).alias("fx_day")).groupBy("fx_day").agg(F.map_from_entries(F.collect_list(F.struct("currency", "rate"))).alias("rates"))


def with_rates(df: DataFrame, day: str, fx: DataFrame, currencies: list[str], bound: int = 200_000) -> DataFrame:
    """``df`` with fx_<currency>, the last rate on or before ``day``; days after the table's last one have that day's.

    The daily table is broadcast only while it has at most ``bound`` days.
    """
    first, last = fx.select(F.min("fx_date"), F.max("fx_date")).first()
    last = last or dt.date(1970, 1, 1)
    r = daily_rates(fx, last).select("fx_day", *[F.col("rates")[c].alias(f"fx_{c}") for c in currencies])
    few = first is None or (last - first).days <= bound
    return df.join(F.broadcast(r) if few else r, F.when(df[day].isNotNull(), F.least(df[day], F.lit(last))) == r["fx_day"], "left").drop("fx_day")


CURRENCIES = ["EUR", "USD", "NOK", "DKK", "GBP", "CHF"]
PRICE_UNITS = ["SEK", "ORE", "TSEK", "EUR", "USD", "NOK", "DKK", "GBP", "GBX", "CHF"]
MCAP_UNITS = ["SEK", "TSEK", "MSEK", "BSEK", "MEUR", "MUSD"]


def reference_prices(points: DataFrame) -> DataFrame:
    """issuer_key, ref_price, rf, rt: SEK a share, each day's from the nearest point of the issuer (the earlier on a tie), however far."""
    p = points.where(F.col("issuer_key").isNotNull() & F.col("as_of_day").isNotNull() & (F.col("price_used") > 0) & ~F.isnan("price_used")).groupBy("issuer_key", "as_of_day").agg(F.max("price_used").alias("ref_price"))
    w = Window.partitionBy("issuer_key").orderBy("as_of_day")
    half = lambda a, b: F.date_add(a, (F.floor(F.datediff(b, a) / 2) + 1).cast("int"))
    p = p.withColumn("rf", half(F.lag("as_of_day").over(w), F.col("as_of_day"))).withColumn("rt", half(F.col("as_of_day"), F.lead("as_of_day").over(w)))
    return p.select("issuer_key", "ref_price", F.coalesce("rf", F.lit("0001-01-01").cast("date")).alias("rf"), "rt")


def price_units(txns: DataFrame, points: DataFrame, fx: DataFrame) -> DataFrame:
    """kind, id, value, day, unit, sek: every non-null price, the unit it is in and its worth in SEK at the rate of its day.

    The day is trade_date, else the day of published_at. The unit is what a note says of the present price, else what currency
    names, else SEK. A share's price is further held against the issuer's price_used: the log ratios of a history (issuer and
    source, all its days) are segmented and a level shift by a known factor reverses the unit. Without a reference the word
    stands. A zero, negative or NaN price keeps its stated unit. The last rate on or before the day counts, however old; days
    before the first rate give a null sek. Extra columns are ignored.
    """
    t = txns.where(F.col("price").isNotNull()).select(
        F.lit("price").alias("kind"), F.col("row_id").alias("id"), "issuer_key", "source", F.col("price").alias("value"),
        F.coalesce(F.col("trade_date").cast("date"), F.col("published_at").cast("date")).alias("day"),
        note_unit(F.col("amendment_note")).alias("noted"), price_unit(F.col("currency")).alias("named"), is_share(F.col("instrument_name"), F.col("instrument_type_raw")).alias("share"),
    )
    t = t.withColumn("stated", F.coalesce("noted", "named", F.lit("SEK"))).withColumn("firm", F.coalesce(F.col("noted").isNotNull() | (F.col("named") != "SEK"), F.lit(False))).drop("noted", "named")
    t = bucketed_interval_join(t, reference_prices(points), "issuer_key", "day", "rf", "rt", how="left")
    return _judged(t.withColumn("ref", F.when(F.col("share"), F.col("ref_price"))), fx, PRICE_UNITS, SIGMA, None)


def mcap_units(points: DataFrame, fx: DataFrame) -> DataFrame:
    """kind, id, value, day, unit, sek: every non-null mcap_sek, the unit it is in and its worth in SEK at the rate of as_of_day.

    A unit field stands unless the text speaks of another scale. Otherwise the text's own number tells whether the value
    repeats it or is it in SEK, and the history of log ratios to price_used x shares (issuer and price_source) decides. Missing shares are taken from
    the issuer's nearest earlier point, else its nearest later one.
    """
    # points without an issuer stand alone; the second window runs backwards, so that its frame grows from row to row
    whose = F.coalesce("issuer_key", F.concat(F.lit("\x00"), F.col("point_id").cast("string")))
    up = Window.partitionBy(whose).orderBy(F.asc("as_of_day"), F.asc("point_id")).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(whose).orderBy(F.desc("as_of_day"), F.desc("point_id")).rowsBetween(Window.unboundedPreceding, 0)
    shares = F.when((F.col("shares") > 0) & ~F.isnan("shares") & F.col("issuer_key").isNotNull(), F.col("shares"))
    before, after = F.last(shares, ignorenulls=True).over(up), F.last(shares, ignorenulls=True).over(down)
    p = points.withColumn("_ref", F.coalesce(before, after) * F.when((F.col("price_used") > 0) & ~F.isnan("price_used"), F.col("price_used"))).where(F.col("mcap_sek").isNotNull())
    value, number = F.col("mcap_sek"), stated_number(F.col("mcap_text"))
    p = p.withColumn("_field", mcap_unit(F.col("mcap_unit"))).withColumn("_text", mcap_unit(F.col("mcap_text")))
    scale = F.create_map(*[x for u in MCAP_UNITS for x in (F.lit(u), F.lit(UNITS[u][0]))])
    close = lambda a, b: F.abs(a - b) <= F.greatest(F.lit(0.0051), F.abs(b) * 1e-4)
    guess = F.when(close(value, number), F.col("_text")).when(close(value / scale[F.col("_text")], number), F.lit("SEK"))
    word = F.col("_field").isNotNull() & (F.col("_text").isNull() | (F.col("_text") == F.col("_field")))
    t = p.select(
        F.lit("mcap").alias("kind"), F.col("point_id").alias("id"), "issuer_key", F.col("price_source").alias("source"), value.alias("value"), F.col("as_of_day").alias("day"),
        F.when(word, F.col("_field")).otherwise(F.coalesce(guess, "_field", F.lit("SEK"))).alias("stated"), F.lit(False).alias("firm"), F.when(~word, F.col("_ref")).alias("ref"),
    )
    return _judged(t, fx, MCAP_UNITS, 0.01, 0.2)


def _judged(t: DataFrame, fx: DataFrame, units: list[str], sigma: float, wide: float | None, penalty: float = PENALTY) -> DataFrame:
    """t: kind, id, issuer_key, source, value, day, stated, firm, ref (SEK the value should be worth; null: the word stands).

    A history (issuer and source) is segmented as a whole and exactly, though no task holds it: 1. each part (month) is
    summed up by what it costs to get through it from one level to another; 2. the best path through a history's parts gives
    the level before and at the end of each; 3. with these each part is decided by itself. Batches and partitions cannot be seen
    in the result, and a hot issuer is spread over its months. Rows without a reference or a day take no part in this.
    """
    t = with_rates(t, "day", fx, CURRENCIES)
    t = t.withColumn("y", F.log(F.when((F.col("value") > 0) & ~F.isnan("value"), F.col("value")) / F.col("ref")))
    hist = F.when(F.col("issuer_key").isNotNull() & F.col("day").isNotNull(), F.concat_ws("|", "issuer_key", "source"))
    t = t.select("kind", "id", "value", "day", hist.alias("hist"), F.date_format("day", "yyyy-MM").alias("part"), "y", "stated", "firm", *[f"fx_{c}" for c in CURRENCIES])
    kinds = ", ".join(f"{c} {k}" for c, k in t.select("kind", "id", "value", "day").dtypes) + ", unit string, sek double"
    t = t.mapInPandas(_costed(units, sigma, wide, penalty), kinds + ", hist string, part string, known boolean, sure boolean, cost array<double>, worth array<double>")
    w = Window.partitionBy("hist", "part").orderBy("day", "id")
    h = t.repartition("hist", "part").withColumns({"cut": F.coalesce(F.lag("sure").over(w), F.lit(False)), "stop": F.coalesce(F.lead("sure").over(w), F.lit(False)), "nth": F.row_number().over(w)})
    # both readers of h ask for the same columns and neither for a condition on hist, so that its shuffle is done once
    m, order = len(units) + 1, ["hist", "part", "day", "id"]
    sums = h.where("known and (not sure or nth = 1)").sortWithinPartitions(*order).mapInPandas(_summaries(m, penalty), "hist string, part string, head array<double>, tail array<double>")
    ends = sums.repartition("hist").sortWithinPartitions("hist", "part").mapInPandas(_chain(m), "hist string, part string, first int, last int")
    return h.join(ends, ["hist", "part"], "left").sortWithinPartitions(*order).mapInPandas(_deciding(units, penalty), kinds)
