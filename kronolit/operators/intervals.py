"""Interval joins by time bucket, and attributes as they were known at an event (problem 5)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPOCH = "1970-01-01"


def day_bucket(day: Column, width: int) -> Column:
    return F.floor(F.datediff(day, F.lit(EPOCH).cast("date")) / F.lit(width)).cast("int")


#: Days outside of this span are taken for mistakes: they find their intervals all the same, but never widen the fine buckets.
PLAUSIBLE = ("1900-01-01", "2100-01-01")
#: Days of a coarse bucket, so that the whole calendar is four of them.
COARSE = 1_000_000


def event_bounds(events: DataFrame, at: str) -> tuple[dt.date, dt.date, bool]:
    """First and last plausible day of the events and whether any lies outside of ``PLAUSIBLE``: one aggregate over one column."""
    day = F.col(at).cast("date")
    low, high = (F.lit(x).cast("date") for x in PLAUSIBLE)
    inside = (day >= low) & (day < high)
    first, last, odd = events.agg(F.min(F.when(inside, day)), F.max(F.when(inside, day)), F.max(F.when(inside, 0).otherwise(F.when(day.isNotNull(), 1)))).first()
    if first is None:
        first = last = dt.date.fromisoformat(PLAUSIBLE[0])
    return first, last, bool(odd)


def bucketed_interval_join(
    events: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, width: int = 32, how: str = "inner", bounds: tuple[dt.date, dt.date] | None = None
) -> DataFrame:
    """Each event with every interval of its ``key`` that contains ``at``: ``start <= at < end`` (dates; ``end`` null: open).

    Both sides meet in an equi-join on (key, bucket of ``width`` days), so a hot key is spread over its buckets and the
    containment is checked inside a bucket only. Intervals are exploded from the first event day to the last: ``bounds``, or what
    one aggregate tells when they are not given (a stream has to give them). Events outside of the bounds, such as those of a
    mistyped year, meet their intervals in coarse buckets, of which an interval has four at most. Null keys or days match
    nothing; ``how="left"`` keeps events without a match, with nulls. ``intervals`` may not share column names with ``events``
    other than ``key``.
    """
    first, last, odd = (*bounds, True) if bounds is not None else event_bounds(events, at)
    first, last = (F.lit(x).cast("date") for x in (first, last))
    begin, until = F.greatest(F.col(start), first), F.least(F.coalesce(F.date_sub(F.col(end), 1), last), last)
    fine = F.when(until >= begin, F.transform(F.sequence(day_bucket(begin, width), day_bucket(until, width)), lambda x: F.struct(F.lit(0).alias("level"), x.alias("number"))))
    slots = F.coalesce(fine, F.array().cast("array<struct<level:int,number:int>>"))
    if odd:
        final = F.coalesce(F.date_sub(F.col(end), 1), F.lit("9999-12-31").cast("date"))
        rough = F.when(final >= F.col(start), F.transform(F.sequence(day_bucket(F.col(start), COARSE), day_bucket(final, COARSE)), lambda x: F.struct(F.lit(1).alias("level"), x.alias("number"))))
        slots = F.concat(slots, F.coalesce(rough, F.array().cast("array<struct<level:int,number:int>>")))
    iv = intervals.where(F.col(key).isNotNull() & F.col(start).isNotNull()).withColumn("_cell", F.explode(slots))
    # the planner sees the size before the explosion and would broadcast what the explosion makes large
    iv = iv.withColumns({"_level": F.col("_cell.level"), "_slot": F.col("_cell.number")}).drop("_cell").withColumnRenamed(key, "_key").hint("merge")
    ev = events if how == "left" else events.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    near = (F.col(at).cast("date") >= first) & (F.col(at).cast("date") <= last) if odd else F.lit(True)
    ev = ev.withColumn("_bucket", F.when(near, day_bucket(F.col(at), width)).otherwise(day_bucket(F.col(at), COARSE))).withColumn("_rough", F.when(near, 0).otherwise(1))
    inside = (F.col(at) >= F.col(start)) & (F.col(end).isNull() | (F.col(at) < F.col(end)))
    return ev.join(iv, (F.col(key) == F.col("_key")) & (F.col("_bucket") == F.col("_slot")) & (F.col("_rough") == F.col("_level")) & inside, how).drop("_bucket", "_rough", "_slot", "_level", "_key")


def _extents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive by key, then valid_from, known_at and version, all descending. One key's rows may span batches.

    A monotonic stack holds (valid_from, known_at) of later versions; the nearest one known no later than the row ends it.
    Only the stack is kept, never a key's rows.
    """
    key = start = prev = pending = None
    stack: list[tuple] = []
    for pdf in batches:
        ends, keep = [], []
        for k, vf, ka, _vid in zip(pdf["k"], pdf["vf"], pdf["ka"], pdf["vid"], strict=True):
            if k != key:
                key, start, prev, pending, stack = k, None, None, None, []
            if vf != start:
                if pending is not None:
                    stack.append(pending)
                start, prev = vf, None
            # same valid_from and known_at: only the greatest version, which comes first, can ever win
            keep.append((vf, ka) != prev)
            prev = (vf, ka)
            while stack and stack[-1][1] > ka:
                stack.pop()
            ends.append(stack[-1][0] if stack else None)
            pending = (vf, ka)  # the earliest known of this day comes last
        yield pd.DataFrame({"k": pdf["k"], "vf": pdf["vf"], "ka": pdf["ka"], "vid": pdf["vid"], "ve": pd.Series(ends, dtype=object), "keep": keep})[lambda d: d["keep"]].drop(columns="keep")


def version_extents(versions: DataFrame, key: str, valid_from: str, known_at: str, version: str) -> DataFrame:
    """Columns k, vf, ka, vid, ve: the longest validity ``[vf, ve)`` that a version can have as of any moment of knowledge.

    ``ve`` is the first later valid_from among versions known no later than this one; a version never counts from there on.
    Versions with a null key, valid_from or known_at are left out; exact repeats keep the greatest version.
    """
    v = versions.select(F.col(key).alias("k"), F.col(valid_from).cast("date").alias("vf"), F.col(known_at).alias("ka"), F.col(version).alias("vid")).dropna()
    ordered = v.repartition("k").sortWithinPartitions(F.col("k"), F.col("vf").desc(), F.col("ka").desc(), F.col("vid").desc())
    return ordered.mapInPandas(_extents, v.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", ve date")


def _versions_of(e: DataFrame, versions: DataFrame, key: str, valid_from: str, known_at: str, version: str, width: int) -> DataFrame:
    """event_id, a, b: the version that e (event_id, k, at, known_by) could know and the one of hindsight, of events that meet any."""
    j = bucketed_interval_join(e, version_extents(versions, key, valid_from, known_at, version), "k", "at", "vf", "ve", width)
    rank = F.struct("vf", "ka", "vid")
    return j.groupBy("event_id").agg(F.max(F.when(F.col("ka") <= F.col("known_by"), rank))["vid"].alias("a"), F.max(rank)["vid"].alias("b"))


def as_known_at(events: DataFrame, versions: DataFrame, *, event_id: str, key: str, at: str, known_by: str, valid_from: str = "valid_from", known_at: str = "known_at", version: str = "version_id", width: int = 32) -> DataFrame:
    """Columns event_id, version_id, hindsight_id: the version valid at ``at`` as far as known at ``known_by``, and the one
    valid with today's knowledge. Ties go to the latest valid_from, then known_at, then version. No version: 0.

    Every event with a key, ``at`` and ``known_by`` comes out once; events lacking one of them come out with nulls.
    Repeated event ids are one event if they agree, null ids none. Extra columns of either side play no part.
    """
    e = events.where(F.col(event_id).isNotNull()).select(F.col(event_id).alias("event_id"), F.col(key).alias("k"), F.col(at).cast("date").alias("at"), F.col(known_by).alias("known_by"))
    best = _versions_of(e, versions, key, valid_from, known_at, version, width)
    complete = F.col("k").isNotNull() & F.col("at").isNotNull() & F.col("known_by").isNotNull()
    return e.select("event_id", complete.alias("c")).distinct().join(best, "event_id", "left").select("event_id", F.when(F.col("c"), F.coalesce("a", F.lit(0))).alias("version_id"), F.when(F.col("c"), F.coalesce("b", F.lit(0))).alias("hindsight_id"))


def hindsight_cases(events: DataFrame, versions: DataFrame, *, event_id: str, key: str, at: str, known_by: str, valid_from: str = "valid_from", known_at: str = "known_at", version: str = "version_id", width: int = 32) -> DataFrame:
    """Columns event_id, version_id of the complete events whose version differs from the one later knowledge would give.

    An event that meets no version at all agrees with itself (0 and 0), so the inner join suffices here.
    """
    e = events.select(F.col(event_id).alias("event_id"), F.col(key).alias("k"), F.col(at).cast("date").alias("at"), F.col(known_by).alias("known_by")).dropna()
    best = _versions_of(e, versions, key, valid_from, known_at, version, width)
    return best.select("event_id", F.coalesce("a", F.lit(0)).alias("version_id"), "b").where(F.col("version_id") != F.col("b")).drop("b")
