"""As-of, nearest and band joins on days, all as equi-joins on (key, time bucket) with half-open containment."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kronolit.operators.intervals import bucketed_interval_join, day_bucket


def _latest(right: DataFrame, key: str, on: str, values: list[str]) -> DataFrame:
    """One row per (key, day): the greatest values, so that repeated points are one."""
    return right.where(F.col(key).isNotNull() & F.col(on).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(on).cast("date").alias("_d")).agg(F.max(F.struct(*values)).alias("_v"))


def asof_backward(left: DataFrame, right: DataFrame, *, key: str, left_on: str, right_on: str, values: list[str], right_key: str | None = None, max_age: int | None = None, lag: int = 0) -> DataFrame:
    """``left`` with ``values`` of the last ``right`` row of its key on or before ``left_on``, and its day ``<right_on>_matched``.

    ``lag``: a point is known that many days after its day. ``max_age``: a point counts for that many days from when it is
    known; older ones give nulls. Null keys and days match nothing; every left row comes out once.
    """
    r = _latest(right, right_key or key, right_on, values).withColumn("_s", F.date_add("_d", lag))
    end = F.lead("_s").over(Window.partitionBy("_k").orderBy("_s"))
    if max_age is not None:
        end = F.least(F.coalesce(end, F.date_add("_s", max_age + 1)), F.date_add("_s", max_age + 1))
    r = r.withColumn("_e", end)
    out = _interval_left(left, r, key, left_on)
    return out.select(*left.columns, *[F.col(f"_v.{v}").alias(v) for v in values], F.col("_d").alias(f"{right_on}_matched"))


def asof_forward(left: DataFrame, right: DataFrame, *, key: str, left_on: str, right_on: str, values: list[str], right_key: str | None = None, strict: bool = False, max_ahead: int | None = None) -> DataFrame:
    """``left`` with ``values`` of the first ``right`` row of its key on or after (``strict``: after) ``left_on``, with
    ``max_ahead`` at most that many days ahead."""
    r = _latest(right, right_key or key, right_on, values)
    start = F.coalesce(F.lag("_d").over(Window.partitionBy("_k").orderBy("_d")), F.lit("0001-01-01").cast("date"))
    if max_ahead is not None:
        start = F.greatest(start, F.date_sub("_d", max_ahead + 1))
    shift = 0 if strict else 1
    r = r.withColumn("_s", F.date_add(start, shift)).withColumn("_e", F.date_add("_d", shift))
    return _interval_left(left, r, key, left_on).select(*left.columns, *[F.col(f"_v.{v}").alias(v) for v in values], F.col("_d").alias(f"{right_on}_matched"))


def _interval_left(left: DataFrame, r: DataFrame, key: str, on: str) -> DataFrame:
    iv = r.select("_k", "_s", "_e", "_d", "_v").withColumnRenamed("_k", key)
    return bucketed_interval_join(left, iv, key, on, "_s", "_e", how="left")


def band_exists(left: DataFrame, right: DataFrame, *, keys: list[str], left_on: str, right_on: str, days: int, name: str = "found") -> DataFrame:
    """``left`` with a flag whether ``right`` has a row with equal keys within ``days`` days of ``left_on``.

    Right rows are reduced to distinct (keys, day) and put into their bucket and the neighbours it can reach, so the join
    is an equi-join and meets few rows a bucket. Null keys or days find nothing.
    """
    width = max(2 * days + 1, 7)
    r = right.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(right_on).cast("date").alias("_d")).dropna().distinct()
    r = r.withColumn("_b", F.explode(F.array_distinct(F.array(day_bucket(F.date_sub("_d", days), width), day_bucket(F.col("_d"), width), day_bucket(F.date_add("_d", days), width)))))
    ids = left.select(*keys, F.col(left_on).cast("date").alias("_l")).dropna().distinct().withColumn("_lb", day_bucket(F.col("_l"), width))
    cond = (F.col("_lb") == F.col("_b")) & (F.abs(F.datediff("_l", "_d")) <= days)
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_{k}"))
    hits = ids.join(r, cond, "left_semi").select(*[F.col(k).alias(f"_{k}") for k in keys], "_l").withColumn("_hit", F.lit(True))
    on = F.col(left_on).cast("date") == F.col("_l")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return left.join(hits, on, "left").select(*left.columns, F.coalesce("_hit", F.lit(False)).alias(name))


def nearest_peer(events: DataFrame, pool: DataFrame, *, event_id: str, entity: str, at: str, size: str, factor: float | None = 2.0) -> DataFrame:
    """event_id, peer, distance: of the pool rows of the event's day whose size is within ``factor`` (at most two; None: any
    size), the one of another entity whose log size is nearest; ties go to the lower entity.

    No pair is formed. Events and pool are sorted by size inside (day, band), a band being a power of two to whose neighbours
    the pool is copied. A running window hands each event the pool row before it and, should that be of the event's own
    entity, the last one before that of another; the same downwards. Sizes that are null, NaN or not positive are no sizes.
    Events without a pool row in these bands meet what their day's bands begin and end with, a few rows a band. One row per
    event that has a peer.
    """
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0)
    band = F.floor(F.log2(F.col(size))).cast("int")
    p = pool.where(ok(size) & F.col(entity).isNotNull() & F.col(at).isNotNull()).select(F.col(at).alias("at"), F.col(entity).alias("e"), F.log(F.col(size)).alias("y"), band.alias("b")).distinct()
    p = p.withColumn("b", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)))
    ev = events.where(ok(size) & F.col(entity).isNotNull() & F.col(at).isNotNull()).select(F.col(event_id).alias("event_id"), F.col(at).alias("at"), F.col(entity).alias("e"), F.log(F.col(size)).alias("y"), band.alias("b"))
    both = p.withColumn("pool", F.lit(True)).withColumn("event_id", F.lit(None).cast(dict(ev.dtypes)["event_id"])).unionByName(ev.withColumn("pool", F.lit(False)))

    def beside(df: DataFrame, up: bool, name: str) -> DataFrame:
        """The nearest pool row of another entity at or below (``up``) or above the event, as a struct of size and entity."""
        size_order, pool_order = (F.asc("y"), F.desc("pool")) if up else (F.desc("y"), F.asc("pool"))
        w = Window.partitionBy("at", "b").orderBy(size_order, pool_order, F.desc("e"))
        so_far = w.rowsBetween(Window.unboundedPreceding, -1)
        here = F.when(F.col("pool"), F.struct("y", "e"))
        df = df.withColumn("_last", F.last(here, ignorenulls=True).over(so_far))
        df = df.withColumn("_turn", F.when(F.col("pool") & (F.col("_last.e") != F.col("e")), F.col("_last")))
        df = df.withColumn("_other", F.last("_turn", ignorenulls=True).over(so_far))
        return df.withColumn(name, F.when(F.col("_last.e") != F.col("e"), F.col("_last")).otherwise(F.col("_other"))).drop("_last", "_turn", "_other")

    near = beside(beside(both, True, "lo"), False, "hi").where(~F.col("pool"))
    d = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("y") - F.col(f"{c}.y")).alias("distance"), F.col(f"{c}.e").alias("peer")))
    x = near.select("event_id", F.least(d("lo"), d("hi")).alias("x")).where(F.col("x").isNotNull() & (F.col("x.distance") <= math.log(factor or 2)))
    if factor is None:
        p = p.select("at", "e", "y").distinct().withColumn("b", F.floor(F.col("y") / math.log(2)).cast("int"))
        ends = []
        for sign in (1, -1):
            key = F.struct((F.col("y") * sign).alias("k"), "e")
            first = p.groupBy("at", "b").agg(F.min(key).alias("one"))
            other = p.join(first, ["at", "b"]).where(F.col("e") != F.col("one.e")).groupBy("at", "b").agg(F.min(key).alias("one"))
            ends += [g.select("at", (F.col("one.k") * sign).alias("y"), F.col("one.e").alias("e")) for g in (first, other)]
        day = ends[0].unionByName(ends[1]).unionByName(ends[2]).unionByName(ends[3]).groupBy("at").agg(F.collect_set(F.struct("y", "e")).alias("_all"))
        rest = ev.join(x.select("event_id").distinct(), "event_id", "left_anti").join(day, "at")
        far = F.array_min(F.transform(F.filter("_all", lambda c: c["e"] != F.col("e")), lambda c: F.struct(F.abs(F.col("y") - c["y"]).alias("distance"), c["e"].alias("peer"))))
        x = x.unionByName(rest.select("event_id", far.alias("x")).where(F.col("x").isNotNull()))
    return x.groupBy("event_id").agg(F.min("x").alias("x")).select("event_id", "x.peer", "x.distance")
