"""Applying a stream of inserts, updates and deletes, newest first (problem 6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kronolit.session import checkpointed


def newest_first(feed: DataFrame, *, key: str, order: list[str], delivery: str, op: str, base: DataFrame | None = None, batches: int = 4) -> DataFrame:
    """The records that exist after all changes, with the delivery that gave each its present content.

    Columns: ``key``, ``delivery`` (null for an untouched base row).
    Deliveries with equal key and ``order`` columns are one change, and the greatest ``delivery`` counts. Changes take
    effect by ``order``; I creates or replaces, U replaces and D removes a present record, U and D do nothing to an absent one.
    Rows with a null key, op, delivery or first order column, or an op other than I, U, D, are no changes.
    ``base`` (column ``key``) holds the records present before the feed.

    Batches of ``order[0]`` are processed backwards. A key is resolved by the first I (a record) or D (a tombstone) met on
    the way back; the newest U met before that is kept as its pending image. Older batches are anti-joined against resolved
    keys, so their older changes are never looked at again; at the end a pending U stands only on a base row. Each step is
    a grouped aggregation with partial aggregates, so a key with any share of all rows stays a single small buffer a task.
    """
    rank = [F.col(c).alias(f"o{i}") for i, c in enumerate(order)]
    f = feed.select(F.col(key).alias("k"), *rank, F.col(delivery).alias("d"), F.upper(F.trim(F.col(op))).alias("op")).where(F.col("k").isNotNull() & F.col("d").isNotNull() & F.col("o0").isNotNull() & F.col("op").isin("I", "U", "D"))
    o = [f"o{i}" for i in range(len(order))]
    f = f.groupBy("k", *o).agg(F.max(F.struct("d", "op")).alias("x")).select("k", *o, "x.d", "x.op")
    probs = [i / batches for i in range(1, batches)]
    cuts = sorted({c for c in (f.agg(F.percentile_approx(F.col("o0").cast("timestamp").cast("double") if dict(f.dtypes)["o0"].startswith("timestamp") else F.col("o0").cast("double"), probs, 1000)).first()[0] or [])})
    at = F.col("o0").cast("timestamp").cast("double") if dict(f.dtypes)["o0"].startswith("timestamp") else F.col("o0").cast("double")
    f = f.withColumn("batch", reduce(lambda n, c: n + F.when(at > c, 1).otherwise(0), cuts, F.lit(0)))
    f = checkpointed(f)
    state = None  # k, kept (delivery of a record; null for a tombstone), done, pending
    for b in range(len(cuts), -1, -1):
        part = f.where(F.col("batch") == b).drop("batch")
        if state is not None:
            part = part.join(state.where("done").select("k"), "k", "left_anti")
        newest = F.struct(*o, "d", "op")
        got = part.groupBy("k").agg(F.max(newest)["d"].alias("image"), F.max(F.when(F.col("op") != "U", newest)).alias("turn"), F.max(newest)["op"].alias("last"))
        got = got.select("k", "image", F.col("turn.op").alias("turn"))
        if state is None:
            got = got.withColumn("pending", F.lit(None).cast(dict(f.dtypes)["d"]))
            old = None
        else:
            got = got.join(state.where(~F.col("done")).select("k", "pending"), "k", "left")
            old = state.join(got.select("k"), "k", "left_anti")
        image = F.coalesce("pending", "image")
        new = got.select("k", F.when(F.col("turn") == "I", image).alias("kept"), F.col("turn").isNotNull().alias("done"), F.when(F.col("turn").isNull(), image).alias("pending"))
        state = checkpointed(new if old is None else old.unionByName(new))
    records = state.where(F.col("kept").isNotNull()).select("k", F.col("kept").alias("d"))
    if base is not None:
        b0 = base.select(F.col(key).alias("k")).where(F.col("k").isNotNull()).distinct().join(state, "k", "left")
        records = records.unionByName(b0.where(~F.coalesce("done", F.lit(False))).select("k", F.col("pending").alias("d")))
    return records.select(F.col("k").alias(key), F.col("d").alias(delivery))
