"""Structured Streaming: change feeds, window replacement, counts with late data, and episodes with keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kronolit.operators.changes import newest_first
from kronolit.operators.sequence import episode_end, find_window


def stream_changes(stream: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Append every micro-batch of a change feed to the log, one folder a batch, so that a batch run again replaces itself."""

    def land(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")

    return stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_state(spark: SparkSession, log: str, **order: Any) -> DataFrame:
    """The records that exist after the changes landed so far; late and repeated deliveries resolve as in a batch."""
    return newest_first(spark.read.parquet(log), **order)


def stream_window_replace(stream: DataFrame, target: str, day: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch replaces the days it holds in a table partitioned by ``day``; other days stay untouched."""

    def replace(batch: DataFrame, number: int) -> None:  # noqa: ARG001
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(target)

    return stream.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, at: str, key: str, width: str = "30 days", late: str = "400 days") -> DataFrame:
    """window_start, key, n: rows a tumbling window; a window is final ``late`` after the newest row, and rows that come later still are
    no longer counted; ``flag_late`` keeps and marks them."""
    t = stream.withColumn("_t", F.col(at).cast("timestamp")).withWatermark("_t", late)
    return t.groupBy(F.window("_t", width).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "key", "n")


def flag_late(stream: DataFrame, at: str, seen: str, days: int) -> DataFrame:
    """``stream`` with ``days_late`` (from what happened to when it was seen) and whether that is more than ``days``. No row is
    dropped and no state is kept; where either time is null, so are both columns."""
    gap = F.datediff(F.col(seen), F.col(at))
    return stream.withColumn("days_late", gap).withColumn("is_late", gap > days)


def stream_episodes(stream: DataFrame, key: str, who: str, day: str, visible: str, least: int = 3, days: int = 30, gap: int = 31, lookback: int = 365, end: str = "window") -> DataFrame:
    """key, as_of, anchor, n_persons of each episode, emitted when it is found and never withdrawn (append mode).

    The state of a key is the end of its last episode and the (person, day) pairs of the last ``lookback`` days after it. Rows of a
    micro-batch are taken in order of ``visible``; rows that arrive in a later batch although visible earlier are taken when
    they arrive, with that batch's order, as an observer would have. ``end`` as in ``detect_episodes``.
    """
    s = stream.select(F.col(key).alias("k"), F.col(who).alias("p"), F.col(day).cast("date").alias("d"), F.col(visible).cast("timestamp").alias("t")).dropna()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ended, days_, persons = state.get if state.exists else (None, [], [])
        seen = set(zip(days_, persons, strict=True))
        rows = pd.concat(list(batches)).sort_values(["t", "d", "p"])
        out = []
        for t, part in rows.groupby("t", sort=True):
            now = t.date().toordinal()
            seen |= {(d.toordinal(), p) for d, p in zip(part["d"], part["p"], strict=True)}
            seen = {(d, p) for d, p in seen if d >= now - lookback and (ended is None or d >= ended + gap)}
            open_ = sorted(seen)
            a = find_window(open_, least, days) if len({p for _, p in open_}) >= least else None
            if a is not None:
                inside = [r for r in open_ if a <= r[0] <= a + days]
                ended = episode_end(a, max(d for d, _ in inside), days, end)
                out.append((k[0], t, pd.Timestamp.fromordinal(a).date(), len({p for _, p in inside})))
        order = sorted(seen)
        state.update((ended, [d for d, _ in order], [p for _, p in order]))
        yield pd.DataFrame(out, columns=["k", "as_of", "anchor", "n_persons"])

    got = s.groupBy("k").applyInPandasWithState(step, "k string, as_of timestamp, anchor date, n_persons int", "ended int, days array<int>, persons array<string>", "append", GroupStateTimeout.NoTimeout)
    return got.withColumnRenamed("k", key)
