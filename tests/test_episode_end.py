"""Episodes that end with the last day inside their window, as the reference has it."""

import datetime as dt
import random

import pytest

from kronolit.operators.sequence import detect_episodes
from kronolit.plans import register
from kronolit.streaming.feed import stream_episodes

D = dt.date(2024, 1, 1)


def reference(rows, least=3, days=30, gap=31, lookback=365):
    """The rule read from gates/clusters.py: min_anchor = greatest trade date of the window + cooldown."""
    out = []
    for k in sorted({r[0] for r in rows}):
        first = {}
        for kk, p, d, t in rows:
            if kk == k:
                first[p, d] = min(first.get((p, d), t), t)
        end = None
        for t in sorted(set(first.values())):
            seen = [(d, p) for (p, d), tt in first.items() if tt <= t and d >= t.date() - dt.timedelta(days=lookback)]
            for a in sorted({d for d, _ in seen if end is None or d >= end + dt.timedelta(days=gap)}):
                window = [(d, p) for d, p in seen if a <= d <= a + dt.timedelta(days=days)]
                if len({p for _, p in window}) >= least:
                    end = max(d for d, _ in window)
                    out.append((k, t, a, len({p for _, p in window}), (t.date() - end).days))
                    break
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, p string, d date, t timestamp_ntz")


def close_pair():
    """Three persons at days 0-2, three again at days 35-37: after day 2 + 31, before day 0 + 30 + 31."""
    return [("a", f"p{i}", D + dt.timedelta(days=s + i), dt.datetime(2024, 1, 2) + dt.timedelta(days=s + i)) for s in (0, 35) for i in range(3)]


def test_second_episode_is_kept(spark):
    got = sorted(r["anchor"] for r in detect_episodes(frame(spark, close_pair()), "k", "p", "d", "t", end="last").collect())
    assert got == [D, D + dt.timedelta(days=35)]


@pytest.mark.parametrize("seed", range(6))
def test_as_the_reference(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice("abc"), f"p{r.randrange(5)}", D + dt.timedelta(days=r.randrange(300)), dt.datetime(2024, 1, 1) + dt.timedelta(days=r.randrange(400), hours=r.randrange(3))) for _ in range(200)]
    assert sorted(tuple(x) for x in detect_episodes(frame(spark, rows), "k", "p", "d", "t", end="last").collect()) == reference(rows)


def test_query(spark, data):
    rows = [tuple(x) for x in spark.read.parquet(f"{data}/register_txns.parquet").select("issuer_key", "name_key", "trade_date", "published_at").dropna().collect()]
    assert sorted(tuple(x) for x in register.crowd_episodes(spark, data).collect()) == reference(rows)


def test_stream(spark, tmp_path):
    frame(spark, close_pair()).selectExpr("k", "p", "d", "cast(t as timestamp) t").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("k string, p string, d date, t timestamp").parquet(str(tmp_path / "in"))
    stream_episodes(s, "k", "p", "d", "t", end="last").writeStream.format("memory").queryName("ends").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["anchor"] for r in spark.table("ends").collect()) == [D, D + dt.timedelta(days=35)]
