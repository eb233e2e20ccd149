import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kronolit.operators.intervals import as_known_at, bucketed_interval_join, hindsight_cases

E = "row_id long, issuer_key string, trade_date date, published_at timestamp_ntz, vid string, k string"
V = "version_id long, issuer_key string, valid_from date, known_at timestamp_ntz, known_by string"
D = dt.date(2024, 1, 1)
ARGS = {"event_id": "row_id", "key": "issuer_key", "at": "trade_date", "known_by": "published_at"}


def day(n):
    return None if n is None else D + dt.timedelta(days=n)


def at(n):
    return None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def winner(versions, key, t, p):
    c = [(vf, ka, v) for v, k, vf, ka, _ in versions if k == key and vf is not None and ka is not None and vf <= t and (p is None or ka <= p)]
    return max(c)[2] if c else 0


@pytest.mark.parametrize("seed", range(6))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    versions = [(i, r.choice(["a", "a", "a", "b", None]), day(r.choice([None, *range(0, 400, 7)])), at(r.choice([None, *range(-30, 500)])), "x") for i in range(1, 120)]
    versions += [(200, *versions[3][1:]), (201, *versions[3][1:])]  # repeated versions under other ids
    events = [(i, r.choice(["a", "b", "c", None]), day(r.choice([None, *range(-20, 450)])), at(r.choice([None, *range(-20, 500)])), "v", "k") for i in range(300)]
    ev, vs = spark.createDataFrame(events, E), spark.createDataFrame(versions, V)
    got = {x["event_id"]: (x["version_id"], x["hindsight_id"]) for x in as_known_at(ev, vs, **ARGS, width=1 + seed * 9).collect()}
    want = {}
    for i, k, t, p, *_ in events:
        want[i] = (winner(versions, k, t, p), winner(versions, k, t, None)) if None not in (k, t, p) else (None, None)
    assert got == want
    cases = {x["event_id"]: x["version_id"] for x in hindsight_cases(ev, vs, **ARGS).collect()}
    assert cases == {i: a for i, (a, b) in want.items() if a != b}


def test_empty_tables(spark):
    ev, vs = spark.createDataFrame([], E), spark.createDataFrame([], V)
    one = spark.createDataFrame([(1, "a", day(1), at(1), "", "")], E)
    assert as_known_at(ev, vs, **ARGS).count() == 0
    assert hindsight_cases(ev, vs, **ARGS).count() == 0
    assert as_known_at(one, vs, **ARGS).collect() == [(1, 0, 0)]


def test_hot_key_is_spread_over_buckets(spark):
    ev = spark.range(5000).select(F.col("id").alias("row_id"), F.lit("hot").alias("issuer_key"), F.date_add(F.lit(D), (F.col("id") % 700).cast("int")).alias("trade_date"))
    iv = spark.createDataFrame([("hot", day(0), day(350)), ("hot", day(350), None)], "issuer_key string, s date, e date")
    got = bucketed_interval_join(ev, iv, "issuer_key", "trade_date", "s", "e")
    assert got.count() == 5000
    assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_half_open(spark):
    ev = spark.createDataFrame([(1, "a", day(10)), (2, "a", day(20)), (3, None, day(15)), (4, "a", None)], "i long, k string, t date")
    iv = spark.createDataFrame([("a", day(10), day(20)), (None, day(0), day(99)), ("a", None, day(5))], "k string, s date, e date")
    assert [x["i"] for x in bucketed_interval_join(ev, iv, "k", "t", "s", "e").collect()] == [1]
    assert sorted((x["i"], x["s"] is not None) for x in bucketed_interval_join(ev, iv, "k", "t", "s", "e", how="left").collect()) == [(1, True), (2, False), (3, False), (4, False)]
