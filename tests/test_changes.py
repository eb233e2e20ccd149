import random

import pytest

from kronolit.operators.changes import newest_first

S = "feed_id long, record_id string, op string, published_at timestamp_ntz, seq int, kept string, d string"
ARGS = {"key": "record_id", "order": ["published_at", "seq"], "delivery": "feed_id", "op": "op"}


def brute(feed, base=()):
    last = {}
    for f, r, op, t, s, *_ in feed:
        if None in (f, r, op, t) or op not in ("I", "U", "D"):
            continue
        if (r, t, s) not in last or last[r, t, s][0] < f:
            last[r, t, s] = (f, op)
    state = dict.fromkeys(base)
    for (r, t, s), (f, op) in sorted(last.items(), key=lambda x: (x[0][0], x[0][1], -1 if x[0][2] is None else x[0][2])):
        if op == "I" or op == "U" and r in state:
            state[r] = f
        elif op == "D":
            state.pop(r, None)
    return state


@pytest.mark.parametrize("seed", range(5))
def test_against_replay(spark, seed):
    import datetime as dt

    r = random.Random(seed)
    feed = []
    for i in range(400):
        hot = r.random() < 0.3
        t = r.choice([None, *range(40)])
        feed.append((i, "hot" if hot else r.choice([None, *map(str, range(40))]), r.choice(["I", "U", "U", "D", None, "X"]), None if t is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=t), r.choice([0, 1, 2, None]), "x", "y"))
    feed += [(1000 + i, *f[1:]) for i, f in enumerate(feed[::7])]  # delivered again
    base = ["b1", "b2", "hot", *map(str, range(0, 40, 5))]
    df, b = spark.createDataFrame(feed, S), spark.createDataFrame([(x,) for x in [*base, None, "b1"]], "record_id string")
    for n in (1, 3):
        assert {x["record_id"]: x["feed_id"] for x in newest_first(df, **ARGS, batches=n).collect()} == brute(feed)
        assert {x["record_id"]: x["feed_id"] for x in newest_first(df, **ARGS, batches=n, base=b).collect()} == brute(feed, base)


def test_empty(spark):
    df = spark.createDataFrame([], S)
    assert newest_first(df, **ARGS).count() == 0
    assert newest_first(df, **ARGS, base=spark.createDataFrame([("a",)], "record_id string")).collect() == [("a", None)]
