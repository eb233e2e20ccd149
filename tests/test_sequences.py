import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kronolit.operators.asof import asof_backward, asof_forward, band_exists
from kronolit.operators.bitemporal import Register, link_revisions, with_visibility
from kronolit.operators.sequence import cooldown, detect_episodes, factor_after, find_window, occurrence_ids, window_distinct
from kronolit.operators.stats import bootstrap_interval, t_clustered, t_iid

D = dt.date(2020, 1, 1)


def day(n):
    return D + dt.timedelta(days=n)


def random_rows(seed, n=60, keys="ab"):
    r = random.Random(seed)
    return [(r.choice(keys), f"p{r.randrange(5)}", day(r.randrange(120)), dt.datetime(2020, 1, 1) + dt.timedelta(days=r.randrange(160), hours=r.randrange(3))) for _ in range(n)]


def quadratic(rows, least, days):
    for a in sorted({d for d, _ in rows}):
        if len({p for d, p in rows if a <= d <= a + days}) >= least:
            return a
    return None


@pytest.mark.parametrize("seed", range(40))
def test_window_search(seed):
    r = random.Random(seed)
    rows = sorted((r.randrange(120), f"p{r.randrange(5)}") for _ in range(r.randint(3, 24)))
    for days in (10, 30):
        assert find_window(rows, 3, days) == quadratic(rows, 3, days)


@pytest.mark.parametrize("seed", range(3))
def test_window_distinct(spark, seed):
    rows = random_rows(seed)
    df = spark.createDataFrame([*rows, (None, "p", day(1), None), ("a", None, day(1), None)], "k string, p string, d date, t timestamp_ntz")
    want = set()
    for k in "ab":
        own = {(d, p) for kk, p, d, _ in rows if kk == k}
        for a in {d for d, _ in own}:
            n = len({p for d, p in own if a <= d <= a + dt.timedelta(days=30)})
            if n >= 3:
                want.add((k, a, n))
    assert {tuple(r) for r in window_distinct(df, "k", "p", "d", 30, 3).collect()} == want


def episodes(rows, least=3, days=30, gap=31, lookback=365):
    out = []
    for k in sorted({r[0] for r in rows}):
        first = {}
        for kk, p, d, t in rows:
            if kk == k:
                first[p, d] = min(first.get((p, d), t), t)
        ended = None
        for t in sorted(set(first.values())):
            seen = [(d, p) for (p, d), tt in first.items() if tt <= t and d >= t.date() - dt.timedelta(days=lookback) and (ended is None or d >= ended + dt.timedelta(days=gap))]
            a = quadratic([(d.toordinal(), p) for d, p in seen], least, days)
            if a is not None:
                a = dt.date.fromordinal(a)
                inside = [(d, p) for d, p in seen if a <= d <= a + dt.timedelta(days=days)]
                ended = a + dt.timedelta(days=days)
                out.append((k, t, a, len({p for _, p in inside}), (t.date() - max(d for d, _ in inside)).days))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_episodes(spark, seed):
    rows = random_rows(seed, 80, "abc")
    df = spark.createDataFrame([*rows, *rows[:9]], "k string, p string, d date, t timestamp_ntz")
    assert sorted(tuple(r) for r in detect_episodes(df, "k", "p", "d", "t").collect()) == sorted(episodes(rows))


def test_cooldown_is_greedy(spark):
    df = spark.createDataFrame([("a", day(0)), ("a", day(100)), ("a", day(100)), ("a", day(127)), ("a", day(253)), ("a", day(254)), ("b", None), (None, day(3))], "k string, d date")
    assert sorted((r["k"] or "", r["d"]) for r in cooldown(df, "k", "d", 126).collect()) == [("", day(3)), ("a", day(0)), ("a", day(127)), ("a", day(254))]


def test_occurrences(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "x", None), (3, "y", ""), (4, "x", "")], "i int, a string, b string")
    got = {r["i"]: r["record_id"] for r in occurrence_ids(df, ["a", "b"], ["i"]).collect()}
    assert got[1].endswith(":0") and got[2].endswith(":1") and got[4].endswith(":2") and got[3].endswith(":0")
    again = {r["i"]: r["record_id"] for r in occurrence_ids(df.where("i != 3"), ["a", "b"], ["i"]).collect()}
    assert all(again[i] == got[i] for i in again)


def test_asof(spark):
    left = spark.createDataFrame([(1, "a", day(10)), (2, "a", day(17)), (3, "a", day(18)), (4, "a", day(9)), (5, None, day(10)), (6, "z", day(10)), (7, "a", None)], "i int, k string, d date")
    right = spark.createDataFrame([("a", day(10), 1.0), ("a", day(10), 0.5), ("a", day(40), 2.0), (None, day(1), 9.0)], "k string, t date, v double")
    back = {r["i"]: r["v"] for r in asof_backward(left, right, key="k", left_on="d", right_on="t", values=["v"], max_age=7).collect()}
    assert back == {1: 1.0, 2: 1.0, 3: None, 4: None, 5: None, 6: None, 7: None}
    fore = {r["i"]: r["v"] for r in asof_forward(left, right, key="k", left_on="d", right_on="t", values=["v"]).collect()}
    assert fore == {1: 1.0, 2: 2.0, 3: 2.0, 4: 1.0, 5: None, 6: None, 7: None}
    strict = {r["i"]: r["v"] for r in asof_forward(left, right, key="k", left_on="d", right_on="t", values=["v"], strict=True, max_ahead=25).collect()}
    assert strict == {1: None, 2: 2.0, 3: 2.0, 4: 1.0, 5: None, 6: None, 7: None}
    band = {r["i"]: r["found"] for r in band_exists(left, right, keys=["k"], left_on="d", right_on="t", days=7).collect()}
    assert band == {1: True, 2: True, 3: False, 4: True, 5: False, 6: False, 7: False}


def test_factor(spark):
    p = spark.createDataFrame([("a", day(0)), ("a", day(5)), ("a", day(9)), ("b", day(1))], "k string, d date")
    s = spark.createDataFrame([("a", day(5), 2.0), ("a", day(8), 3.0), ("a", day(8), 1.5)], "k string, d date, r double")
    assert sorted((r["k"], r["d"], r["factor"]) for r in factor_after(p, s, "k", "d", "r").collect()) == [("a", day(0), 9.0), ("a", day(5), 4.5), ("a", day(9), 1.0), ("b", day(1), 1.0)]


def test_revisions(spark):
    t = lambda n: dt.datetime(2020, 3, n)
    rows = [(1, "a", t(1), False, 10.0, "x"), (2, "a", t(2), False, 20.0, "x"), (3, "a", t(3), True, 10.0, "x"), (4, "a", t(4), True, 10.0, "x"), (5, "a", t(4), True, 99.0, None), (6, None, t(1), False, 1.0, None), (7, None, t(2), True, 1.0, None), (8, "c", t(5), True, 1.0, "q"), (9, "d", t(5), False, 1.0, "q")]
    df = spark.createDataFrame(rows, "row_id long, k string, published timestamp_ntz, am boolean, volume double, venue string")
    got = {r["row_id"]: (r["linked_to"], r["score"], r["ambiguous"]) for r in link_revisions(df, ["k"], "published", "am", "row_id", {"volume": 2.0, "venue": 1.0}).collect()}
    assert got == {3: (1, 3.0, False), 4: (3, 3.0, False), 5: (2, 0.0, False), 7: (6, 2.0, False), 8: (None, 0.0, False)}


def test_truncation_changes_nothing(spark, data):
    """What is visible at an instant is the same with the later rows cut off."""
    tx = spark.read.parquet(f"{data}/register_txns.parquet")
    as_of = F.lit("2025-01-15 00:00:00").cast("timestamp_ntz")
    keys = ["issuer_key", "name_key", "trade_date"]
    full = Register(with_visibility(tx, keys, "published_at", "is_amendment", "row_id")).visible(as_of)
    cut = Register(with_visibility(tx.where(F.col("published_at") <= as_of), keys, "published_at", "is_amendment", "row_id")).visible(as_of)
    assert {r[0] for r in full.select("row_id").collect()} == {r[0] for r in cut.select("row_id").collect()}


def test_statistics(spark):
    df = spark.createDataFrame([("c", 0.1, "a", 1), ("c", 0.2, "b", 2), ("c", 0.3, "c", 3), ("c", None, "c", 4), ("d", 1.0, "a", 5)], "cell string, x double, g string, i int")
    got = {r["cell"]: r["t"] for r in t_iid(df, "cell", "x").collect()}
    assert got["c"] == pytest.approx(3.4641, abs=1e-4) and got["d"] is None
    one = {r["cell"]: r["t"] for r in t_clustered(df, "cell", "x", "g", least=2).collect()}
    assert one["c"] == pytest.approx(3.4641, abs=1e-4)
    assert {r["cell"]: r["t"] for r in t_clustered(df, "cell", "x", "g").collect()} == {"c": None, "d": None}
    a, b = (sorted(tuple(r) for r in bootstrap_interval(x, "cell", "x", "i", draws=50).collect()) for x in (df, df.repartition(3)))
    assert [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in a] == [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in b]
    assert a[0][1] < 0.2 < a[0][2]


@pytest.mark.parametrize("seed", range(5))
def test_nearest_peer(spark, seed):
    import math

    from kronolit.operators.asof import nearest_peer

    r = random.Random(seed)
    size = lambda: r.choice([None, 0.0, -1.0, float("nan"), *[float(r.randint(1, 40)) for _ in range(12)]])
    rows = [(i, r.choice(["a", "b", "c", "d", None]), r.choice([day(1), day(2), None]), size()) for i in range(80)]
    df = spark.createDataFrame(rows, "i int, k string, d date, s double")
    good = [(i, k, d, math.log(s)) for i, k, d, s in rows if None not in (k, d, s) and s > 0]
    want = {}
    for i, k, d, x in good:
        c = [(abs(x - y), kk) for _, kk, dd, y in good if dd == d and kk != k and abs(x - y) <= math.log(2) + 1e-12]
        if c:
            want[i] = min((round(a, 9), b) for a, b in c)
    got = {x["event_id"]: (round(x["distance"], 9), x["peer"]) for x in nearest_peer(df, df, event_id="i", entity="k", at="d", size="s").collect()}
    assert got == want
