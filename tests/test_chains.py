import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kronolit.operators.asof import nearest_peer
from kronolit.operators.chains import chase, standing
from kronolit.operators.intervals import bucketed_interval_join
from kronolit.operators.relational import seeded_sample

L = "row_id long, linked_to long, root string"


@pytest.mark.parametrize("seed", range(3))
def test_chase(spark, seed):
    r = random.Random(seed)
    up = {i: r.randrange(i) for i in range(1, 80) if r.random() < 0.8} | {100 + i: 99 + i for i in range(1, 40)}

    def end(i):
        n = 0
        while i in up:
            i, n = up[i], n + 1
        return i, n

    rows = [(a, b, "x") for a, b in up.items()] + [(500, None, "x"), (None, 3, "x")]
    got = {x["row_id"]: (x["root"], x["hops"]) for x in chase(spark.createDataFrame(rows, L), "row_id", "linked_to").collect()}
    assert got == {i: end(i) for i in up}


def test_chase_edges(spark):
    assert chase(spark.createDataFrame([], L), "row_id", "linked_to").count() == 0
    twice = spark.createDataFrame([(5, 4, ""), (5, 4, ""), (5, 3, "")], L)
    assert [tuple(x) for x in chase(twice, "row_id", "linked_to").collect()] == [(5, 3, 1)]


def test_standing(spark):
    rows = spark.createDataFrame([(1, "R"), (2, "A"), (3, "R"), (4, "M"), (5, None), (6, "A")], "row_id long, s string")
    links = spark.createDataFrame([(2, 1), (6, 2), (7, None)], "row_id long, linked_to long")
    got = {x["row_id"]: x["chain_status"] for x in standing(rows, links, "row_id", F.col("s") == "R", F.col("s") == "M").collect()}
    assert got == {1: "superseded", 2: "superseded_inferred", 3: "orphan_revised", 4: "cancelled", 5: "current", 6: "current"}


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("factor", [2.0, None])
def test_nearest_peer_of_any_size(spark, seed, factor):
    import math

    r = random.Random(seed)
    sizes = [10 ** r.uniform(0, 12) for _ in range(25)]  # some repeated, none half-way between two others
    rows = [(i, r.choice("abcdef"), r.randrange(4), r.choice(sizes)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, e string, at int, size double")
    got = {x["event_id"]: (x["peer"], round(x["distance"], 9)) for x in nearest_peer(df, df, event_id="id", entity="e", at="at", size="size", factor=factor).collect()}
    want = {}
    for i, e, at, s in rows:
        others = [(round(abs(math.log(s) - math.log(t)), 9), f) for _, f, day, t in rows if day == at and f != e]
        near = min(((d, f) for d, f in others if factor is None or d <= math.log(factor) + 1e-12), default=None)
        if near:
            want[i] = (near[1], near[0])
    assert got == want


def test_mistyped_years_and_given_bounds(spark):
    """Days far outside meet their intervals too, and bounds given beforehand change nothing."""
    d = dt.date
    ev = [(1, "a", d(2024, 1, 5)), (2, "a", d(1, 1, 1)), (3, "a", d(9999, 12, 31)), (4, "a", d(1850, 5, 5)), (5, None, d(2024, 1, 5)), (6, "a", None), (7, "a", d(2024, 3, 1))]
    iv = [("a", d(2024, 1, 1), d(2024, 2, 1), "x"), ("a", d(2024, 2, 1), None, "y"), ("a", d(1, 1, 1), d(1900, 1, 1), "z"), ("a", d(2024, 5, 1), d(2024, 5, 1), "empty"), (None, d(2024, 1, 1), None, "n")]
    e, i = spark.createDataFrame(ev, "id int, k string, at date"), spark.createDataFrame(iv, "k string, s date, e date, v string")
    want = {(1, "x"), (7, "y"), (2, "z"), (4, "z"), (3, "y")}
    for bounds in (None, (d(2024, 1, 1), d(2024, 1, 31)), (d(2023, 1, 1), d(2025, 1, 1))):
        assert {(x["id"], x["v"]) for x in bucketed_interval_join(e, i, "k", "at", "s", "e", bounds=bounds).collect()} == want
        left = bucketed_interval_join(e, i, "k", "at", "s", "e", how="left", bounds=bounds).collect()
        assert {x["id"] for x in left if x["v"] is None} == {5, 6} and len(left) == 7
    assert bucketed_interval_join(e.where("id > 99"), i, "k", "at", "s", "e").count() == 0


def test_seeded_sample(spark):
    df = spark.range(1000)
    a = {x["id"] for x in seeded_sample(df, "id", 50, 3).collect()}
    assert a == {x["id"] for x in seeded_sample(df.repartition(7), "id", 50, 3).collect()} and len(a) == 50
    assert a != {x["id"] for x in seeded_sample(df, "id", 50, 4).collect()}


@pytest.mark.parametrize("seed", range(2))
def test_uniform_prices(spark, tmp_path, seed):
    """Against the query's SQL on invented filings that do form groups."""
    import duckdb

    from kronolit.plans import series

    r, day = random.Random(seed), dt.date(2024, 1, 1)
    rows = [
        (i, r.choice(["a", "b", None]), r.choice([*"pqrst", None]), day + dt.timedelta(days=r.choice([0, 0, 5, 30, 60])), r.choice([1.0, 1.0, 2.5, None]), r.choice(["SEK", None]), r.choice(["Förvärv", "Förvärv", "förvärv ", "Teckning", "Avyttring"]), r.choice(["Aktie", "Aktie", "Teckningsrätt", None]), r.choice(["NASDAQ STOCKHOLM AB", "NASDAQ STOCKHOLM AB", "Utanför handelsplats", None]))
        for i in range(1500)
    ]
    rows += [(5000 + i, "z", p, day, 9.0, "SEK", "Förvärv", "Aktie", "NASDAQ STOCKHOLM AB") for i, p in enumerate("pqr")]
    schema = "row_id long, issuer_key string, name_key string, trade_date date, price double, currency string, nature_raw string, instrument_type_raw string, venue_raw string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/register_txns.parquet")
    df = series.uniform_price_groups(spark, str(tmp_path))
    cols = sorted(df.columns)
    got = sorted(repr(tuple(x[c] for c in cols)) for x in df.collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW register_txns AS SELECT * FROM '{tmp_path}/register_txns.parquet/*.parquet'")
    cur = c.execute(series.SQL["uniform_price_groups"])
    at = [[x[0] for x in cur.description].index(k) for k in cols]
    assert got == sorted(repr(tuple(x[i] for i in at)) for x in cur.fetchall()) and len(got) > 5
    assert {x["structural"] for x in df.collect()} == {True, False}
