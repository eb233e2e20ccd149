"""Links of amendments: least scores, and ties that link nothing."""

import datetime as dt

from pyspark.sql import functions as F

from kronolit.operators.bitemporal import link_revisions
from kronolit.plans import register

SCHEMA = "row_id long, k string, published timestamp_ntz, am boolean, volume double, venue string"
T = lambda n: dt.datetime(2020, 3, n)


def links(spark, rows, least=None):
    df = spark.createDataFrame(rows, SCHEMA)
    got = link_revisions(df, ["k"], "published", "am", "row_id", {"volume": 2.0, "venue": 1.0}, least)
    return {r["row_id"]: (r["linked_to"], r["score"], r["ambiguous"]) for r in got.collect()}


def test_below_the_least_score_takes_nothing(spark):
    rows = [(1, "a", T(1), False, 10.0, "x"), (2, "a", T(2), True, 99.0, "x"), (3, "a", T(3), True, 10.0, "x")]
    assert links(spark, rows, F.lit(2.0)) == {2: (None, 0.0, False), 3: (1, 3.0, False)}


def test_least_score_is_of_the_row_replaced(spark):
    rows = [(1, "a", T(1), False, 10.0, "y"), (2, "a", T(2), False, 10.0, "z"), (3, "a", T(3), True, 10.0, "x")]
    assert links(spark, rows, F.when(F.col("row_id") == 2, 3.0).otherwise(2.0)) == {3: (1, 2.0, False)}


def test_full_tie_takes_nothing(spark):
    rows = [(1, "a", T(1), False, 10.0, "x"), (2, "a", T(1), False, 10.0, "x"), (3, "a", T(2), True, 10.0, "x"), (4, "b", T(1), False, 10.0, "x"), (5, "b", T(2), False, 10.0, "x"), (6, "b", T(3), True, 10.0, "x")]
    assert links(spark, rows) == {3: (None, 3.0, True), 6: (5, 3.0, True)}


def test_query(spark, data):
    tx = spark.read.parquet(f"{data}/register_txns.parquet").select("row_id", "status_raw")
    got = register.revision_links(spark, data).where("linked_to is not null")
    assert got.count() > 0 and got.groupBy("linked_to").count().where("count > 1").count() == 0
    low = got.join(tx, got["linked_to"] == tx["row_id"]).where("score < 2 or (score < 5 and status_raw in ('Aktuell', 'Current'))")
    assert low.count() == 0
