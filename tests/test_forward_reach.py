"""The forward as-of join finds what is far ahead."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kronolit.operators.asof import asof_forward
from kronolit.plans import register


@pytest.mark.parametrize("strict", [False, True])
def test_more_than_a_year_ahead(spark, strict):
    d = dt.date
    left = spark.createDataFrame([(1, "a", d(2001, 1, 1)), (2, "a", d(2020, 1, 1)), (3, "a", d(2023, 1, 1)), (4, "a", d(2023, 1, 2)), (5, "b", d(2001, 1, 1))], "i int, k string, d date")
    right = spark.createDataFrame([("a", d(2020, 1, 1), 1.0), ("a", d(2023, 1, 1), 2.0)], "k string, t date, v double")
    got = {r["i"]: r["v"] for r in asof_forward(left, right, key="k", left_on="d", right_on="t", values=["v"], strict=strict).collect()}
    assert got == ({1: 1.0, 2: 2.0, 3: None, 4: None, 5: None} if strict else {1: 1.0, 2: 1.0, 3: 2.0, 4: None, 5: None})


def test_query(spark, data):
    t = spark.read.parquet(f"{data}/register_txns.parquet").select("row_id", "issuer_key", "is_amendment", F.to_date("published_at").alias("day"))
    rows = t.collect()
    days = {}
    for r in rows:
        if r["is_amendment"] and r["issuer_key"] and r["day"]:
            days.setdefault(r["issuer_key"], set()).add(r["day"])
    want = {r["row_id"]: min((x for x in days.get(r["issuer_key"], ()) if r["day"] and x > r["day"]), default=None) for r in rows}
    assert {r["row_id"]: r["amended"] for r in register.next_amendment_any(spark, data).collect()} == want
