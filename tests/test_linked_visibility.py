"""Visibility that ends only the filing which an amendment replaces."""

import datetime as dt

from pyspark.sql import functions as F

from kronolit.operators.bitemporal import with_linked_visibility
from kronolit.plans import register

T = lambda n: dt.datetime(2020, 3, n)


def seen(spark, rows, **kw):
    df = spark.createDataFrame(rows, "row_id long, issuer string, name string, published timestamp_ntz, am boolean, volume double, status string")
    got = with_linked_visibility(df, ["issuer", "name"], "published", "am", "row_id", {"volume": 2.0}, F.lit(2.0), F.col("status") == "R", ["issuer", "name"], **kw)
    return {r["row_id"]: (r["visible_from"], r["visible_until"]) for r in got.collect()}


def test_other_filings_of_the_day_stay(spark):
    rows = [(1, "a", "p", T(1), False, 10.0, "A"), (2, "a", "p", T(1), False, 20.0, "A"), (3, "a", "p", T(1), False, 30.0, "A"), (4, "a", "p", T(5), True, 20.0, "A"), (5, "a", "p", T(7), True, 20.0, "A"), (6, "a", "p", None, False, 20.0, "A")]
    assert seen(spark, rows) == {1: (T(1), None), 2: (T(1), T(5)), 3: (T(1), None), 4: (T(5), T(7)), 5: (T(7), None), 6: (None, None)}
    assert seen(spark, rows, first_publication=True) == {1: (T(1), None), 2: (T(1), T(5)), 3: (T(1), None), 4: (T(1), T(7)), 5: (T(1), None), 6: (None, None)}


def test_revised_rows_without_a_link(spark):
    rows = [(1, "a", "p", T(2), False, 10.0, "R"), (2, "a", "p", T(2), True, 11.0, "A"), (3, "a", "p", T(4), True, 12.0, "A"), (4, "a", None, T(2), False, 10.0, "R"), (5, "a", None, T(4), True, 12.0, "A"), (6, "b", "p", T(2), False, 10.0, "R")]
    assert seen(spark, rows) == {1: (T(2), T(4)), 2: (T(2), None), 3: (T(4), None), 4: (T(2), T(2)), 5: (T(4), None), 6: (T(2), T(2))}


def test_query_keeps_what_no_amendment_replaces(spark, data):
    links = register.revision_links(spark, data).where("linked_to is not null").select("linked_to")
    tx = spark.read.parquet(f"{data}/register_txns.parquet").where(f"published_at <= timestamp_ntz '{register.AS_OF}'")
    free = tx.where("status_raw = 'Aktuell'").join(links, F.col("row_id") == F.col("linked_to"), "left_anti").select("row_id")
    gone = free.join(register.linked_as_seen(spark, data), "row_id", "left_anti")
    assert gone.count() == 0
    assert free.join(register.visible_as_seen(spark, data), "row_id", "left_anti").count() > 0
    assert register.linked_first_publications(spark, data).count() > 0 and register.linked_pit_events(spark, data).count() > 0 and register.linked_quiet_issuers(spark, data).columns == ["issuer_key"]
