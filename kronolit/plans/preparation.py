"""Queries of the general data-preparation problems (1, 3, 5, 6) over the register tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kronolit.operators.changes import newest_first
from kronolit.operators.errorparse import parse_register
from kronolit.operators.intervals import as_known_at, hindsight_cases
from kronolit.operators.units import mcap_units, price_units
from kronolit.session import table

PIT = {"event_id": "row_id", "key": "issuer_key", "at": "trade_date", "known_by": "published_at"}


def p1_prices(spark: SparkSession, d: str) -> DataFrame:
    return price_units(table(spark, d, "register_txns"), table(spark, d, "mcap_points"), table(spark, d, "fx_rates")).select(F.col("id").alias("row_id"), "value", "day", "unit", "sek")


def p1_mcaps(spark: SparkSession, d: str) -> DataFrame:
    return mcap_units(table(spark, d, "mcap_points"), table(spark, d, "fx_rates")).select(F.col("id").alias("point_id"), "value", "day", "unit", "sek")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    fx, points = table(spark, d, "fx_rates"), table(spark, d, "mcap_points")
    both = price_units(table(spark, d, "register_txns"), points, fx).unionByName(mcap_units(points, fx))
    return both.where(F.col("unit") != "SEK").select("kind", F.col("id").alias("row_id"), "unit")


def p3_rows(spark: SparkSession, d: str) -> DataFrame:
    return parse_register(table(spark, d, "raw_register")).withColumnRenamed("id", "line_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_rows(spark, d).select("line_id", F.explode("reasons").alias("reason"))


def p5_asof(spark: SparkSession, d: str) -> DataFrame:
    """Every filing with its version and that version's attributes; incomplete filings and those without a version have nulls."""
    v = table(spark, d, "issuer_attrs").groupBy("version_id").agg(*[F.min(c).alias(c) for c in ("valid_from", "known_at", "market_segment", "size_band", "shares_out")])
    got = as_known_at(table(spark, d, "register_txns"), table(spark, d, "issuer_attrs"), **PIT)
    return got.withColumnRenamed("event_id", "row_id").drop("hindsight_id").join(v, "version_id", "left")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return hindsight_cases(table(spark, d, "register_txns"), table(spark, d, "issuer_attrs"), **PIT).withColumnRenamed("event_id", "row_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return newest_first(table(spark, d, "register_feed"), key="record_id", order=["published_at", "seq"], delivery="feed_id", op="op")


def p6_state(spark: SparkSession, d: str) -> DataFrame:
    """The rebuilt table: each record with the content it last received."""
    f = table(spark, d, "register_feed").drop("record_id", "op", "seq")
    return p6_found(spark, d).join(f, "feed_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_prices, p1_mcaps, p3_found, p3_rows, p5_found, p5_asof, p6_found, p6_state)}

_RANKED = """
WITH v AS (SELECT issuer_key, valid_from, known_at, version_id FROM issuer_attrs WHERE known_at IS NOT NULL AND valid_from IS NOT NULL),
c AS (SELECT t.row_id, v.version_id,
        row_number() OVER (PARTITION BY t.row_id ORDER BY v.valid_from DESC, v.known_at DESC, v.version_id DESC) AS hind,
        row_number() OVER (PARTITION BY t.row_id ORDER BY CASE WHEN v.known_at <= t.published_at THEN 0 ELSE 1 END, v.valid_from DESC, v.known_at DESC, v.version_id DESC) AS fore,
        v.known_at <= t.published_at AS known
      FROM register_txns t JOIN v ON v.issuer_key = t.issuer_key AND v.valid_from <= t.trade_date WHERE t.published_at IS NOT NULL),
b AS (SELECT row_id, coalesce(max(CASE WHEN fore = 1 AND known THEN version_id END), 0) AS version_id, max(CASE WHEN hind = 1 THEN version_id END) AS hindsight_id FROM c GROUP BY row_id)
"""
_STATE = """
WITH f AS (SELECT record_id, published_at, seq, max(feed_id) AS feed_id, max_by(op, feed_id) AS op FROM register_feed GROUP BY record_id, published_at, seq),
r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY published_at DESC, seq DESC) AS n,
        row_number() OVER (PARTITION BY record_id, op = 'U' ORDER BY published_at DESC, seq DESC) AS m FROM f),
k AS (SELECT record_id, max(CASE WHEN n = 1 THEN feed_id END) AS feed_id FROM r GROUP BY record_id HAVING max(CASE WHEN m = 1 AND op <> 'U' THEN op END) = 'I')
"""
# A line as the rules have it: fields that begin with a quote end at its closing one, all others at the next separator.
_FIELD = '("([^"]|"")*"|[^";][^;]*)?'
_BLANKS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{2007}\x{202F}]+"
_STAMP = "([0-9]{4}-[0-9]{2}-[0-9]{2})( ([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9])?"


def _trimmed(field: str) -> str:
    return f"regexp_replace(regexp_replace({field}, '^{_BLANKS}', ''), '{_BLANKS}$', '')"


def _stamped(value: str) -> str:
    return f"(regexp_full_match({value}, '{_STAMP}') AND NOT starts_with({value}, '0000') AND try_cast(substr({value}, 1, 10) AS DATE) IS NOT NULL)"


_LINES = f"""
WITH l AS (SELECT line_id, raw_line, regexp_full_match(raw_line, '{_FIELD}(;{_FIELD})*') AS shut, regexp_extract_all(';' || raw_line, ';{_FIELD}') AS parts FROM raw_register WHERE raw_line IS NOT NULL),
f AS (SELECT line_id, shut, [CASE WHEN starts_with(x, ';"') THEN replace(substr(x, 3, length(x) - 3), '""', '"') ELSE substr(x, 2) END for x in parts] AS v FROM l),
g AS (SELECT line_id, shut, CASE WHEN len(v) = 23 AND {_trimmed("v[23]")} = '' THEN v[1:22] ELSE v END AS v FROM f),
t AS (SELECT line_id, CASE WHEN shut IS NOT TRUE THEN 'quoting' WHEN len(v) <> 22 THEN 'column_count' END AS broken, {_trimmed("v[1]")} AS p, {_trimmed("v[16]")} AS d, {_trimmed("v[22]")} AS s, v FROM g)
"""
_REASONS = f"""SELECT line_id, broken AS reason FROM t WHERE broken IS NOT NULL
UNION ALL SELECT line_id, 'published' FROM t WHERE broken IS NULL AND NOT {_stamped("p")}
UNION ALL SELECT line_id, 'trade_date' FROM t WHERE broken IS NULL AND d <> '' AND NOT {_stamped("d")}
UNION ALL SELECT line_id, 'status' FROM t WHERE broken IS NULL AND s NOT IN ('Aktuell', 'Reviderad', 'Makulerad', 'Current', 'Revised')
UNION ALL SELECT line_id, 'column_count' FROM raw_register WHERE raw_line IS NULL"""
SQL = {
    "p3_found": _LINES + _REASONS,
    "p5_found": _RANKED + "SELECT row_id, version_id FROM b WHERE version_id <> hindsight_id",
    "p5_asof": _RANKED + """SELECT CASE WHEN t.issuer_key IS NOT NULL AND t.trade_date IS NOT NULL AND t.published_at IS NOT NULL THEN coalesce(b.version_id, 0) END AS version_id, t.row_id,
        a.valid_from, a.known_at, a.market_segment, a.size_band, a.shares_out
        FROM register_txns t LEFT JOIN b ON b.row_id = t.row_id LEFT JOIN issuer_attrs a ON a.version_id = b.version_id""",
    "p6_found": _STATE + "SELECT record_id, feed_id FROM k",
    "p6_state": _STATE + "SELECT k.feed_id, k.record_id, f.published_at, f.is_amendment, f.status_raw, f.issuer_key, f.pdmr_name, f.trade_date, f.volume, f.price, f.arrived_at FROM k JOIN register_feed f ON f.feed_id = k.feed_id",
}
