"""Queries of the general operators over the register tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kronolit.functions.parsing import ENTITY_PARTS, ENTITY_WORDS, ascii_fold, is_entity, isin_valid, lei_valid, name_key
from kronolit.operators import relational as rel
from kronolit.operators.asof import asof_backward, asof_forward, band_exists, nearest_peer
from kronolit.operators.bitemporal import Register, link_revisions, with_linked_visibility, with_visibility
from kronolit.operators.returns import event_returns, period_returns
from kronolit.operators.sequence import cooldown, detect_episodes, factor_after, occurrence_ids, replace_window, window_distinct
from kronolit.operators.stats import bootstrap_interval, calendar_time, t_clustered, t_iid, t_two_way
from kronolit.session import table
from kronolit.sources.register import canonical_rows

KEYS = ["issuer_key", "name_key", "trade_date"]
LINK_WEIGHTS = {"isin": 3.0, "instrument_name": 2.0, "nature_raw": 2.0, "volume": 2.0, "price": 2.0, "venue_raw": 1.0, "role_raw": 0.5, "notifier_name": 0.5}
AS_OF = "2025-06-30 12:00:00"
FILING = ["issuer_key", "pdmr_name", "trade_date", "nature_raw", "instrument_name", "volume", "price", "published_at"]


def _txns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "register_txns")


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- profiles ---------------------------------------------------------------------------------------------------------
def crosstab_source_status(spark: SparkSession, d: str) -> DataFrame:
    return rel.crosstab_totals(_txns(spark, d), F.col("source"), F.col("status_raw"))


def lag_quantiles(spark: SparkSession, d: str) -> DataFrame:
    q = rel.group_quantiles(_txns(spark, d).where("published_at is not null"), F.year("published_at").cast("long"), F.datediff("published_at", "trade_date"), {"p50": 0.5, "p90": 0.9, "p99": 0.99}, "year")
    return _rounded(q)


def issuers_top_others(spark: SparkSession, d: str) -> DataFrame:
    return rel.top_and_others(_txns(spark, d), "issuer_key", 10)


def venue_frequency(spark: SparkSession, d: str) -> DataFrame:
    return _txns(spark, d).groupBy(F.coalesce("venue_raw", F.lit("(none)")).alias("venue")).agg(F.count("*").alias("n"))


def repeated_filings(spark: SparkSession, d: str) -> DataFrame:
    return rel.repeated_rows(_txns(spark, d), FILING)


def publication_gaps(spark: SparkSession, d: str) -> DataFrame:
    return rel.day_gaps(_txns(spark, d), F.col("published_at"))


def lei_by_isin(spark: SparkSession, d: str) -> DataFrame:
    return rel.only_value(_txns(spark, d).where("isin is not null"), "isin", "issuer_lei", "lei")


def currency_by_issuer(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(rel.most_frequent(_txns(spark, d), "issuer_key", "currency", "currency"))


def type_by_isin(spark: SparkSession, d: str) -> DataFrame:
    """The type that nine tenths of an ISIN's typed rows agree on, else null."""
    m = rel.most_frequent(_txns(spark, d).where("isin is not null and instrument_type_raw != ''"), "isin", "instrument_type_raw", "t")
    return m.select("isin", F.when(F.col("share") >= 0.9, F.col("t")).alias("instrument_type"), "n_values")


def issuers_with_many_isins(spark: SparkSession, d: str) -> DataFrame:
    return _txns(spark, d).where("issuer_key is not null").groupBy("issuer_key").agg(F.count_distinct("isin").alias("n_isins")).where("n_isins >= 2")


def issuers_without_points(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "mcap_points").where("mcap_sek is not null and reason = 'OK'")
    return table(spark, d, "issuers").join(p, "issuer_key", "left_anti").select("issuer_key")


def issuers_in_feed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "issuers").join(table(spark, d, "register_feed"), "issuer_key", "left_semi").select("issuer_key", "issuer_name")


def issuer_backfill(spark: SparkSession, d: str) -> DataFrame:
    """The LEI of a row, else the only one of its ISIN, else the only one of its issuer name, else the name."""
    t = _txns(spark, d)
    by_isin = rel.only_value(t.where("isin is not null"), "isin", "issuer_lei", "_li")
    by_name = rel.only_value(t.where("issuer_name_raw is not null"), "issuer_name_raw", "issuer_lei", "_ln")
    j = t.select("row_id", "issuer_lei", "isin", "issuer_name_raw").join(by_isin, "isin", "left").join(by_name, "issuer_name_raw", "left")
    return j.select("row_id", F.coalesce("issuer_lei", "_li", "_ln", F.concat(F.lit("name:"), F.lower("issuer_name_raw"))).alias("key"))


# --- identity and refresh ---------------------------------------------------------------------------------------------
def raw_occurrence_ids(spark: SparkSession, d: str) -> DataFrame:
    return occurrence_ids(table(spark, d, "raw_register"), ["raw_line"], ["line_id"]).select("line_id", "record_id")


def refreshed_register(spark: SparkSession, d: str) -> DataFrame:
    t = _txns(spark, d)
    return replace_window(t.where("source = 'bulk'"), t.where("source = 'fi_export'"), "published_at", "2025-01-01", "2025-07-01", ["record_id"], "row_id").select("row_id", "record_id", "source")


def isin_checks(spark: SparkSession, d: str) -> DataFrame:
    return _txns(spark, d).select("row_id", isin_valid(F.col("isin")).alias("valid"))


def lei_checks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "issuers").select("issuer_key", lei_valid(F.col("issuer_lei")).alias("valid"))


def person_keys(spark: SparkSession, d: str) -> DataFrame:
    """Name keys and their ASCII forms, each distinct name mapped once."""
    n = table(spark, d, "person_names").select("full_name").distinct().select("full_name", name_key(F.col("full_name")).alias("name_key"))
    return n.select("full_name", "name_key", ascii_fold(F.col("name_key")).alias("ascii_key"), is_entity(F.col("name_key")).alias("is_entity"))


def canonical_register(spark: SparkSession, d: str) -> DataFrame:
    return canonical_rows(table(spark, d, "raw_register"))[0].withColumnRenamed("id", "line_id")


# --- joins ------------------------------------------------------------------------------------------------------------
def fx_asof(spark: SparkSession, d: str) -> DataFrame:
    t = _txns(spark, d).select("row_id", F.upper(F.trim("currency")).alias("currency"), "trade_date")
    return asof_backward(t, table(spark, d, "fx_rates"), key="currency", left_on="trade_date", right_on="fx_date", values=["rate"], max_age=7).select("row_id", "rate", F.col("fx_date_matched").alias("fx_date"))


def shares_asof(spark: SparkSession, d: str) -> DataFrame:
    """The last share count published 30 days or more before the trade."""
    p = table(spark, d, "mcap_points").where("shares is not null")
    return asof_backward(_txns(spark, d).select("row_id", "issuer_key", "trade_date"), p, key="issuer_key", left_on="trade_date", right_on="as_of_day", values=["shares"], lag=30).select("row_id", "shares", F.col("as_of_day_matched").alias("as_of_day"))


def next_amendment(spark: SparkSession, d: str) -> DataFrame:
    """The first day after a filing on which its issuer published an amendment, within a year as its SQL has it."""
    return _next_amendment(spark, d, 366)


def next_amendment_any(spark: SparkSession, d: str) -> DataFrame:
    """The first day after a filing on which its issuer published an amendment, however far ahead."""
    return _next_amendment(spark, d, None)


def _next_amendment(spark: SparkSession, d: str, max_ahead: int | None) -> DataFrame:
    t = _txns(spark, d).withColumn("day", F.to_date("published_at"))
    a = t.where("is_amendment").groupBy("issuer_key", "day").agg(F.count("*").alias("n")).withColumnRenamed("day", "amended")
    return asof_forward(t.select("row_id", "issuer_key", "day"), a, key="issuer_key", left_on="day", right_on="amended", values=["n"], strict=True, max_ahead=max_ahead).select("row_id", F.col("amended_matched").alias("amended"), "n")


def issue_at_price(spark: SparkSession, d: str) -> DataFrame:
    """Whether a subscription of the issuer at the very price stands within 20 days of a trade."""
    t = _txns(spark, d)
    s = t.where("nature_raw in ('Teckning', 'Subscription')")
    return band_exists(t.select("row_id", "issuer_key", "price", "trade_date"), s, keys=["issuer_key", "price"], left_on="trade_date", right_on="trade_date", days=20).select("row_id", "found")


def mcap_peers(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "mcap_points")
    return _rounded(nearest_peer(p, p, event_id="point_id", entity="issuer_key", at="as_of_day", size="mcap_sek"), 9)


# --- sequences --------------------------------------------------------------------------------------------------------
def cooled_publications(spark: SparkSession, d: str) -> DataFrame:
    return cooldown(_txns(spark, d).select("issuer_key", F.to_date("published_at").alias("day")), "issuer_key", "day", 126)


def crowded_windows(spark: SparkSession, d: str) -> DataFrame:
    return window_distinct(_txns(spark, d), "issuer_key", "name_key", "trade_date", 30, 3)


def crowd_episodes(spark: SparkSession, d: str) -> DataFrame:
    return detect_episodes(_txns(spark, d), "issuer_key", "name_key", "trade_date", "published_at", end="last")


def _least_score() -> Column:
    """A row that still stands as current asks for more than one marked as revised (5 and 2)."""
    return F.when(F.col("status_raw").isin("Aktuell", "Current"), 5.0).otherwise(2.0)


def revision_links(spark: SparkSession, d: str) -> DataFrame:
    return link_revisions(_txns(spark, d), KEYS, "published_at", "is_amendment", "row_id", LINK_WEIGHTS, _least_score(), needed=("issuer_key", "name_key"))


def _splits(points: DataFrame) -> DataFrame:
    """Share counts that grew by half or more from one point of an issuer to the next."""
    p = points.where("shares > 0").groupBy("issuer_key", "as_of_day").agg(F.max("shares").alias("shares"))
    prev = F.lag("shares").over(Window.partitionBy("issuer_key").orderBy("as_of_day"))
    return p.select("issuer_key", "as_of_day", (F.col("shares") / prev).alias("ratio")).where("ratio >= 1.5 or ratio <= 0.6")


def split_factors(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "mcap_points")
    return _rounded(factor_after(p.select("point_id", "issuer_key", "as_of_day"), _splits(p), "issuer_key", "as_of_day", "ratio").select("point_id", "factor"))


# --- point in time ----------------------------------------------------------------------------------------------------
def _register(spark: SparkSession, d: str, first: bool = False) -> Register:
    return Register(with_visibility(_txns(spark, d), KEYS, "published_at", "is_amendment", "row_id", first))


def visible_as_seen(spark: SparkSession, d: str) -> DataFrame:
    return _register(spark, d).visible(F.lit(AS_OF).cast("timestamp_ntz")).select("row_id", "issuer_key", "visible_until")


def visible_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """What stands today of the filings published by then."""
    t = _txns(spark, d).where("status_raw in ('Aktuell', 'Current')").withColumn("visible_from", F.col("published_at")).withColumn("visible_until", F.lit(None).cast("timestamp_ntz"))
    return Register(t).visible(F.lit(AS_OF).cast("timestamp_ntz"), F.lit("2024-07-01").cast("date")).select("row_id", "issuer_key")


def first_publications(spark: SparkSession, d: str) -> DataFrame:
    return _register(spark, d, True).visible(F.lit(AS_OF).cast("timestamp_ntz")).select("row_id", "visible_from")


def pit_events(spark: SparkSession, d: str) -> DataFrame:
    """Each issuer's publication days with what was visible of the last year's trades at the end of that day."""
    return _pit_events(_register(spark, d))


def _pit_events(r: Register) -> DataFrame:
    days = r.rows.select("issuer_key", F.to_date("published_at").alias("event_day"))
    return _rounded(r.daily_for(days, "event_day", 365, {"volume": "volume"}), 2)


def quiet_issuers(spark: SparkSession, d: str) -> DataFrame:
    return _quiet_issuers(spark, d, _register(spark, d))


def _quiet_issuers(spark: SparkSession, d: str, r: Register) -> DataFrame:
    seen = r.visible(F.lit(AS_OF).cast("timestamp_ntz"), F.lit("2025-06-20").cast("date"))
    return table(spark, d, "issuers").join(seen, "issuer_key", "left_anti").select("issuer_key")


# The four above end every earlier filing of a key with its next amendment, as their SQL does; these end only the filing replaced.
def _linked_register(spark: SparkSession, d: str, first: bool = False) -> Register:
    cancelled = F.coalesce(F.col("status_raw").isin("Makulerad", "Cancelled"), F.lit(False))
    t = _txns(spark, d).withColumn("_amends", F.col("is_amendment") & ~cancelled)
    least = F.when(cancelled, float("inf")).otherwise(_least_score())
    return Register(with_linked_visibility(t, KEYS, "published_at", "_amends", "row_id", LINK_WEIGHTS, least, F.col("status_raw").isin("Reviderad", "Revised"), KEYS[:2], first, needed=("issuer_key", "name_key")))


def linked_as_seen(spark: SparkSession, d: str) -> DataFrame:
    return _linked_register(spark, d).visible(F.lit(AS_OF).cast("timestamp_ntz")).select("row_id", "issuer_key", "visible_until")


def linked_first_publications(spark: SparkSession, d: str) -> DataFrame:
    return _linked_register(spark, d, True).visible(F.lit(AS_OF).cast("timestamp_ntz")).select("row_id", "visible_from")


def linked_pit_events(spark: SparkSession, d: str) -> DataFrame:
    return _pit_events(_linked_register(spark, d))


def linked_quiet_issuers(spark: SparkSession, d: str) -> DataFrame:
    return _quiet_issuers(spark, d, _linked_register(spark, d))


# --- event study ------------------------------------------------------------------------------------------------------
def _returns(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "mcap_points").where("price_used > 0").select("issuer_key", F.col("as_of_day").alias("day"), F.col("price_used").alias("close"))
    bench = p.groupBy("day").agg(F.avg("close").alias("close"))
    ev = cooled_publications(spark, d).withColumn("event_id", F.concat_ws("|", "issuer_key", "day"))
    return event_returns(ev, p, bench, event_id="event_id", key="issuer_key", event_day="day", day="day", close="close", bench_day="day")


def event_return_status(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_returns(spark, d))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    r = _returns(spark, d).where("status = 'OK'")
    part = F.split("event_id", r"\|")
    return r.select("event_id", F.concat(F.lit("h"), F.col("horizon")).alias("cell"), "excess", part[0].alias("issuer"), F.substring(part[1], 1, 7).alias("month"))


def excess_iid(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(t_iid(_cells(spark, d), "cell", "excess"))


def excess_clustered(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(t_clustered(_cells(spark, d), "cell", "excess", "month"))


def excess_two_way(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(t_two_way(_cells(spark, d), "cell", "excess", "issuer", "month"))


def excess_calendar_time(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(calendar_time(_cells(spark, d), "cell", "excess", "month"))


def excess_summary(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d).groupBy("cell").agg(F.count("*").alias("n"), F.avg("excess").alias("mean"), F.median("excess").alias("median"), F.avg((F.col("excess") > 0).cast("double")).alias("share_positive"), F.count_distinct("issuer").alias("n_issuers"))
    return _rounded(c)


def excess_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return bootstrap_interval(_cells(spark, d), "cell", "excess", "event_id", draws=200)


def monthly_returns(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(period_returns(table(spark, d, "mcap_points"), "issuer_key", "as_of_day", "price_used"))


QUERIES = {
    f.__name__: f
    for f in (
        crosstab_source_status, lag_quantiles, issuers_top_others, venue_frequency, repeated_filings, publication_gaps, lei_by_isin, currency_by_issuer, type_by_isin, issuers_with_many_isins, issuers_without_points,
        issuers_in_feed, issuer_backfill, raw_occurrence_ids, refreshed_register, isin_checks, lei_checks, person_keys, canonical_register, fx_asof, shares_asof, next_amendment, next_amendment_any, issue_at_price, mcap_peers, cooled_publications,
        crowded_windows, crowd_episodes, revision_links, split_factors, visible_as_seen, visible_snapshot, first_publications, pit_events, quiet_issuers, linked_as_seen, linked_first_publications, linked_pit_events, linked_quiet_issuers, event_return_status, excess_iid, excess_clustered, excess_two_way,
        excess_calendar_time, excess_summary, excess_bootstrap, monthly_returns,
    )
}

_VISIBLE = """
WITH r AS (SELECT *, min(CASE WHEN is_amendment THEN published_at END) OVER (PARTITION BY issuer_key, name_key, trade_date ORDER BY published_at, row_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS visible_until,
    CASE WHEN published_at IS NOT NULL THEN min(published_at) OVER (PARTITION BY issuer_key, name_key, trade_date) END AS first_published FROM register_txns)
"""
_COOLED = """
WITH RECURSIVE days AS (SELECT DISTINCT issuer_key, CAST(published_at AS DATE) AS day FROM register_txns WHERE published_at IS NOT NULL),
kept AS (SELECT issuer_key, min(day) AS day FROM days GROUP BY issuer_key
    UNION ALL
    SELECT k.issuer_key, (SELECT min(d.day) FROM days d WHERE d.issuer_key IS NOT DISTINCT FROM k.issuer_key AND d.day > k.day + 126) AS day FROM kept k WHERE k.day IS NOT NULL)
"""
_RETURNS = (
    _COOLED
    + """,
p AS (SELECT issuer_key, as_of_day AS day, max(price_used) AS c FROM mcap_points WHERE price_used > 0 GROUP BY ALL),
pa AS (SELECT issuer_key, as_of_day AS day, price_used AS c FROM mcap_points WHERE price_used > 0),
cal AS (SELECT row_number() OVER (ORDER BY day) - 1 AS n, day, bench FROM (SELECT day, avg(c) AS bench FROM pa GROUP BY day)),
e AS (SELECT issuer_key, day, concat_ws('|', issuer_key, CAST(day AS VARCHAR)) AS event_id FROM kept WHERE day IS NOT NULL),
h AS (SELECT e.*, x.horizon, CASE WHEN e.day >= (SELECT max(day) FROM cal) THEN (SELECT count(*) FROM cal) ELSE (SELECT min(n) FROM cal WHERE cal.day > e.day) END AS i0 FROM e CROSS JOIN (VALUES (1), (3), (6)) x(horizon)),
b AS (SELECT p.issuer_key, cal.n, p.c FROM p JOIN cal ON cal.day = p.day),
q AS (SELECT h.*, (SELECT min(n) FROM b WHERE b.issuer_key = h.issuer_key AND b.n BETWEEN h.i0 AND h.i0 + 1) AS n0,
    (SELECT max(n) FROM b WHERE b.issuer_key = h.issuer_key AND b.n BETWEEN h.i0 + h.horizon - 1 AND h.i0 + h.horizon) AS n1,
    EXISTS (SELECT 1 FROM p WHERE p.issuer_key = h.issuer_key) AS known FROM h),
v AS (SELECT q.*, b1.c / b0.c - 1 AS r, c1.bench / c0.bench - 1 AS m FROM q LEFT JOIN b b0 ON b0.issuer_key = q.issuer_key AND b0.n = q.n0 LEFT JOIN b b1 ON b1.issuer_key = q.issuer_key AND b1.n = q.n1
    LEFT JOIN cal c0 ON c0.n = q.n0 LEFT JOIN cal c1 ON c1.n = q.i0 + q.horizon),
s AS (SELECT *, CASE WHEN i0 IS NULL OR i0 + horizon > (SELECT max(n) FROM cal) THEN 'TOO_RECENT' WHEN NOT known THEN 'NO_HISTORY' WHEN n0 IS NULL THEN 'NO_ENTRY_BAR'
    WHEN n1 IS NULL OR n1 <= n0 THEN 'ENDED_IN_WINDOW' WHEN abs(r) > 5 THEN 'ARTEFACT' ELSE 'OK' END AS status FROM v),
x AS (SELECT event_id, 'h' || CAST(horizon AS VARCHAR) AS cell, r - m AS x, split_part(event_id, '|', 1) AS issuer, substr(split_part(event_id, '|', 2), 1, 7) AS month FROM s WHERE status = 'OK')
"""
)


def _variance(by: str, name: str) -> str:
    """CTE of the clustered variance of the mean, straight from its definition over the errors."""
    return f"""{name} AS (SELECT cell, count(*) AS g, CASE WHEN count(*) > 1 THEN sum(se * se) / (max(n) * max(n)) * count(*) / (count(*) - 1) END AS v FROM
    (SELECT x.cell, sum(x.x - mu.m) AS se, max(mu.n) AS n FROM x JOIN mu ON mu.cell = x.cell GROUP BY x.cell, {by}) GROUP BY cell)"""


_MU = ", mu AS (SELECT cell, count(*) AS n, avg(x) AS m FROM x GROUP BY cell), "
_POWER = "(1.959964 + 0.841621)"


def _iid(source: str) -> str:
    return f"""SELECT cell, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(CASE WHEN count(*) >= 2 AND stddev_samp(x) > 1e-12 THEN avg(x) / (stddev_samp(x) / sqrt(count(*))) END, 6) AS t,
    round(CASE WHEN count(*) >= 2 AND stddev_samp(x) > 1e-12 THEN {_POWER} * stddev_samp(x) / sqrt(count(*)) END, 6) AS mde FROM {source} GROUP BY cell"""


def _digits(code: str) -> str:
    return f"""string_split(array_to_string(list_transform(string_split({code}, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END), ''), '')"""


# names of the table are in plain characters, so that NFKC changes nothing
_ENTITY = "(" + " OR ".join([f"list_has_any(regexp_split_to_array(lower({{0}}), '[\\s,]+'), [{', '.join(repr(w) for w in ENTITY_WORDS)}])", *[f"contains(lower({{0}}), '{w}')" for w in ENTITY_PARTS]]) + ")"
SQL = {
    "person_keys": f"""WITH n AS (SELECT DISTINCT full_name FROM person_names), t AS (SELECT full_name, trim(regexp_replace(full_name, '\\s+', ' ', 'g')) AS x FROM n),
        k AS (SELECT full_name, replace(lower(CASE WHEN regexp_full_match(x, '[^\\s,]+ ?, ?[^,]*[^,\\s]') AND NOT {_ENTITY.format('x')} THEN regexp_extract(x, ', ?([^,]*[^,\\s])$', 1) || ' ' || regexp_extract(x, '^([^\\s,]+)', 1) ELSE x END), 'ς', 'σ') AS name_key FROM t)
        SELECT full_name, name_key, strip_accents(name_key) AS ascii_key, {_ENTITY.format('name_key')} AS is_entity FROM k""",
    "crosstab_source_status": """SELECT CASE WHEN grouping(r) = 1 THEN '(total)' ELSE r END AS row_value, CASE WHEN grouping(c) = 1 THEN '(total)' ELSE c END AS col_value, count(*) AS n
        FROM (SELECT coalesce(source, '(none)') AS r, coalesce(status_raw, '(none)') AS c FROM register_txns) GROUP BY CUBE (r, c)""",
    "lag_quantiles": """SELECT CAST(year(published_at) AS BIGINT) AS year, count(v) AS n, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.99), 6) AS p99
        FROM (SELECT published_at, CAST(date_diff('day', trade_date, CAST(published_at AS DATE)) AS DOUBLE) AS v FROM register_txns) WHERE published_at IS NOT NULL AND v IS NOT NULL GROUP BY 1""",
    "issuers_top_others": """WITH c AS (SELECT coalesce(issuer_key, '(none)') AS value, count(*) AS n FROM register_txns GROUP BY 1), t AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS k FROM c)
        SELECT CASE WHEN k <= 10 THEN value ELSE '(others)' END AS value, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_values FROM t GROUP BY 1""",
    "venue_frequency": "SELECT coalesce(venue_raw, '(none)') AS venue, count(*) AS n FROM register_txns GROUP BY 1",
    "repeated_filings": f"SELECT copies, count(*) AS n_groups, CAST(sum(copies) AS BIGINT) AS n_rows FROM (SELECT count(*) AS copies FROM register_txns GROUP BY {', '.join(FILING)}) GROUP BY copies",
    "publication_gaps": """SELECT day FROM (SELECT CAST(unnest(generate_series(CAST(min(published_at) AS DATE), CAST(max(published_at) AS DATE), INTERVAL 1 DAY)) AS DATE) AS day FROM register_txns)
        WHERE isodow(day) < 6 EXCEPT SELECT CAST(published_at AS DATE) FROM register_txns""",
    "lei_by_isin": "SELECT isin, CASE WHEN count(DISTINCT issuer_lei) = 1 THEN min(issuer_lei) END AS lei FROM register_txns WHERE isin IS NOT NULL GROUP BY isin",
    "currency_by_issuer": """WITH c AS (SELECT issuer_key, currency, count(*) AS n FROM register_txns WHERE currency IS NOT NULL GROUP BY ALL),
        t AS (SELECT *, row_number() OVER (PARTITION BY issuer_key ORDER BY n DESC, currency) AS k, sum(n) OVER (PARTITION BY issuer_key) AS total, count(*) OVER (PARTITION BY issuer_key) AS n_values FROM c)
        SELECT issuer_key, currency, n, round(CAST(n AS DOUBLE) / total, 6) AS share, n_values FROM t WHERE k = 1""",
    "type_by_isin": """WITH c AS (SELECT isin, instrument_type_raw AS v, count(*) AS n FROM register_txns WHERE isin IS NOT NULL AND instrument_type_raw <> '' GROUP BY ALL),
        t AS (SELECT *, row_number() OVER (PARTITION BY isin ORDER BY n DESC, v) AS k, sum(n) OVER (PARTITION BY isin) AS total, count(*) OVER (PARTITION BY isin) AS n_values FROM c)
        SELECT isin, CASE WHEN CAST(n AS DOUBLE) / total >= 0.9 THEN v END AS instrument_type, n_values FROM t WHERE k = 1""",
    "issuers_with_many_isins": "SELECT issuer_key, count(DISTINCT isin) AS n_isins FROM register_txns WHERE issuer_key IS NOT NULL GROUP BY issuer_key HAVING count(DISTINCT isin) >= 2",
    "issuers_without_points": "SELECT issuer_key FROM issuers i WHERE NOT EXISTS (SELECT 1 FROM mcap_points p WHERE p.issuer_key = i.issuer_key AND p.mcap_sek IS NOT NULL AND p.reason = 'OK')",
    "issuers_in_feed": "SELECT issuer_key, issuer_name FROM issuers i WHERE EXISTS (SELECT 1 FROM register_feed f WHERE f.issuer_key = i.issuer_key)",
    "issuer_backfill": """WITH i AS (SELECT isin, CASE WHEN count(DISTINCT issuer_lei) = 1 THEN min(issuer_lei) END AS lei FROM register_txns WHERE isin IS NOT NULL GROUP BY isin),
        m AS (SELECT issuer_name_raw, CASE WHEN count(DISTINCT issuer_lei) = 1 THEN min(issuer_lei) END AS lei FROM register_txns WHERE issuer_name_raw IS NOT NULL GROUP BY 1)
        SELECT t.row_id, coalesce(t.issuer_lei, i.lei, m.lei, 'name:' || lower(t.issuer_name_raw)) AS key FROM register_txns t LEFT JOIN i ON i.isin = t.isin LEFT JOIN m ON m.issuer_name_raw = t.issuer_name_raw""",
    "raw_occurrence_ids": "SELECT line_id, substr(sha256(coalesce(raw_line, '')), 1, 20) || ':' || CAST(row_number() OVER (PARTITION BY coalesce(raw_line, '') ORDER BY line_id) - 1 AS VARCHAR) AS record_id FROM raw_register",
    "refreshed_register": """WITH b AS (SELECT *, 0 AS k FROM register_txns WHERE source = 'bulk' AND (published_at IS NULL OR published_at < TIMESTAMP '2025-01-01' OR published_at >= TIMESTAMP '2025-07-01')
        UNION ALL SELECT *, 1 AS k FROM register_txns WHERE source = 'fi_export'), r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY k DESC, row_id DESC) AS n FROM b)
        SELECT row_id, record_id, source FROM r WHERE n = 1""",
    "isin_checks": f"""SELECT row_id, CASE WHEN isin IS NULL THEN NULL WHEN NOT regexp_full_match(isin, '[A-Z]{{2}}[A-Z0-9]{{9}}[0-9]') THEN FALSE
        ELSE list_sum(list_transform(list_reverse({_digits("isin")}), lambda d, i: CASE WHEN i % 2 = 1 THEN CAST(d AS INT) ELSE CAST(d AS INT) * 2 // 10 + CAST(d AS INT) * 2 % 10 END)) % 10 = 0 END AS valid FROM register_txns""",
    "lei_checks": f"""SELECT issuer_key, CASE WHEN issuer_lei IS NULL THEN NULL WHEN NOT regexp_full_match(issuer_lei, '[A-Z0-9]{{18}}[0-9]{{2}}') THEN FALSE
        ELSE list_reduce(list_transform({_digits("issuer_lei")}, lambda d: CAST(d AS INT)), lambda a, d: (a * 10 + d) % 97) = 1 END AS valid FROM issuers""",
    "fx_asof": """WITH f AS (SELECT currency, fx_date, max(rate) AS rate FROM fx_rates GROUP BY ALL), t AS (SELECT row_id, upper(trim(currency)) AS currency, trade_date FROM register_txns)
        SELECT t.row_id, CASE WHEN date_diff('day', f.fx_date, t.trade_date) <= 7 THEN f.rate END AS rate, CASE WHEN date_diff('day', f.fx_date, t.trade_date) <= 7 THEN f.fx_date END AS fx_date
        FROM t ASOF LEFT JOIN f ON f.currency = t.currency AND t.trade_date >= f.fx_date""",
    "shares_asof": """WITH p AS (SELECT issuer_key, as_of_day, max(shares) AS shares, as_of_day + 30 AS known FROM mcap_points WHERE shares IS NOT NULL GROUP BY ALL)
        SELECT t.row_id, p.shares, p.as_of_day FROM register_txns t ASOF LEFT JOIN p ON p.issuer_key = t.issuer_key AND t.trade_date >= p.known""",
    "next_amendment": """WITH a AS (SELECT issuer_key, CAST(published_at AS DATE) AS day, count(*) AS n FROM register_txns WHERE is_amendment AND issuer_key IS NOT NULL GROUP BY ALL)
        SELECT t.row_id, CASE WHEN date_diff('day', CAST(t.published_at AS DATE), a.day) <= 366 THEN a.day END AS amended, CASE WHEN date_diff('day', CAST(t.published_at AS DATE), a.day) <= 366 THEN a.n END AS n
        FROM register_txns t ASOF LEFT JOIN a ON a.issuer_key = t.issuer_key AND CAST(t.published_at AS DATE) < a.day""",
    "issue_at_price": """SELECT t.row_id, EXISTS (SELECT 1 FROM register_txns s WHERE s.nature_raw IN ('Teckning', 'Subscription') AND s.issuer_key = t.issuer_key AND s.price = t.price AND abs(date_diff('day', s.trade_date, t.trade_date)) <= 20) AS found FROM register_txns t""",
    "mcap_peers": """WITH p AS (SELECT point_id, issuer_key, as_of_day, ln(mcap_sek) AS x FROM mcap_points WHERE mcap_sek > 0),
        j AS (SELECT a.point_id, b.issuer_key AS peer, abs(a.x - b.x) AS distance FROM p a JOIN p b ON a.as_of_day = b.as_of_day AND a.issuer_key <> b.issuer_key AND abs(a.x - b.x) <= ln(2.0)),
        r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY distance, peer) AS k FROM j) SELECT point_id AS event_id, peer, round(distance, 9) AS distance FROM r WHERE k = 1""",
    "cooled_publications": _COOLED + "SELECT issuer_key, day FROM kept WHERE day IS NOT NULL",
    "crowded_windows": """WITH r AS (SELECT DISTINCT issuer_key, name_key, trade_date FROM register_txns WHERE issuer_key IS NOT NULL AND name_key IS NOT NULL AND trade_date IS NOT NULL), a AS (SELECT DISTINCT issuer_key, trade_date FROM r)
        SELECT a.issuer_key, a.trade_date, count(DISTINCT r.name_key) AS n FROM a JOIN r ON r.issuer_key = a.issuer_key AND r.trade_date BETWEEN a.trade_date AND a.trade_date + 30 GROUP BY ALL HAVING count(DISTINCT r.name_key) >= 3""",
    "split_factors": """WITH p AS (SELECT issuer_key, as_of_day, max(shares) AS shares FROM mcap_points WHERE shares > 0 GROUP BY ALL),
        s AS (SELECT * FROM (SELECT issuer_key, as_of_day, shares / lag(shares) OVER (PARTITION BY issuer_key ORDER BY as_of_day) AS ratio FROM p) WHERE ratio >= 1.5 OR ratio <= 0.6)
        SELECT m.point_id, round(coalesce((SELECT product(s.ratio) FROM s WHERE s.issuer_key = m.issuer_key AND s.as_of_day > m.as_of_day), 1.0), 6) AS factor FROM mcap_points m""",
    "visible_as_seen": _VISIBLE + f"SELECT row_id, issuer_key, visible_until FROM r WHERE published_at <= TIMESTAMP '{AS_OF}' AND (visible_until IS NULL OR visible_until > TIMESTAMP '{AS_OF}')",
    "visible_snapshot": f"SELECT row_id, issuer_key FROM register_txns WHERE status_raw IN ('Aktuell', 'Current') AND published_at <= TIMESTAMP '{AS_OF}' AND trade_date >= DATE '2024-07-01'",
    "first_publications": _VISIBLE + f"SELECT row_id, first_published AS visible_from FROM r WHERE first_published <= TIMESTAMP '{AS_OF}' AND (visible_until IS NULL OR visible_until > TIMESTAMP '{AS_OF}')",
    "pit_events": _VISIBLE
    + """, e AS (SELECT DISTINCT issuer_key, CAST(published_at AS DATE) AS event_day FROM register_txns WHERE issuer_key IS NOT NULL AND published_at IS NOT NULL)
        SELECT e.issuer_key, e.event_day, count(*) AS n_rows, min(r.trade_date) AS first_day, max(r.trade_date) AS last_day, round(sum(r.volume), 2) AS volume FROM e JOIN r ON r.issuer_key = e.issuer_key
        AND r.trade_date BETWEEN e.event_day - 365 AND e.event_day AND CAST(r.published_at AS DATE) <= e.event_day AND (r.visible_until IS NULL OR CAST(r.visible_until AS DATE) > e.event_day) GROUP BY ALL""",
    "quiet_issuers": _VISIBLE + f"SELECT issuer_key FROM issuers i WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.issuer_key = i.issuer_key AND r.published_at <= TIMESTAMP '{AS_OF}' AND (r.visible_until IS NULL OR r.visible_until > TIMESTAMP '{AS_OF}') AND r.trade_date >= DATE '2025-06-20')",
    "event_return_status": _RETURNS + "SELECT event_id, horizon, status, round(CASE WHEN status = 'OK' THEN r END, 6) AS stock, round(CASE WHEN status = 'OK' THEN m END, 6) AS market, round(CASE WHEN status = 'OK' THEN r - m END, 6) AS excess FROM s",
    "excess_iid": _RETURNS + _iid("x"),
    "excess_clustered": _RETURNS + _MU + _variance("x.month", "a") + "SELECT a.cell, mu.n, a.g AS groups, round(mu.m, 6) AS mean, round(CASE WHEN a.g >= 10 AND a.v > 1e-18 THEN mu.m / sqrt(a.v) END, 6) AS t FROM a JOIN mu ON mu.cell = a.cell",
    "excess_two_way": _RETURNS + _MU + ", ".join((_variance("x.issuer", "va"), _variance("x.month", "vb"), _variance("x.issuer, x.month", "vi")))
    + """SELECT va.cell, mu.n, round(mu.m, 6) AS mean, round(CASE WHEN va.g >= 10 AND vb.g >= 10 AND va.v + vb.v - vi.v > 1e-18 THEN mu.m / sqrt(va.v + vb.v - vi.v) END, 6) AS t
        FROM va JOIN vb ON vb.cell = va.cell JOIN vi ON vi.cell = va.cell JOIN mu ON mu.cell = va.cell""",
    "excess_calendar_time": _RETURNS + ", y AS (SELECT cell, month, avg(x) AS x FROM x GROUP BY ALL) " + _iid("y"),
    "excess_summary": _RETURNS + "SELECT cell, count(*) AS n, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END), 6) AS share_positive, count(DISTINCT issuer) AS n_issuers FROM x GROUP BY cell",
    "monthly_returns": """WITH m AS (SELECT issuer_key AS key, CAST(date_trunc('month', as_of_day) AS DATE) AS month, arg_max(price_used, (as_of_day, price_used)) AS c FROM mcap_points WHERE price_used > 0 GROUP BY ALL)
        SELECT key, month, round(c / lag(c) OVER (PARTITION BY key ORDER BY month) - 1, 6) AS ret FROM m""",
}
