"""Queries of chains, windows along a series and market caps, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kronolit.functions import taxonomy as tx
from kronolit.functions.parsing import band_label, isin_valid, recency_label
from kronolit.operators.asof import asof_backward, band_exists, nearest_peer
from kronolit.operators.bitemporal import link_revisions
from kronolit.operators.chains import chase, standing
from kronolit.operators.relational import calendar_pattern, crosstab_totals, most_frequent, seeded_sample
from kronolit.operators.returns import aligned_months, largest_moves, market_caps, monthly_excess, own_bar_returns, period_returns
from kronolit.plans.canonical import _list, _q, _re2, _term
from kronolit.plans.market import brand_bars, brand_benchmark, brand_events
from kronolit.plans.register import KEYS, LINK_WEIGHTS, SQL as REGISTER_SQL, _least_score
from kronolit.session import checkpointed, table


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def event_chains(spark: SparkSession, d: str) -> DataFrame:
    """Events linked to the user's event before them, no more than 30 minutes back: the first of each chain, and how far it is."""
    e = table(spark, d, "events").where("user_id is not null and ts is not null and event_id is not null")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    near = F.col("ts") - F.lag("ts").over(w) <= F.expr("interval '30' minute")
    return chase(e.select("event_id", F.when(near, F.lag("event_id").over(w)).alias("before")), "event_id", "before")


def revision_chains(spark: SparkSession, d: str) -> DataFrame:
    """Every amendment that replaces a filing, with the first filing of its chain."""
    t = table(spark, d, "register_txns")
    links = link_revisions(t, KEYS, "published_at", "is_amendment", "row_id", LINK_WEIGHTS, _least_score(), needed=("issuer_key", "name_key"))
    return chase(links, "row_id", "linked_to")


def chain_statuses(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "register_txns")
    links = link_revisions(t, KEYS, "published_at", "is_amendment", "row_id", LINK_WEIGHTS, _least_score(), needed=("issuer_key", "name_key"))
    s = standing(t, links, "row_id", F.col("status_raw").isin("Reviderad", "Revised"), F.col("status_raw").isin("Makulerad", "Cancelled"))
    return crosstab_totals(s, F.col("status_raw"), F.col("chain_status"))


def uniform_price_groups(spark: SparkSession, d: str) -> DataFrame:
    """Purchases of three or more persons of an issuer at one price on one day, and what speaks for an issue behind them: a row off
    the venues, or a subscription or issue instrument at that price within twenty days."""
    t = table(spark, d, "register_txns").where("issuer_key is not null and trade_date is not null and price is not null")
    t = t.select("row_id", "issuer_key", "name_key", "trade_date", "currency", F.round("price", 4).alias("price"), tx.txn_kind(F.col("nature_raw")).alias("kind"), tx.instrument_type(F.col("instrument_type_raw")).alias("itype"), (tx.venue_class(F.col("venue_raw")) == "off_venue").alias("off"))
    buys = t.where("kind = 'acq_purchase' and itype = 'share'").groupBy("issuer_key", "trade_date", "price", "currency").agg(F.count_distinct("name_key").alias("n_persons"), F.max("off").alias("off_venue"), F.count("*").alias("n_rows")).where("n_persons >= 3")
    issues = t.where((F.col("kind") == "subscription") | F.col("itype").isin("bta", "btu", "subscription_right", "interim_share"))
    g = band_exists(buys, issues, keys=["issuer_key", "price"], left_on="trade_date", right_on="trade_date", days=20, name="issue_evidence")
    return g.withColumn("structural", F.col("off_venue") | F.col("issue_evidence"))


def _windows(ev: DataFrame) -> DataFrame:
    return ev.select(F.concat_ws("|", "brand", "day").alias("wid"), F.col("brand").alias("key"), F.col("day").alias("entry"), F.date_add("day", 180).alias("end"))


def _bars(spark: SparkSession, d: str) -> DataFrame:
    return checkpointed(brand_bars(spark, d).where("close > 0").select(F.col("brand").alias("key"), "day", F.col("close").alias("c")))


def brand_own_bar_returns(spark: SparkSession, d: str) -> DataFrame:
    b = checkpointed(brand_bars(spark, d))
    ev = brand_events(spark, d).select(F.concat_ws("|", "brand", "day").alias("event_id"), "brand", "day")
    return _rounded(own_bar_returns(ev, b, event_id="event_id", key="brand", event_day="day", day="day", close="close", horizons=(1, 21)))


def brand_largest_moves(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(largest_moves(_windows(brand_events(spark, d)), _bars(spark, d)))


def brand_monthly_excess(spark: SparkSession, d: str) -> DataFrame:
    bench = brand_benchmark(spark, d).where("close > 0").select("day", F.col("close").alias("c"))
    return _rounded(monthly_excess(_windows(brand_events(spark, d)), _bars(spark, d), bench))


def brand_month_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Monthly returns of two brands of which each may lack months."""
    m = period_returns(brand_bars(spark, d), "brand", "day", "close").where("ret is not null")
    one = lambda b: m.where(F.col("key") == b).select("month", "ret")
    return _rounded(aligned_months(one("Brand#11"), one("Brand#12").where("month(month) != 2")))


def mcap_panel(spark: SparkSession, d: str) -> DataFrame:
    """The market cap of each issuer in the middle of each month, from prices (to four places) and share counts known then."""
    p = table(spark, d, "mcap_points").where("issuer_key is not null and as_of_day is not null")
    prices = p.where("price_used > 0").groupBy("issuer_key", F.col("as_of_day").alias("day")).agg(F.max("price_used").alias("price"))
    shares = p.where("shares > 0").groupBy("issuer_key", F.col("as_of_day").alias("day")).agg(F.max("shares").alias("shares"))
    prev = F.lag("shares").over(Window.partitionBy("issuer_key").orderBy("day"))
    splits = shares.select("issuer_key", "day", (F.col("shares") / prev).alias("ratio")).where("ratio >= 1.5 or ratio <= 0.6")
    days = p.select("issuer_key", F.date_add(F.trunc("as_of_day", "MM"), 14).alias("day")).distinct()
    caps = market_caps(days, prices, shares, splits, key="issuer_key", lag=45)
    return caps.withColumns({"cap": F.round("cap", 0), "shares": F.round("shares", 2), "price": F.round("price", 4)})


def _points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mcap_points").where("issuer_key is not null and as_of_day is not null and mcap_sek > 0 and not isnan(mcap_sek)").select("point_id", "issuer_key", "as_of_day", "mcap_sek")


def mcap_nearest_peers(spark: SparkSession, d: str) -> DataFrame:
    """The nearest issuer by market cap of the same day, however far."""
    p = _points(spark, d)
    n = nearest_peer(p, p, event_id="point_id", entity="issuer_key", at="as_of_day", size="mcap_sek", factor=None)
    return _rounded(n.select(F.col("event_id").alias("point_id"), "peer", "distance"))


def quiet_peers(spark: SparkSession, d: str) -> DataFrame:
    """The same among issuers without a filing of the last 30 days, for points of issuers with one."""
    p, t = _points(spark, d), table(spark, d, "register_txns").where("issuer_key is not null").select("issuer_key", F.col("published_at").cast("date").alias("day"), F.lit(1).alias("one"))
    p = asof_backward(p, t, key="issuer_key", left_on="as_of_day", right_on="day", values=["one"], max_age=30)
    n = nearest_peer(p.where("one is not null"), p.where("one is null"), event_id="point_id", entity="issuer_key", at="as_of_day", size="mcap_sek", factor=None)
    return _rounded(n.select(F.col("event_id").alias("point_id"), "peer", "distance"))


def share_isins(spark: SparkSession, d: str) -> DataFrame:
    """Each share's ISIN with the issuer that most rows name and the first and last day it was dealt in."""
    t = table(spark, d, "register_txns").where((tx.instrument_type(F.col("instrument_type_raw")) == "share") & isin_valid(F.col("isin")))
    own = most_frequent(t, "isin", "issuer_key", "issuer_key").select("isin", "issuer_key", F.col("n").alias("n_of_issuer"))
    all_ = t.groupBy("isin").agg(F.count("*").alias("n_rows"), F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"))
    return all_.join(own, "isin", "left")


def trade_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Persons of an issuer by whether they deal in the same month every year."""
    t = table(spark, d, "register_txns").where("issuer_key is not null and name_key is not null")
    return calendar_pattern(t, ["issuer_key", "name_key"], "trade_date", F.lit("2025-06-30").cast("date"))


def days_since_point(spark: SparkSession, d: str) -> DataFrame:
    """How long before each filing's trade the issuer's last market cap point lies."""
    p = table(spark, d, "mcap_points").where("as_of_day is not null").select("issuer_key", "as_of_day", F.lit(1).alias("one"))
    t = table(spark, d, "register_txns").select("row_id", "issuer_key", "trade_date")
    a = asof_backward(t, p, key="issuer_key", left_on="trade_date", right_on="as_of_day", values=["one"])
    days = F.datediff("trade_date", "as_of_day_matched")
    return a.select("row_id", days.alias("days"), recency_label(days, 30).alias("label"))


def register_prices(spark: SparkSession, d: str) -> DataFrame:
    """The median price of a day's rows of an ISIN in kronor, of those on a venue, else of those off it, to four places; the 1e-9
    keeps ties apart in every engine."""
    t = table(spark, d, "register_txns").where("currency = 'SEK' and price > 0 and isin is not null and trade_date is not null")
    on = tx.on_venue(tx.venue_class(F.col("venue_raw")))
    g = t.groupBy("isin", "trade_date").agg(F.percentile(F.when(on, F.col("price")), F.lit(0.5)).alias("a"), F.percentile(F.when(~on, F.col("price")), F.lit(0.5)).alias("b"))
    return _rounded(g.select("isin", "trade_date", (F.coalesce("a", "b") + 1e-9).alias("price"), F.when(F.col("a").isNotNull(), "register_onvenue").otherwise("register_offvenue").alias("price_source")), 4)


def cap_bands(spark: SparkSession, d: str) -> DataFrame:
    """Market cap points by band of shares times price, in billions of kronor."""
    cap = F.col("shares") * F.col("price_used") / 1e9
    return table(spark, d, "mcap_points").groupBy(band_label(cap, 1.0, 10.0, ("small", "middle", "large")).alias("band")).agg(F.count("*").alias("n"))


def audit_sample(spark: SparkSession, d: str) -> DataFrame:
    """Fifty filings drawn with a seed, for an audit listing."""
    return seeded_sample(table(spark, d, "register_txns").where("row_id is not null"), "row_id", 50, 7).select("row_id", "issuer_key", "published_at")


QUERIES = {f.__name__: f for f in (event_chains, revision_chains, chain_statuses, uniform_price_groups, brand_own_bar_returns, brand_largest_moves, brand_monthly_excess, brand_month_alignment, mcap_panel, mcap_nearest_peers, quiet_peers, share_isins, trade_patterns, days_since_point, register_prices, cap_bands, audit_sample)}

_BARS = """
WITH RECURSIVE bars AS (SELECT p_brand AS brand, CAST(l_shipdate AS DATE) AS day, round(avg(l_extendedprice / l_quantity) + 1e-9, 4) AS close FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0 GROUP BY ALL),
bench AS (SELECT day, round(avg(close) + 1e-9, 4) AS close FROM bars GROUP BY day),
days AS (SELECT DISTINCT p_brand AS brand, CAST(l_shipdate AS DATE) AS day FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_quantity >= 48 AND l_shipdate IS NOT NULL),
kept AS (SELECT brand, min(day) AS day FROM days GROUP BY brand UNION ALL SELECT k.brand, (SELECT min(d.day) FROM days d WHERE d.brand = k.brand AND d.day > k.day + 126) AS day FROM kept k WHERE k.day IS NOT NULL),
w AS (SELECT concat_ws('|', brand, CAST(day AS VARCHAR)) AS wid, brand, day AS entry, day + 180 AS fin FROM kept WHERE day IS NOT NULL)
"""
_CAPS = """
WITH p AS (SELECT * FROM mcap_points WHERE issuer_key IS NOT NULL AND as_of_day IS NOT NULL),
pr AS (SELECT issuer_key, as_of_day AS day, max(price_used) AS price FROM p WHERE price_used > 0 GROUP BY ALL), sh AS (SELECT issuer_key, as_of_day AS day, max(shares) AS shares FROM p WHERE shares > 0 GROUP BY ALL),
sp AS (SELECT * FROM (SELECT issuer_key, day, shares / lag(shares) OVER (PARTITION BY issuer_key ORDER BY day) AS ratio FROM sh) WHERE ratio >= 1.5 OR ratio <= 0.6),
d AS (SELECT DISTINCT issuer_key, CAST(date_trunc('month', as_of_day) AS DATE) + 14 AS day FROM p),
a AS (SELECT d.*, CASE WHEN d.day - pr.day <= 10 THEN pr.price END AS price FROM d ASOF LEFT JOIN pr ON pr.issuer_key = d.issuer_key AND d.day >= pr.day),
b AS (SELECT a.*, sh.day AS shares_date, sh.shares AS obs FROM a ASOF LEFT JOIN sh ON sh.issuer_key = a.issuer_key AND a.day - 45 >= sh.day),
f AS (SELECT b.issuer_key, b.day, product(sp.ratio) AS f FROM b JOIN sp ON sp.issuer_key = b.issuer_key AND sp.day > b.shares_date AND sp.day <= b.day GROUP BY ALL),
c AS (SELECT b.*, obs * coalesce(f.f, 1) AS adj FROM b LEFT JOIN f ON f.issuer_key = b.issuer_key AND f.day = b.day)
"""
_VENUE = "upper(trim(translate(coalesce(r.venue_raw, ''), '\u00a0', ' ')))"
SQL = {
    "event_chains": """WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM e), c AS (SELECT event_id, new, first_value(event_id) OVER v AS root, row_number() OVER v - 1 AS hops FROM s WINDOW v AS (PARTITION BY user_id, g ORDER BY ts, event_id))
        SELECT event_id, root, hops FROM c WHERE new = 0""",
    "uniform_price_groups": f"""WITH t AS (SELECT r.issuer_key, r.name_key, r.trade_date, r.currency, round(r.price, 4) AS price, k.b AS kind, i.b AS itype, CASE WHEN {_VENUE} = '' THEN false ELSE regexp_matches({_VENUE}, {_q(_re2(tx.VENUES[0][1]))}, 's') END AS off FROM register_txns r
          LEFT JOIN {_list(tx.KINDS).replace(") m(a, b)", ") k(a, b)")} ON k.a = {_term("r.nature_raw")} LEFT JOIN {_list(tx.INSTRUMENTS).replace(") m(a, b)", ") i(a, b)")} ON i.a = {_term("r.instrument_type_raw")} WHERE r.issuer_key IS NOT NULL AND r.trade_date IS NOT NULL AND r.price IS NOT NULL),
        g AS (SELECT issuer_key, trade_date, price, currency, count(DISTINCT name_key) AS n_persons, bool_or(off) AS off_venue, count(*) AS n_rows FROM t WHERE kind = 'acq_purchase' AND itype = 'share' GROUP BY issuer_key, trade_date, price, currency HAVING count(DISTINCT name_key) >= 3),
        e AS (SELECT g.*, EXISTS (SELECT 1 FROM t WHERE (t.kind = 'subscription' OR t.itype IN ('bta', 'btu', 'subscription_right', 'interim_share')) AND t.issuer_key = g.issuer_key AND t.price = g.price AND abs(date_diff('day', t.trade_date, g.trade_date)) <= 20) AS issue_evidence FROM g)
        SELECT *, off_venue OR issue_evidence AS structural FROM e""",
    "brand_own_bar_returns": _BARS
    + """, b AS (SELECT brand, day, close, row_number() OVER (PARTITION BY brand ORDER BY day) AS k FROM bars WHERE close > 0), e AS (SELECT w.wid AS event_id, w.brand, min(b.k) AS k FROM w JOIN b ON b.brand = w.brand AND b.day > w.entry GROUP BY ALL)
        SELECT e.event_id, h.horizon, b0.day AS entry_day, b1.day AS exit_day, round(b1.close / b0.close - 1, 6) AS ret FROM e JOIN (VALUES (1), (21)) h(horizon) ON true JOIN b b0 ON b0.brand = e.brand AND b0.k = e.k JOIN b b1 ON b1.brand = e.brand AND b1.k = e.k + h.horizon""",
    "brand_largest_moves": _BARS
    + """, b AS (SELECT brand, day, close, lag(close) OVER v AS was, lag(day) OVER v AS was_on FROM bars WHERE close > 0 WINDOW v AS (PARTITION BY brand ORDER BY day))
        SELECT w.wid, round(coalesce(max(CASE WHEN b.was_on >= w.entry THEN abs(b.close / b.was - 1) END), 0), 6) AS move FROM w JOIN b ON b.brand = w.brand AND b.day BETWEEN w.entry AND w.fin GROUP BY w.wid""",
    "brand_monthly_excess": _BARS
    + """, x AS (SELECT w.wid, CAST(date_trunc('month', b.day) AS DATE) AS month, max_by(b.close, b.day) AS c, min_by(b.close, b.day) AS c0 FROM w JOIN bars b ON b.brand = w.brand AND b.close > 0 AND b.day BETWEEN w.entry AND w.fin GROUP BY ALL),
        y AS (SELECT w.wid, CAST(date_trunc('month', b.day) AS DATE) AS month, max_by(b.close, b.day) AS c, min_by(b.close, b.day) AS c0 FROM w JOIN bench b ON b.close > 0 AND b.day BETWEEN w.entry AND w.fin GROUP BY ALL),
        xr AS (SELECT wid, month, c / coalesce(lag(c) OVER (PARTITION BY wid ORDER BY month), c0) - 1 AS r FROM x), yr AS (SELECT wid, month, c / coalesce(lag(c) OVER (PARTITION BY wid ORDER BY month), c0) - 1 AS r FROM y)
        SELECT xr.wid, xr.month, round(xr.r - yr.r, 6) AS excess FROM xr JOIN yr ON yr.wid = xr.wid AND yr.month = xr.month""",
    "brand_month_alignment": _BARS
    + """, m AS (SELECT brand, CAST(date_trunc('month', day) AS DATE) AS month, max_by(close, day) AS c FROM bars WHERE close > 0 GROUP BY ALL), r AS (SELECT brand, month, c / lag(c) OVER (PARTITION BY brand ORDER BY month) - 1 AS r FROM m),
        a AS (SELECT month, r FROM r WHERE brand = 'Brand#11' AND r IS NOT NULL), b AS (SELECT month, r FROM r WHERE brand = 'Brand#12' AND r IS NOT NULL AND month(month) <> 2) SELECT coalesce(a.month, b.month) AS month, round(a.r, 6) AS a, round(b.r, 6) AS b FROM a FULL JOIN b ON a.month = b.month""",
    "mcap_panel": _CAPS
    + """SELECT issuer_key, day, round(CASE WHEN price IS NOT NULL AND adj > 0 THEN adj * price END, 0) AS cap, round(adj, 2) AS shares, shares_date, round(price, 4) AS price,
        CASE WHEN price IS NULL THEN 'NO_PRICE_AT_DATE' WHEN obs IS NULL THEN 'SHARES_NOT_YET_PUBLIC' WHEN NOT adj > 0 THEN 'NON_POSITIVE' ELSE 'OK' END AS reason FROM c""",
    "mcap_nearest_peers": """WITH p AS (SELECT point_id, issuer_key, as_of_day, ln(mcap_sek) AS y FROM mcap_points WHERE issuer_key IS NOT NULL AND as_of_day IS NOT NULL AND mcap_sek > 0 AND NOT isnan(mcap_sek)),
        j AS (SELECT a.point_id, b.issuer_key AS peer, abs(a.y - b.y) AS distance, row_number() OVER (PARTITION BY a.point_id ORDER BY abs(a.y - b.y), b.issuer_key) AS k FROM p a JOIN p b ON a.as_of_day = b.as_of_day AND a.issuer_key <> b.issuer_key)
        SELECT point_id, peer, round(distance, 6) AS distance FROM j WHERE k = 1""",
    "quiet_peers": """WITH p AS (SELECT point_id, issuer_key, as_of_day, ln(mcap_sek) AS y, EXISTS (SELECT 1 FROM register_txns t WHERE t.issuer_key = m.issuer_key AND CAST(t.published_at AS DATE) BETWEEN m.as_of_day - 30 AND m.as_of_day) AS active
          FROM mcap_points m WHERE issuer_key IS NOT NULL AND as_of_day IS NOT NULL AND mcap_sek > 0 AND NOT isnan(mcap_sek)),
        j AS (SELECT a.point_id, b.issuer_key AS peer, abs(a.y - b.y) AS distance, row_number() OVER (PARTITION BY a.point_id ORDER BY abs(a.y - b.y), b.issuer_key) AS k FROM p a JOIN p b ON a.as_of_day = b.as_of_day AND a.issuer_key <> b.issuer_key WHERE a.active AND NOT b.active)
        SELECT point_id, peer, round(distance, 6) AS distance FROM j WHERE k = 1""",
    "share_isins": f"""WITH v AS ({REGISTER_SQL["isin_checks"]}), t AS (SELECT r.* FROM register_txns r JOIN v ON v.row_id = r.row_id AND v.valid JOIN {_list(tx.INSTRUMENTS)} ON m.a = {_term("r.instrument_type_raw")} AND m.b = 'share'),
        c AS (SELECT isin, issuer_key, count(*) AS n FROM t WHERE issuer_key IS NOT NULL GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY isin ORDER BY n DESC, issuer_key) AS k FROM c),
        a AS (SELECT isin, count(*) AS n_rows, min(trade_date) AS first_day, max(trade_date) AS last_day FROM t GROUP BY isin) SELECT a.isin, a.n_rows, a.first_day, a.last_day, o.issuer_key, o.n AS n_of_issuer FROM a LEFT JOIN o ON o.isin = a.isin AND o.k = 1""",
    "trade_patterns": """WITH t AS (SELECT issuer_key, name_key, month(trade_date) AS m, date_diff('day', trade_date, DATE '2025-06-30') AS age FROM register_txns WHERE issuer_key IS NOT NULL AND name_key IS NOT NULL),
        b AS (SELECT *, CASE WHEN age > 0 AND age < 1095 THEN age // 365 END AS b FROM t),
        k AS (SELECT issuer_key, name_key, count(DISTINCT b) AS n FROM b GROUP BY ALL), c AS (SELECT DISTINCT issuer_key, name_key FROM (SELECT issuer_key, name_key, m FROM b WHERE b IS NOT NULL GROUP BY ALL HAVING count(DISTINCT b) = 3))
        SELECT k.issuer_key, k.name_key, CASE WHEN n = 0 THEN 'novel' WHEN n < 3 THEN 'sparse' WHEN c.issuer_key IS NOT NULL THEN 'routine' ELSE 'opportunistic' END AS label FROM k LEFT JOIN c ON c.issuer_key = k.issuer_key AND c.name_key = k.name_key""",
    "days_since_point": """WITH p AS (SELECT DISTINCT issuer_key, as_of_day FROM mcap_points WHERE as_of_day IS NOT NULL AND issuer_key IS NOT NULL), a AS (SELECT t.row_id, date_diff('day', p.as_of_day, t.trade_date) AS days FROM register_txns t ASOF LEFT JOIN p ON p.issuer_key = t.issuer_key AND t.trade_date >= p.as_of_day)
        SELECT row_id, CAST(days AS INTEGER) AS days, CASE WHEN days IS NULL OR days > 200 THEN 'UNKNOWN' WHEN days <= 30 THEN 'IN_WINDOW' ELSE 'OUTSIDE' END AS label FROM a""",
    "register_prices": f"""WITH t AS (SELECT r.*, {_VENUE} <> '' AND NOT regexp_matches({_VENUE}, {_q(_re2(tx.VENUES[0][1]))}, 's') AS on_v FROM register_txns r WHERE currency = 'SEK' AND price > 0 AND isin IS NOT NULL AND trade_date IS NOT NULL),
        g AS (SELECT isin, trade_date, quantile_cont(CASE WHEN on_v THEN price END, 0.5) AS a, quantile_cont(CASE WHEN NOT on_v THEN price END, 0.5) AS b FROM t GROUP BY ALL)
        SELECT isin, trade_date, round(coalesce(a, b) + 1e-9, 4) AS price, CASE WHEN a IS NOT NULL THEN 'register_onvenue' ELSE 'register_offvenue' END AS price_source FROM g""",
    "cap_bands": """SELECT CASE WHEN x < 1 THEN 'small' WHEN x < 10 THEN 'middle' WHEN x >= 10 THEN 'large' END AS band, count(*) AS n FROM (SELECT CASE WHEN isfinite(shares * price_used) THEN shares * price_used / 1e9 END AS x FROM mcap_points) GROUP BY band""",
    "audit_sample": "SELECT row_id, issuer_key, published_at FROM register_txns WHERE row_id IS NOT NULL ORDER BY md5(concat_ws('|', '7', CAST(row_id AS VARCHAR))), row_id LIMIT 50",
}
