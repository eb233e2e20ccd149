"""Queries over the order tables (a brand's daily price is a series, its large orders are events) and further series operators
over the register tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kronolit.operators import relational as rel
from kronolit.operators.asof import asof_backward, nearest_peer
from kronolit.operators.intervals import bucketed_interval_join
from kronolit.operators.identity import apply_rules, merge_rules
from kronolit.operators.returns import event_returns, shifted_events
from kronolit.operators.segments import factor_at, scale_segments
from kronolit.operators.sequence import cooldown
from kronolit.operators.stats import t_clustered, t_iid
from kronolit.session import checkpointed, table

HORIZONS = (21, 63, 126)


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def brand_bars(spark: SparkSession, d: str) -> DataFrame:
    """brand, day, close: the mean unit price of a brand's lines of a day, to four places; the 1e-9 keeps ties apart in every engine."""
    li = table(spark, d, "lineitem").where("l_quantity > 0").select("l_partkey", F.to_date("l_shipdate").alias("day"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("x"))
    j = li.join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(F.col("p_brand").alias("brand"), "day").agg(F.round(F.avg("x") + 1e-9, 4).alias("close"))


def _brand_events(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity >= 48").select("l_partkey", F.to_date("l_shipdate").alias("day"))
    j = li.join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    e = cooldown(j.select(F.col("p_brand").alias("brand"), "day"), "brand", "day", 126)
    return e.withColumn("event_id", F.concat_ws("|", "brand", "day"))


def _bench(bars: DataFrame) -> DataFrame:
    return bars.groupBy("day").agg(F.round(F.avg("close") + 1e-9, 4).alias("close"))


def brand_benchmark(spark: SparkSession, d: str) -> DataFrame:
    return _bench(brand_bars(spark, d))


def brand_events(spark: SparkSession, d: str) -> DataFrame:
    return _brand_events(spark, d).select("brand", "day")


def _brand_returns(spark: SparkSession, d: str, shift: int = 0) -> DataFrame:
    bars = checkpointed(brand_bars(spark, d))  # read by the events, the calendar and the benchmark
    bench, ev = checkpointed(_bench(bars)), _brand_events(spark, d)
    if shift:
        ev = shifted_events(ev, bench, "day", shift)
    return event_returns(ev, bars, bench, event_id="event_id", key="brand", event_day="day", day="day", close="close", bench_day="day", horizons=HORIZONS, stale=5)


def brand_event_returns(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_brand_returns(spark, d))


def brand_placebo_returns(spark: SparkSession, d: str) -> DataFrame:
    """The same a year of sessions earlier."""
    return _rounded(_brand_returns(spark, d, -252))


def _cells(r: DataFrame) -> DataFrame:
    return r.where("status = 'OK'").select("event_id", F.concat(F.lit("h"), F.col("horizon")).alias("cell"), "excess", F.split("event_id", r"\|")[0].alias("brand"))


def brand_excess(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(t_iid(_cells(_brand_returns(spark, d)), "cell", "excess"), 5)


def brand_excess_clustered(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(t_clustered(_cells(_brand_returns(spark, d)), "cell", "excess", "brand"), 5)


def brand_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return rel.crosstab_totals(_brand_returns(spark, d), F.col("horizon"), F.col("status"))


def matched_control(spark: SparkSession, d: str) -> DataFrame:
    """Each cap point's peer of the same day within a factor of two, and both price changes to the next month's point."""
    p = table(spark, d, "mcap_points").where("price_used > 0 and issuer_key is not null and as_of_day is not null")
    peers = nearest_peer(p, p, event_id="point_id", entity="issuer_key", at="as_of_day", size="mcap_sek")
    bars = p.groupBy("issuer_key", "as_of_day").agg(F.max("price_used").alias("c"))
    nxt = bars.select(F.col("issuer_key").alias("k"), F.add_months("as_of_day", -1).alias("day"), F.col("c").alias("c1"))
    change = bars.join(nxt, (F.col("issuer_key") == F.col("k")) & (F.col("as_of_day") == F.col("day"))).select(F.col("issuer_key").alias("k"), F.col("as_of_day").alias("day"), (F.col("c1") / F.col("c") - 1).alias("r"))
    own = p.select("point_id", "issuer_key", "as_of_day").join(peers, F.col("point_id") == F.col("event_id")).drop("event_id")
    own = own.join(change.withColumnsRenamed({"k": "_k", "day": "_d", "r": "own"}), (F.col("issuer_key") == F.col("_k")) & (F.col("as_of_day") == F.col("_d")))
    both = own.join(change.withColumnsRenamed({"k": "_pk", "day": "_pd", "r": "peers"}), (F.col("peer") == F.col("_pk")) & (F.col("as_of_day") == F.col("_pd")))
    return _rounded(both.select("point_id", "peer", "own", "peers", (F.col("own") - F.col("peers")).alias("excess")))


def price_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Of each issuer's SEK trades with a reference of the last 40 days: the share within a tenth of it, of all and of the last 20."""
    t = table(spark, d, "register_txns").where("currency = 'SEK' and price > 0").select("row_id", "issuer_key", "trade_date", "price")
    j = asof_backward(t, table(spark, d, "mcap_points").where("price_used > 0"), key="issuer_key", left_on="trade_date", right_on="as_of_day", values=["price_used"], max_age=40).where("price_used is not null")
    n = F.row_number().over(Window.partitionBy("issuer_key").orderBy(F.desc("trade_date"), F.desc("row_id")))
    j = j.withColumn("inside", (F.abs(F.col("price") / F.col("price_used") - 1) <= 0.1).cast("double")).withColumn("n", n)
    return _rounded(j.groupBy("issuer_key").agg(F.count("*").alias("n_trades"), F.avg("inside").alias("share_all"), F.avg(F.when(F.col("n") <= 20, F.col("inside"))).alias("share_recent")))


def _ratios(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "register_txns").where("currency = 'SEK' and price > 0").select("issuer_key", "trade_date", "price")
    j = asof_backward(t, table(spark, d, "mcap_points").where("price_used > 0"), key="issuer_key", left_on="trade_date", right_on="as_of_day", values=["price_used"], max_age=40)
    return j.select("issuer_key", "trade_date", (F.col("price") / F.col("price_used")).alias("ratio"))


def price_scale_segments(spark: SparkSession, d: str) -> DataFrame:
    """Stretches in which an issuer's trades stand at one multiple of its reference price."""
    return _rounded(scale_segments(_ratios(spark, d), "issuer_key", "trade_date", "ratio"))


def trade_scales(spark: SparkSession, d: str) -> DataFrame:
    """The scale of each filing's day."""
    seg = scale_segments(_ratios(spark, d), "issuer_key", "trade_date", "ratio")
    return _rounded(factor_at(table(spark, d, "register_txns").select("row_id", "issuer_key", "trade_date"), seg, "issuer_key", "trade_date").select("row_id", "factor"))


def share_growth(spark: SparkSession, d: str) -> DataFrame:
    """Share counts against the point 180 to 700 days older that is nearest to a year (the earlier on a tie)."""
    s = table(spark, d, "mcap_points").where("shares > 0 and issuer_key is not null").groupBy("issuer_key", "as_of_day").agg(F.max("shares").alias("shares"))
    old = s.select("issuer_key", F.col("as_of_day").alias("_d"), F.col("shares").alias("_old"), F.date_add("as_of_day", 180).alias("_from"), F.date_add("as_of_day", 701).alias("_to"))
    j = bucketed_interval_join(s, old, "issuer_key", "as_of_day", "_from", "_to", width=180)
    age = F.datediff("as_of_day", "_d")
    best = j.groupBy("issuer_key", "as_of_day").agg(F.first("shares").alias("shares"), F.min(F.struct(F.abs(age - 365).alias("gap"), "_d", "_old")).alias("b"))
    return _rounded(best.select("issuer_key", "as_of_day", (F.col("shares") / F.col("b._old") - 1).alias("growth")))


def trade_rhythm(spark: SparkSession, d: str) -> DataFrame:
    """Per issuer and person: months with trades, and the median absolute deviation of the monthly volume over its median."""
    t = table(spark, d, "register_txns").where("issuer_key is not null and name_key is not null and trade_date is not null and volume is not null")
    m = t.groupBy("issuer_key", "name_key", F.trunc("trade_date", "MM").alias("month")).agg(F.round(F.sum("volume"), 2).alias("v"))
    med = m.groupBy("issuer_key", "name_key").agg(F.count("*").alias("n_months"), F.percentile("v", F.lit(0.5)).alias("med"))
    dev = m.join(med, ["issuer_key", "name_key"]).groupBy("issuer_key", "name_key", "n_months", "med").agg(F.percentile(F.abs(F.col("v") - F.col("med")), F.lit(0.5)).alias("mad"))
    return _rounded(dev.select("issuer_key", "name_key", "n_months", F.when(F.col("med") > 0, F.col("mad") / F.col("med")).alias("dispersion")))


def person_rules(spark: SparkSession, d: str) -> DataFrame:
    return merge_rules(table(spark, d, "person_names"), "issuer_key", "name_key", "first_seen")


def ruled_persons(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "register_txns").select("row_id", "issuer_key", "name_key", "published_at")
    return apply_rules(t, person_rules(spark, d), "issuer_key", "name_key", "published_at").select("row_id", "person")


def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    g = li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("sum_price"), F.avg("l_discount").alias("avg_discount"), F.count("*").alias("n"))
    return _rounded(g, 2)


def region_year_totals(spark: SparkSession, d: str) -> DataFrame:
    """Order value by region and year with totals."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    g = o.rollup(F.col("r_name").alias("region"), F.year("o_orderdate").cast("long").alias("year")).agg(F.round(F.sum("o_totalprice"), 1).alias("value"), F.count("*").alias("n"))
    return g


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user: events no more than 30 minutes apart."""
    e = table(spark, d, "events").where("user_id is not null and ts is not null")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.coalesce(F.col("ts") - F.lag("ts").over(w) > F.expr("interval '30' minute"), F.lit(True))
    s = e.withColumn("new", gap.cast("int")).withColumn("session", F.sum("new").over(w))
    return s.groupBy("user_id", "session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))


def last_order_at_event(spark: SparkSession, d: str) -> DataFrame:
    """The last order value of the user as a customer before each event."""
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("o_custkey"), F.to_date("ts").alias("day"))
    o = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("ordered"), "o_totalprice")
    return asof_backward(e, o, key="o_custkey", left_on="day", right_on="ordered", values=["o_totalprice"]).select("event_id", "o_totalprice", F.col("ordered_matched").alias("ordered"))


QUERIES = {
    f.__name__: f
    for f in (
        brand_bars, brand_benchmark, brand_events, brand_event_returns, brand_placebo_returns, brand_excess, brand_excess_clustered, brand_status_counts, matched_control, price_agreement, price_scale_segments, trade_scales, share_growth, trade_rhythm, person_rules, ruled_persons,
        pricing_summary, region_year_totals, event_sessions, last_order_at_event,
    )
}

_BARS = """
WITH RECURSIVE bars AS (SELECT p_brand AS brand, CAST(l_shipdate AS DATE) AS day, round(avg(l_extendedprice / l_quantity) + 1e-9, 4) AS close FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0 GROUP BY ALL),
bench AS (SELECT day, round(avg(close) + 1e-9, 4) AS close FROM bars GROUP BY day),
days AS (SELECT DISTINCT p_brand AS brand, CAST(l_shipdate AS DATE) AS day FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_quantity >= 48 AND l_shipdate IS NOT NULL),
kept AS (SELECT brand, min(day) AS day FROM days GROUP BY brand UNION ALL SELECT k.brand, (SELECT min(d.day) FROM days d WHERE d.brand = k.brand AND d.day > k.day + 126) AS day FROM kept k WHERE k.day IS NOT NULL),
cal AS (SELECT row_number() OVER (ORDER BY day) - 1 AS n, day, close AS bench FROM bench)
"""


def _returns_sql(shift: int) -> str:
    moved = f"(SELECT m.day FROM cal m WHERE m.n = (SELECT max(c.n) FROM cal c WHERE c.day <= kept.day) - {shift})" if shift else "kept.day"
    return (
        _BARS
        + f""", e AS (SELECT kept.brand, {moved} AS day, concat_ws('|', kept.brand, CAST(kept.day AS VARCHAR)) AS event_id FROM kept WHERE kept.day IS NOT NULL),
h AS (SELECT e.*, x.horizon, CASE WHEN e.day >= (SELECT max(day) FROM cal) THEN (SELECT count(*) FROM cal) ELSE (SELECT min(n) FROM cal WHERE cal.day > e.day) END AS i0 FROM e CROSS JOIN (VALUES (21), (63), (126)) x(horizon) WHERE e.day IS NOT NULL),
b AS (SELECT bars.brand, cal.n, bars.close AS c FROM bars JOIN cal ON cal.day = bars.day WHERE bars.close > 0),
q0 AS (SELECT h.event_id, h.horizon, min(b.n) AS n0 FROM h JOIN b ON b.brand = h.brand AND b.n BETWEEN h.i0 AND h.i0 + 5 GROUP BY ALL),
q1 AS (SELECT h.event_id, h.horizon, max(b.n) AS n1 FROM h JOIN b ON b.brand = h.brand AND b.n BETWEEN h.i0 + h.horizon - 5 AND h.i0 + h.horizon GROUP BY ALL),
v AS (SELECT h.*, q0.n0, q1.n1, b1.c / b0.c - 1 AS r, c1.bench / c0.bench - 1 AS m FROM h LEFT JOIN q0 ON q0.event_id = h.event_id AND q0.horizon = h.horizon LEFT JOIN q1 ON q1.event_id = h.event_id AND q1.horizon = h.horizon
    LEFT JOIN b b0 ON b0.brand = h.brand AND b0.n = q0.n0 LEFT JOIN b b1 ON b1.brand = h.brand AND b1.n = q1.n1 LEFT JOIN cal c0 ON c0.n = q0.n0 LEFT JOIN cal c1 ON c1.n = h.i0 + h.horizon),
s AS (SELECT *, CASE WHEN i0 + horizon > (SELECT max(n) FROM cal) THEN 'TOO_RECENT' WHEN n0 IS NULL THEN 'NO_ENTRY_BAR' WHEN n1 IS NULL OR n1 <= n0 THEN 'ENDED_IN_WINDOW' WHEN abs(r) > 5 THEN 'ARTEFACT' ELSE 'OK' END AS status FROM v),
x AS (SELECT event_id, 'h' || CAST(horizon AS VARCHAR) AS cell, r - m AS x, brand FROM s WHERE status = 'OK')
"""
    )


_ROWS = "SELECT event_id, horizon, status, round(CASE WHEN status = 'OK' THEN r END, 6) AS stock, round(CASE WHEN status = 'OK' THEN m END, 6) AS market, round(CASE WHEN status = 'OK' THEN r - m END, 6) AS excess FROM s"
_RULES = """
WITH n AS (SELECT issuer_key, name_key, min(first_seen) AS t FROM person_names WHERE issuer_key IS NOT NULL AND name_key IS NOT NULL AND first_seen IS NOT NULL GROUP BY ALL),
w AS (SELECT *, string_split(name_key, ' ') AS x FROM n), f AS (SELECT issuer_key, name_key, t, len(x) AS k, x[1] AS a, x[-1] AS z FROM w WHERE len(x) >= 2),
s AS (SELECT issuer_key, a, z, count(*) AS c, max(name_key) AS short, max(t) AS t FROM f WHERE k = 2 GROUP BY ALL HAVING count(*) = 1),
l AS (SELECT *, row_number() OVER (PARTITION BY issuer_key, a, z ORDER BY t, name_key) AS i FROM f WHERE k > 2),
r AS (SELECT s.issuer_key, s.short, l1.name_key AS long, greatest(s.t, l1.t) AS valid_from, l2.t AS valid_until FROM s JOIN l l1 ON l1.issuer_key = s.issuer_key AND l1.a = s.a AND l1.z = s.z AND l1.i = 1
    LEFT JOIN l l2 ON l2.issuer_key = s.issuer_key AND l2.a = s.a AND l2.z = s.z AND l2.i = 2)
"""

SQL = {
    "brand_bars": _BARS + "SELECT brand, day, close FROM bars",
    "brand_benchmark": _BARS + "SELECT day, close FROM bench",
    "brand_events": _BARS + "SELECT brand, day FROM kept WHERE day IS NOT NULL",
    "brand_event_returns": _returns_sql(0) + _ROWS,
    "brand_placebo_returns": _returns_sql(252) + _ROWS,
    "brand_excess": _returns_sql(0)
    + """SELECT cell, count(*) AS n, round(avg(x), 5) AS mean, round(stddev_samp(x), 5) AS sd, round(CASE WHEN count(*) >= 2 AND stddev_samp(x) > 1e-12 THEN avg(x) / (stddev_samp(x) / sqrt(count(*))) END, 5) AS t,
        round(CASE WHEN count(*) >= 2 AND stddev_samp(x) > 1e-12 THEN (1.959964 + 0.841621) * stddev_samp(x) / sqrt(count(*)) END, 5) AS mde FROM x GROUP BY cell""",
    "brand_excess_clustered": _returns_sql(0)
    + """, mu AS (SELECT cell, count(*) AS n, avg(x) AS m FROM x GROUP BY cell), g AS (SELECT x.cell, x.brand, sum(x.x - mu.m) AS se, max(mu.n) AS n, max(mu.m) AS m FROM x JOIN mu ON mu.cell = x.cell GROUP BY ALL),
        a AS (SELECT cell, count(*) AS groups, max(n) AS n, max(m) AS m, CASE WHEN count(*) > 1 THEN sum(se * se) / (max(n) * max(n)) * count(*) / (count(*) - 1) END AS v FROM g GROUP BY cell)
        SELECT cell, n, groups, round(m, 5) AS mean, round(CASE WHEN groups >= 10 AND v > 1e-18 THEN m / sqrt(v) END, 5) AS t FROM a""",
    "brand_status_counts": _returns_sql(0)
    + """SELECT CASE WHEN grouping(a) = 1 THEN '(total)' ELSE a END AS row_value, CASE WHEN grouping(b) = 1 THEN '(total)' ELSE b END AS col_value, count(*) AS n
        FROM (SELECT CAST(horizon AS VARCHAR) AS a, status AS b FROM s) GROUP BY CUBE (a, b)""",
    "matched_control": """WITH p AS (SELECT * FROM mcap_points WHERE price_used > 0 AND issuer_key IS NOT NULL AND as_of_day IS NOT NULL), x AS (SELECT point_id, issuer_key, as_of_day, ln(mcap_sek) AS x FROM p WHERE mcap_sek > 0),
        j AS (SELECT a.point_id, a.issuer_key, a.as_of_day, b.issuer_key AS peer, row_number() OVER (PARTITION BY a.point_id ORDER BY abs(a.x - b.x), b.issuer_key) AS k FROM x a JOIN x b ON a.as_of_day = b.as_of_day AND a.issuer_key <> b.issuer_key AND abs(a.x - b.x) <= ln(2.0)),
        c AS (SELECT issuer_key, as_of_day, max(price_used) AS c FROM p GROUP BY ALL), r AS (SELECT a.issuer_key, a.as_of_day, b.c / a.c - 1 AS r FROM c a JOIN c b ON b.issuer_key = a.issuer_key AND CAST(b.as_of_day - INTERVAL 1 MONTH AS DATE) = a.as_of_day)
        SELECT j.point_id, j.peer, round(o.r, 6) AS own, round(q.r, 6) AS peers, round(o.r - q.r, 6) AS excess FROM j JOIN r o ON o.issuer_key = j.issuer_key AND o.as_of_day = j.as_of_day JOIN r q ON q.issuer_key = j.peer AND q.as_of_day = j.as_of_day WHERE j.k = 1""",
    "price_agreement": """WITH p AS (SELECT issuer_key, as_of_day, max(price_used) AS price_used FROM mcap_points WHERE price_used > 0 AND issuer_key IS NOT NULL GROUP BY ALL),
        j AS (SELECT t.row_id, t.issuer_key, t.trade_date, t.price, p.price_used FROM register_txns t ASOF JOIN p ON p.issuer_key = t.issuer_key AND t.trade_date >= p.as_of_day WHERE t.currency = 'SEK' AND t.price > 0 AND date_diff('day', p.as_of_day, t.trade_date) <= 40),
        k AS (SELECT *, CASE WHEN abs(price / price_used - 1) <= 0.1 THEN 1.0 ELSE 0.0 END AS inside, row_number() OVER (PARTITION BY issuer_key ORDER BY trade_date DESC, row_id DESC) AS n FROM j)
        SELECT issuer_key, count(*) AS n_trades, round(avg(inside), 6) AS share_all, round(avg(CASE WHEN n <= 20 THEN inside END), 6) AS share_recent FROM k GROUP BY issuer_key""",
    "share_growth": """WITH s AS (SELECT issuer_key, as_of_day, max(shares) AS shares FROM mcap_points WHERE shares > 0 AND issuer_key IS NOT NULL GROUP BY ALL),
        j AS (SELECT a.issuer_key, a.as_of_day, a.shares / b.shares - 1 AS growth, row_number() OVER (PARTITION BY a.issuer_key, a.as_of_day ORDER BY abs(date_diff('day', b.as_of_day, a.as_of_day) - 365), b.as_of_day) AS k
              FROM s a JOIN s b ON a.issuer_key = b.issuer_key AND date_diff('day', b.as_of_day, a.as_of_day) BETWEEN 180 AND 700) SELECT issuer_key, as_of_day, round(growth, 6) AS growth FROM j WHERE k = 1""",
    "trade_rhythm": """WITH m AS (SELECT issuer_key, name_key, date_trunc('month', trade_date) AS month, round(sum(volume), 2) AS v FROM register_txns WHERE issuer_key IS NOT NULL AND name_key IS NOT NULL AND trade_date IS NOT NULL AND volume IS NOT NULL GROUP BY ALL),
        c AS (SELECT issuer_key, name_key, count(*) AS n_months, quantile_cont(v, 0.5) AS med FROM m GROUP BY ALL)
        SELECT m.issuer_key, m.name_key, c.n_months, round(CASE WHEN max(c.med) > 0 THEN quantile_cont(abs(m.v - c.med), 0.5) / max(c.med) END, 6) AS dispersion FROM m JOIN c ON c.issuer_key = m.issuer_key AND c.name_key = m.name_key GROUP BY ALL""",
    "person_rules": _RULES + "SELECT * FROM r WHERE valid_until IS NULL OR valid_from < valid_until",
    "ruled_persons": _RULES
    + """SELECT t.row_id, coalesce(r.short, t.name_key) AS person FROM register_txns t LEFT JOIN r ON r.issuer_key = t.issuer_key AND r.long = t.name_key AND r.valid_from <= t.published_at AND (r.valid_until IS NULL OR t.published_at < r.valid_until)""",
    "pricing_summary": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_price, round(avg(l_discount), 2) AS avg_discount, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
    "region_year_totals": """SELECT region, year, round(sum(o_totalprice), 1) AS value, count(*) AS n FROM (SELECT r_name AS region, CAST(year(o_orderdate) AS BIGINT) AS year, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY ROLLUP (region, year)""",
    "event_sessions": """WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM e) SELECT user_id, session, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM s GROUP BY user_id, session""",
    "last_order_at_event": """WITH o AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS ordered, max(o_totalprice) AS o_totalprice FROM orders GROUP BY ALL)
        SELECT e.event_id, o.o_totalprice, o.ordered FROM events e ASOF LEFT JOIN o ON o.o_custkey = e.user_id AND CAST(e.ts AS DATE) >= o.ordered""",
}
