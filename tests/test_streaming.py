import datetime as dt

from pyspark.sql import functions as F

from kronolit.operators.changes import newest_first
from kronolit.operators.identity import apply_rules, merge_rules
from kronolit.operators.sequence import detect_episodes
from kronolit.sources.fetch import BudgetSpent, ExportFull, WindowFetcher
from kronolit.streaming.feed import current_state, flag_late, stream_changes, stream_episodes, stream_window_replace, windowed_counts

ORDER = {"key": "record_id", "order": ["published_at", "seq"], "delivery": "feed_id", "op": "op"}


def files(spark, df, path, n=3):
    df.repartition(n).write.parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_feed_stream_equals_batch(spark, data, tmp_path):
    feed = spark.read.parquet(f"{data}/register_feed.parquet")
    stream_changes(files(spark, feed, tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    got = {tuple(r) for r in current_state(spark, str(tmp_path / "log"), **ORDER).collect()}
    assert got == {tuple(r) for r in newest_first(feed, **ORDER).collect()}


def test_window_replace(spark, tmp_path):
    target = str(tmp_path / "t")
    spark.createDataFrame([("d1", 1), ("d2", 2)], "day string, v int").write.partitionBy("day").parquet(target)
    new = spark.createDataFrame([("d2", 5), ("d3", 6)], "day string, v int")
    stream_window_replace(files(spark, new, tmp_path / "in", 1), target, "day", str(tmp_path / "cp")).awaitTermination()
    assert sorted((r["day"], r["v"]) for r in spark.read.parquet(target).collect()) == [("d1", 1), ("d2", 5), ("d3", 6)]


def test_windowed_counts(spark, data, tmp_path):
    feed = spark.read.parquet(f"{data}/register_feed.parquet").select("published_at", "op")
    q = windowed_counts(files(spark, feed, tmp_path / "in"), "published_at", "op", late="4000 days").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["window_start"], r["key"], r["n"]) for r in spark.table("counts").collect()}
    want = feed.groupBy(F.window(F.col("published_at").cast("timestamp"), "30 days").alias("w"), "op").count().select("w.start", "op", "count")
    assert got == {tuple(r) for r in want.collect()}


def test_episode_stream_equals_batch(spark, tmp_path):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    rows = [("a", f"p{i % 4}", day(i * 7), dt.datetime(2024, 1, 1) + dt.timedelta(days=i * 7 + 1)) for i in range(20)] + [("b", "p", day(1), dt.datetime(2024, 2, 1))]
    df = spark.createDataFrame(rows, "k string, p string, d date, t timestamp")
    s = stream_episodes(files(spark, df, tmp_path / "in", 1), "k", "p", "d", "t")
    q = s.writeStream.format("memory").queryName("episodes").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["k"], r["as_of"], r["anchor"], r["n_persons"]) for r in spark.table("episodes").collect())
    assert got == sorted((r["k"], r["as_of"], r["anchor"], r["n_persons"]) for r in detect_episodes(df, "k", "p", "d", "t").collect()) and got


def test_merge_rules(spark):
    t = lambda m, d=1: dt.datetime(2020, m, d)
    names = spark.createDataFrame([("i", "eva ek", t(1)), ("i", "eva maria ek", t(3)), ("i", "eva lena ek", t(6)), ("j", "eva ek", t(1)), ("i", None, t(1)), ("i", "eva", t(1))], "issuer string, name string, seen timestamp_ntz")
    rules = merge_rules(names, "issuer", "name", "seen")
    assert [tuple(r) for r in rules.collect()] == [("i", "eva ek", "eva maria ek", t(3), t(6))]
    rows = spark.createDataFrame([("i", "eva maria ek", t(1, 15)), ("i", "eva maria ek", t(3)), ("i", "eva maria ek", t(7)), ("j", "eva maria ek", t(4)), (None, None, t(4))], "issuer string, name string, at timestamp_ntz")
    got = sorted((str(r["at"]), str(r["person"])) for r in apply_rules(rows, rules, "issuer", "name", "at").collect())
    assert got == [("2020-01-15 00:00:00", "eva maria ek"), ("2020-03-01 00:00:00", "eva ek"), ("2020-04-01 00:00:00", "None"), ("2020-04-01 00:00:00", "eva maria ek"), ("2020-07-01 00:00:00", "eva maria ek")]


def test_fetcher():
    def fetch(a, b):
        return [a + dt.timedelta(days=i) for i in range((b - a).days + 1) for _ in range(300)][:1000]

    f = WindowFetcher(fetch)
    rows = f.range(dt.date(2024, 1, 1), dt.date(2024, 1, 10))
    assert len(rows) == 3000 and len(f.log) == 7
    try:
        WindowFetcher(lambda a, b: [0] * 1000).range(dt.date(2024, 1, 1), dt.date(2024, 1, 1))
        raise AssertionError
    except ExportFull:
        pass
    try:
        WindowFetcher(fetch, budget=3).range(dt.date(2024, 1, 1), dt.date(2024, 1, 10))
        raise AssertionError
    except BudgetSpent:
        pass


def test_late_rows_are_kept_and_marked(spark, tmp_path):
    d = dt.date
    rows = [(1, d(2024, 1, 1), d(2024, 1, 3)), (2, d(2024, 1, 1), d(2024, 3, 1)), (3, None, d(2024, 1, 1)), (4, d(2024, 1, 5), d(2024, 1, 4))]
    df = spark.createDataFrame(rows, "i int, at date, seen date")
    want = {1: (2, False), 2: (60, True), 3: (None, None), 4: (-1, False)}
    assert {r["i"]: (r["days_late"], r["is_late"]) for r in flag_late(df, "at", "seen", 30).collect()} == want
    df.write.parquet(f"{tmp_path}/in")
    stream = flag_late(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "at", "seen", 30)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    assert {r["i"]: (r["days_late"], r["is_late"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want
