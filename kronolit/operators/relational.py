"""Counts, totals, agreement and gaps: grouped summaries that a profile of a table is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def crosstab_totals(df: DataFrame, row: Column, col: Column, missing: str = "(none)", total: str = "(total)") -> DataFrame:
    """row_value, col_value, n with totals of rows, of columns and of all, by grouping sets. Nulls are the label ``missing``."""
    d = df.select(F.coalesce(row.cast("string"), F.lit(missing)).alias("_r"), F.coalesce(col.cast("string"), F.lit(missing)).alias("_c"))
    g = d.cube("_r", "_c").agg(F.count("*").alias("n"), F.grouping("_r").alias("_gr"), F.grouping("_c").alias("_gc"))
    return g.select(F.when(F.col("_gr") == 1, total).otherwise(F.col("_r")).alias("row_value"), F.when(F.col("_gc") == 1, total).otherwise(F.col("_c")).alias("col_value"), "n")


def top_and_others(df: DataFrame, col: str, k: int, others: str = "(others)", missing: str = "(none)") -> DataFrame:
    """value, n, n_values: the k most frequent values (ties by value) and one row for all others."""
    c = df.groupBy(F.coalesce(F.col(col).cast("string"), F.lit(missing)).alias("value")).agg(F.count("*").alias("n"))
    top = c.orderBy(F.desc("n"), "value").limit(k).withColumn("_top", F.lit(True))
    return c.join(top.select("value", "_top"), "value", "left").groupBy(F.when(F.col("_top"), F.col("value")).otherwise(others).alias("value")).agg(F.sum("n").alias("n"), F.count("*").alias("n_values"))


def only_value(df: DataFrame, key: str, col: str, name: str = "only") -> DataFrame:
    """key and its only distinct non-null value; null where there are several or none."""
    return df.groupBy(key).agg(F.when(F.min(col) == F.max(col), F.min(col)).alias(name))


def most_frequent(df: DataFrame, key: str, col: str, name: str = "value") -> DataFrame:
    """key, its most frequent non-null value (the lowest on a tie), its count and share, and the number of values.

    Counting by (key, value) first keeps a hot key's rows from meeting; only its distinct values do.
    """
    c = df.where(F.col(col).isNotNull()).groupBy(key, col).agg(F.count("*").alias("_n"))
    g = c.groupBy(key).agg(F.min(F.struct((-F.col("_n")).alias("m"), F.col(col).alias("v"))).alias("_b"), F.sum("_n").alias("_t"), F.count("*").alias("n_values"))
    return g.select(key, F.col("_b.v").alias(name), (-F.col("_b.m")).alias("n"), (-F.col("_b.m") / F.col("_t")).alias("share"), "n_values")


def day_gaps(df: DataFrame, day: Column) -> DataFrame:
    """day: the weekdays between the first and the last day of the table on which it has no row."""
    d = df.select(day.cast("date").alias("day")).where(F.col("day").isNotNull()).distinct()
    ends = d.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    all_days = ends.where(F.col("a").isNotNull()).select(F.explode(F.sequence("a", "b")).alias("day")).where(F.weekday("day") < 5)
    return all_days.join(d, "day", "left_anti")


def group_quantiles(df: DataFrame, key: Column, value: Column, probs: dict[str, float], name: str = "key") -> DataFrame:
    """name, n, one column per quantile (exact, linear between neighbours). A key's values are counted by value, so repeated
    values are merged before they meet."""
    d = df.select(key.alias(name), value.cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    return d.groupBy(name).agg(F.count("*").alias("n"), *[F.percentile("_v", F.lit(p)).alias(c) for c, p in probs.items()])


def repeated_rows(df: DataFrame, fields: list[str]) -> DataFrame:
    """copies, n_groups, n_rows: how many groups of rows equal in ``fields`` (nulls equal) have each number of copies."""
    g = df.groupBy(*fields).agg(F.count("*").alias("copies"))
    return g.groupBy("copies").agg(F.count("*").alias("n_groups"), F.sum("copies").alias("n_rows"))


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each group in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def seeded_sample(df: DataFrame, row_id: str, n: int, seed: int) -> DataFrame:
    """``n`` rows in the order of a hash of seed and id: the same rows wherever and however often the table is read."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(row_id).cast("string"))), row_id).limit(n)


def calendar_pattern(rows: DataFrame, keys: list[str], day: str, as_of: Column, blocks: int = 3, length: int = 365) -> DataFrame:
    """keys, label: how a key's days lie in the ``blocks`` stretches of ``length`` days before ``as_of``: ``novel`` (none), ``sparse`` (not
    in all), ``routine`` (one calendar month in all), else ``opportunistic``. A key holds at most twelve months a stretch. Null days
    count as none, null keys are keys."""
    age = F.datediff(as_of, F.col(day))
    r = rows.select(*keys, F.month(day).alias("_m"), F.when((age > 0) & (age < blocks * length), F.floor(age / length).cast("int")).alias("_b"))
    g = r.groupBy(*keys).agg(*[F.collect_set(F.when(F.col("_b") == b, F.col("_m"))).alias(f"_s{b}") for b in range(blocks)])
    sets = [F.col(f"_s{b}") for b in range(blocks)]
    common, some, all_ = sets[0], F.lit(False), F.lit(True)
    for x in sets:
        common, some, all_ = F.array_intersect(common, x), some | (F.size(x) > 0), all_ & (F.size(x) > 0)
    return g.select(*keys, F.when(~some, "novel").when(~all_, "sparse").when(F.size(common) > 0, "routine").otherwise("opportunistic").alias("label"))


def median_between(df: DataFrame, value: str, low: float, high: float) -> float:
    """The median of a column, which has to lie strictly between two bounds, as a series the right way up does."""
    m = df.agg(F.percentile(F.col(value), F.lit(0.5))).first()[0]
    if m is None or not low < m < high:
        raise ValueError(f"median of {value} is {m}, not between {low} and {high}")
    return m
