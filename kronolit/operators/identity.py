"""Rules that merge spellings from a day on, and their use as of an instant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_rules(names: DataFrame, group: str, name: str, first_seen: str) -> DataFrame:
    """group, short, long, valid_from, valid_until: a two-word form means the longer form of the same first and last word.

    A rule exists where one group has exactly one two-word form and at least one longer one with its first and last word. It is
    valid from when both had been seen and ends when a second longer form appears. Names of one word, nulls and rows without a
    time make no rules; repeated names count from their first time.
    """
    n = names.select(F.col(group).alias("g"), F.col(name).alias("n"), F.col(first_seen).alias("t")).dropna().groupBy("g", "n").agg(F.min("t").alias("t"))
    words = F.split("n", " ")
    n = n.withColumn("w", F.size(words)).where("w >= 2").withColumn("a", words[0]).withColumn("z", F.element_at(words, -1))
    short = F.collect_list(F.when(F.col("w") == 2, F.struct("t", "n")))
    long = F.array_sort(F.collect_list(F.when(F.col("w") > 2, F.struct("t", "n"))))
    g = n.groupBy("g", "a", "z").agg(short.alias("s"), long.alias("l")).where((F.size("s") == 1) & (F.size("l") >= 1))
    first, second = F.col("l")[0], F.get(F.col("l"), F.lit(1))
    rule = g.select(F.col("g").alias(group), F.col("s")[0]["n"].alias("short"), first["n"].alias("long"), F.greatest(F.col("s")[0]["t"], first["t"]).alias("valid_from"), second["t"].alias("valid_until"))
    return rule.where(F.col("valid_until").isNull() | (F.col("valid_from") < F.col("valid_until")))


def apply_rules(rows: DataFrame, rules: DataFrame, group: str, name: str, at: str, out: str = "person") -> DataFrame:
    """``rows`` with ``out``: the short form where a rule for the long one is valid at ``at``, else the name itself."""
    r = rules.select(F.col(group).alias("_g"), F.col("long").alias("_n"), "short", "valid_from", "valid_until")
    on = (F.col(group) == F.col("_g")) & (F.col(name) == F.col("_n")) & (F.col("valid_from") <= F.col(at)) & (F.col("valid_until").isNull() | (F.col(at) < F.col("valid_until")))
    return rows.join(r, on, "left").select(*rows.columns, F.coalesce("short", F.col(name)).alias(out))
