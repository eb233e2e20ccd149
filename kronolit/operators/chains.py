"""Following links from row to row to their end, and what links say of a row's standing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kronolit.session import checkpointed


def chase(links: DataFrame, child: str, parent: str) -> DataFrame:
    """child, root, hops: where the links of each child lead in the end, and over how many.

    Pointers are doubled: every round joins each pointer to the one it points at, so a chain of n links takes log n rounds, each
    an equi-join written to the shared checkpoint folder. Nothing is collected but one number a round. Links with a null on either
    side are left out; of several parents of a child the least counts. A circle has no end and raises an error.
    """
    p = links.where(F.col(child).isNotNull() & F.col(parent).isNotNull()).groupBy(F.col(child).alias("c")).agg(F.min(parent).alias("up"))
    p = checkpointed(p.select("c", "up", F.lit(1).cast("long").alias("hops")))
    for _ in range(64):
        ahead = p.select(F.col("c").alias("up"), F.col("up").alias("far"), F.col("hops").alias("more"))
        p = checkpointed(p.join(ahead, "up", "left").select("c", F.coalesce("far", "up").alias("up"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("far").isNotNull().alias("moved")))
        if p.agg(F.max("moved")).first()[0] is not True:
            return p.select(F.col("c").alias(child), F.col("up").alias("root"), "hops")
        p = p.drop("moved")
    raise ValueError("links run in a circle")


def standing(rows: DataFrame, links: DataFrame, row_id: str, revised: Column, cancelled: Column) -> DataFrame:
    """``rows`` with chain_status: ``cancelled``; ``superseded`` if a link replaces a row marked as ``revised``, ``superseded_inferred``
    if it replaces one that is not; ``orphan_revised`` if a row is marked as revised and no link replaces it; else ``current``.
    ``links``: row_id, linked_to. Null marks are false."""
    by = links.where(F.col("linked_to").isNotNull()).select(F.col("linked_to").alias("_id")).distinct().withColumn("_hit", F.lit(True))
    j = rows.join(by, F.col(row_id) == F.col("_id"), "left")
    mark, gone = F.coalesce(revised, F.lit(False)), F.coalesce(cancelled, F.lit(False))
    status = F.when(gone, "cancelled").when(F.col("_hit") & mark, "superseded").when(F.col("_hit"), "superseded_inferred").when(mark, "orphan_revised").otherwise("current")
    return j.withColumn("chain_status", status).drop("_id", "_hit")
