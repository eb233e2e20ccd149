"""Rows with the time they were true and the time they were visible: one read path for every decision instant."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kronolit.operators.intervals import bucketed_interval_join


@dataclass(frozen=True)
class Register:
    """A table with ``entity``, ``valid`` (day something happened), ``visible_from`` and ``visible_until`` (null: still visible)."""

    rows: DataFrame
    entity: str = "issuer_key"
    valid: str = "trade_date"
    visible_from: str = "visible_from"
    visible_until: str = "visible_until"

    def visible(self, as_of: Column, since: Column | None = None) -> DataFrame:
        """The rows visible at an instant (inclusive start, exclusive end), of days from ``since`` on. A plain filter."""
        ok = (F.col(self.visible_from) <= as_of) & (F.col(self.visible_until).isNull() | (F.col(self.visible_until) > as_of))
        return self.rows.where(ok if since is None else ok & (F.col(self.valid) >= since))

    def timeline(self, entity: Column | None = None) -> DataFrame:
        """The rows that were visible at some time, of one entity or of all, in order of appearing."""
        ever = F.col(self.visible_from).isNotNull() & (F.col(self.visible_until).isNull() | (F.col(self.visible_until) > F.col(self.visible_from)))
        return self.rows.where(ever if entity is None else ever & (F.col(self.entity) == entity)).orderBy(self.entity, self.visible_from)

    def daily_for(self, events: DataFrame, event_day: str, lookback: int, measures: dict[str, str]) -> DataFrame:
        """Each (entity, event_day) with n_rows, first_day, last_day and the sums ``measures`` (name -> column) of the rows
        visible at the end of that day whose valid day lies in the ``lookback`` days before it.

        Rows are first added up per (entity, valid day, day of appearing, day of vanishing), so that the number of register rows
        of an entity does not matter; the sums meet the events by time bucket.
        """
        start, end = F.to_date(self.visible_from), F.to_date(self.visible_until)
        cells = self.rows.where(F.col(self.valid).isNotNull() & F.col(self.visible_from).isNotNull()).groupBy(F.col(self.entity).alias("_e"), F.col(self.valid).cast("date").alias("_v"), start.alias("_s"), end.alias("_u"))
        cells = cells.agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_m_{m}") for m, c in measures.items()])
        # a cell counts from when it has happened and appeared until it vanishes or is too old: one interval, joined by bucket
        over = F.date_add("_v", lookback + 1)
        cells = cells.withColumns({"_from": F.greatest("_v", "_s"), "_to": F.least(over, F.coalesce("_u", over))}).drop("_s", "_u").withColumnRenamed("_e", self.entity)
        ev = events.select(F.col(self.entity), F.col(event_day).cast("date").alias(event_day)).dropna().distinct()
        j = bucketed_interval_join(ev, cells, self.entity, event_day, "_from", "_to", width=max(32, lookback // 4))
        return j.groupBy(self.entity, event_day).agg(F.sum("_n").alias("n_rows"), F.min("_v").alias("first_day"), F.max("_v").alias("last_day"), *[F.sum(f"_m_{m}").alias(m) for m in measures])


def with_visibility(rows: DataFrame, keys: list[str], published: str, amendment: str, tie: str, first_publication: bool = False) -> DataFrame:
    """``rows`` with visible_from and visible_until: a row is superseded when the next amendment with equal keys (nulls are
    equal) is published after it in the order of (published, tie). ``first_publication``: visible from the first row of its keys.
    Rows without a publication time are never visible and supersede nothing."""
    # backwards, so that the frame of what is later grows from row to row
    w = Window.partitionBy(*keys).orderBy(F.desc(published), F.desc(tie))
    until = F.min(F.when(F.col(amendment), F.col(published))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    start = F.when(F.col(published).isNotNull(), F.min(published).over(Window.partitionBy(*keys))) if first_publication else F.col(published)
    return rows.withColumn("visible_from", start).withColumn("visible_until", until)


LINK = ["row_id", "linked_to", "score", "ambiguous", "published", "first"]


def _link_groups(weights: list[float]):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, group, out = None, [], []

        def close() -> None:
            taken: set = set()
            first: dict = {}
            for i, (rid, published, amends, _, values) in enumerate(group):
                if not amends:
                    continue
                best = None
                for j in range(i - 1, -1, -1):
                    oid, before, _, least, other = group[j]
                    if oid in taken or not before < published:
                        continue
                    score = sum(w for w, a, b in zip(weights, values, other, strict=True) if a is not None and a == b)
                    if score < least:
                        continue
                    if best is None or score > best[0]:
                        best = (score, oid, False, before, False)
                    elif score == best[0]:
                        best = (*best[:2], True, best[3], best[4] or before == best[3])
                if best is not None and not best[4]:
                    taken.add(best[1])
                    first[rid] = first.get(best[1], best[3])
                    out.append((rid, best[1], float(best[0]), best[2], published, first[rid]))
                elif best is not None:
                    out.append((rid, None, float(best[0]), True, published, published))
                else:
                    out.append((rid, None, 0.0, False, published, published))

        for pdf in batches:
            values = list(zip(*[pdf[c] for c in pdf.columns if c.startswith("v")], strict=True)) or [()] * len(pdf)
            for k, rid, t, a, m, v in zip(pdf["k"], pdf["rid"], pdf["t"], pdf["a"], pdf["m"], values, strict=True):
                if k != key:
                    close()
                    key, group = k, []
                group.append((rid, t, a, m, tuple(None if pd.isna(x) else x for x in v)))
            if out:
                yield pd.DataFrame(out, columns=LINK).astype({"linked_to": "Int64"})
                out = []
        close()
        if out:
            yield pd.DataFrame(out, columns=LINK).astype({"linked_to": "Int64"})

    return run


def link_revisions(rows: DataFrame, keys: list[str], published: str, amendment: str, row_id: str, weights: dict[str, float], least: Column | None = None, needed: tuple[str, ...] = ()) -> DataFrame:
    """row_id, linked_to, score, ambiguous of every amendment: the earlier row of its keys that it replaces, one to one.

    Amendments are taken in order of publication; each takes, of the rows published strictly before it that none has taken,
    the one with the greatest sum of weights of equal columns (null equals nothing); a tie goes to the latest and is marked.
    A tie in publication too is marked, links nothing and takes no row. ``least``: the sum that a row demands of the amendment
    that is to replace it (default and null: 0). Without a candidate linked_to is null. Null keys are equal, but rows that lack one of
    ``needed`` are of no group: they link to nothing and do not come out. Only rows whose keys have an amendment take part; copies of a
    row differ in row_id. What is held is the rows of one key, here one person's filings for one day of one issuer.
    """
    return _links(rows, keys, published, amendment, row_id, weights, least, needed).select(*LINK[:4])


def _links(rows: DataFrame, keys: list[str], published: str, amendment: str, row_id: str, weights: dict[str, float], least: Column | None, needed: tuple[str, ...] = ()) -> DataFrame:
    """``link_revisions`` with the publication of the amendment and of the first row of its chain."""
    k = F.struct(*keys)
    pool = rows.where(F.col(published).isNotNull() & F.col(row_id).isNotNull())
    for c in needed:
        pool = pool.where(F.col(c).isNotNull())
    pool = pool.withColumn("k", F.sha2(F.to_json(k, {"ignoreNullFields": "false"}), 256))
    pool = pool.join(pool.where(F.col(amendment)).select("k").distinct(), "k", "left_semi")
    cols = [F.col(c).cast("string").alias(f"v{i}") for i, c in enumerate(weights)]
    lean = pool.select("k", F.col(row_id).alias("rid"), F.col(published).alias("t"), F.coalesce(F.col(amendment), F.lit(False)).alias("a"), F.coalesce(F.lit(0.0) if least is None else least.cast("double"), F.lit(0.0)).alias("m"), *cols)
    tt = dict(lean.dtypes)["t"]
    return lean.repartition("k").sortWithinPartitions("k", "t", "rid").mapInPandas(_link_groups(list(weights.values())), f"row_id long, linked_to long, score double, ambiguous boolean, published {tt}, first {tt}")


def with_linked_visibility(rows: DataFrame, keys: list[str], published: str, amendment: str, row_id: str, weights: dict[str, float], least: Column | None = None, revised: Column | None = None, person: list[str] | None = None, first_publication: bool = False, needed: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with visible_from and visible_until: a row is superseded when the one amendment that ``link_revisions`` links to
    it is published; all other rows of its keys stay visible.

    ``revised``: rows known to have been replaced. Those that no amendment links to end with the next amendment of the
    ``person`` (key columns; a null is no person), and are never visible without one. ``first_publication``: visible from the
    first row of their chain. Rows without a publication time are never visible and supersede nothing. ``row_id`` is unique.
    """
    links = _links(rows, keys, published, amendment, row_id, weights, least, needed)
    until = links.where(F.col("linked_to").isNotNull()).select(F.col("linked_to").alias("_id"), F.col("published").alias("visible_until"))
    out = rows.join(until, F.col(row_id) == F.col("_id"), "left").drop("_id")
    if revised is not None:
        # instants are numbered backwards, so that the frame of what is later grows from row to row and leaves equal instants out
        at = out.withColumn("_nth", F.dense_rank().over(Window.partitionBy(*person).orderBy(F.desc(published))))
        later = F.min(F.when(F.col(amendment), F.col(published))).over(Window.partitionBy(*person).orderBy("_nth").rangeBetween(Window.unboundedPreceding, -1))
        known = F.lit(True)
        for c in person:
            known = known & F.col(c).isNotNull()
        orphan = F.coalesce(revised, F.lit(False)) & F.col("visible_until").isNull()
        out = at.withColumn("_later", later).withColumn("visible_until", F.when(orphan, F.coalesce(F.when(known, F.col("_later")), F.col(published))).otherwise(F.col("visible_until"))).drop("_nth", "_later")
    if not first_publication:
        return out.withColumn("visible_from", F.col(published))
    first = links.select(F.col("row_id").alias("_id"), F.col("first").alias("_first"))
    return out.join(first, F.col(row_id) == F.col("_id"), "left").withColumn("visible_from", F.coalesce("_first", published)).drop("_id", "_first")
