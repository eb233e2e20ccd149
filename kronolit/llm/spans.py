"""Long exact spans shared between records (problem 10)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kronolit.llm.tokens import blocks
from kronolit.session import checkpointed, stored

#: Characters of a shared span, and of the window whose hash is counted (a token is a character).
SPAN, GRAM = 160, 64
#: Keys by which surroundings meet: each demands all but 1/STEPS of the characters that a span needs beside its window.
STEPS = 8
#: Different surroundings under one key that are compared pair by pair; beyond it, exact spans are counted instead.
GROUP = 64
#: Base of the Rabin-Karp polynomial modulo 2^64 (odd, so that it has an inverse), and the longest stretch hashed at once.
BASE = 0x9E3779B97F4A7C15
STRETCH = 1 << 23


def _slide(x: np.ndarray, w: int, f: Callable) -> np.ndarray:
    """f over every window of w elements, by doubling."""
    k, y = 1, x
    while 2 * k <= w:
        y, k = f(y[:-k], y[k:]), 2 * k
    return f(y[: len(y) - (w - k)], y[w - k :]) if k < w else y


def window_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """Rabin-Karp hash of every window of ``gram`` codes, from prefix sums of code x BASE^i and inverse powers."""
    n = len(codes)
    up, down = np.full(n, BASE, dtype=np.uint64), np.full(n, pow(BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up, out=prefix[1:])
    h = (prefix[gram:] - prefix[:-gram]) * down[: n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def anchors(texts: list[str], span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and position of the windows that stand for all others.

    Every window of ``gram`` characters is hashed. Of the span - gram + 1 windows inside each stretch of ``span`` characters
    the least (the leftmost among equals) is kept. Equal stretches keep the same window at the same place, so two texts
    that share ``span`` characters share a kept window there, wherever the stretch stands in them.
    """
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    total, w = int(lens.sum()), span - gram + 1
    if total < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = window_hashes(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), gram)
    pos = np.arange(total) - np.repeat(np.cumsum(lens) - lens, lens)
    room = np.repeat(lens, lens) - pos
    low = np.uint64(STRETCH * 2 - 1)
    key = h & ~low | pos[: len(h)].astype(np.uint64)
    valid = room[: len(h)] >= gram
    key[~valid] = np.uint64(2**64 - 1)
    least = _slide(key, w, np.minimum)
    least = np.where(room[: len(least)] >= span, least, np.uint64(0))
    pad = np.zeros(w - 1, dtype=np.uint64)
    kept = np.flatnonzero((_slide(np.concatenate((pad, least, pad)), w, np.maximum)[: len(key)] == key) & valid)
    return h[kept], np.repeat(np.arange(len(texts)), lens)[kept], pos[kept]


def _anchor_rows(span: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[int, str] = {}
            for tid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.setdefault(tid, text)  # copies within a batch are one text
            parts = [(t, s, x[s : s + STRETCH]) for t, x in seen.items() for s in range(0, max(1, len(x) - span + 1), STRETCH - span + 1)]
            for a, b in blocks([p[2] for p in parts], 2_000_000):
                h, i, p = anchors([x[2] for x in parts[a:b]], span, gram)
                tids = np.array([x[0] for x in parts[a:b]], dtype=np.int64)
                starts = np.array([x[1] for x in parts[a:b]], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(tids[i]), pa.array((p + starts[i]).astype(np.int32))], names=["hash", "tid", "pos"])

    return run


def shared_keys(rows: DataFrame, key: str, by: str) -> DataFrame:
    """key, n: the keys that stand with more than one ``by``, and their number of rows. Counted with partial sums, so that a key that a
    third of all rows hold is one row a task."""
    g = rows.groupBy(key).agg(F.min(by).alias("lo"), F.max(by).alias("hi"), F.count("*").alias("n"))
    return g.where("lo != hi").select(key, "n")


def _surroundings(span: int, gram: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    side = span - gram

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for tid, text, occ in zip(pdf["tid"], pdf["text"], pdf["occ"], strict=True):
                for o in occ:
                    p = o["pos"]
                    rows.append((o["hash"], tid, p, min(p, side), text[max(0, p - side) : p + gram + side]))
            yield pd.DataFrame(rows, columns=["hash", "tid", "pos", "l", "ctx"])

    return run


def common(a: str, b: str) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        m = (lo + hi) // 2
        lo, hi = (m, hi) if a[:m] == b[:m] else (lo, m)
    return lo


LINK = "kind string, x long, y long, a int, b int, span long"


def _links(rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=["kind", "x", "y", "a", "b", "span"], dtype=object)
    return df.astype({"x": "Int64", "y": "Int64", "a": "Int64", "b": "Int64", "span": "Int64"})  # never through floats, which would round ids


def _compared(span: int, gram: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows in order of key: surroundings (cls, l, ctx, t0, t1) that agree in nearly what a span needs, few under each key. Links x, y
    with the equal characters left and right of the window."""
    side = span - gram

    def pairs(group: list[tuple]) -> Iterator[tuple]:
        for i in range(len(group)):
            ci, li, xi, s0, s1 = group[i]
            for j in range(i):
                cj, lj, xj, t0, t1 = group[j]
                if s0 == s1 == t0 == t1:  # one text alone
                    continue
                a = common(xi[:li][::-1], xj[:lj][::-1])
                b = common(xi[li + gram :], xj[lj + gram :])
                if a + b >= side:
                    yield ("pair", ci, cj, a, b, None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, group, out = None, [], []
        for pdf in batches:
            for k, *row in zip(pdf["key"], pdf["cls"], pdf["l"], pdf["ctx"], pdf["t0"], pdf["t1"], strict=True):
                if k != key:
                    out.extend(pairs(group))
                    key, group = k, []
                group.append(tuple(row))
            if out:
                yield _links(out)
                out = []
        out.extend(pairs(group))
        if out:
            yield _links(out)

    return run


def _listed(span: int, gram: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Surroundings (cls, l, ctx) of keys that hold many, in any order: each exact span around the window by its hash (y null)."""
    side = span - gram

    def spans(c: int, l: int, x: str) -> Iterator[tuple]:
        for s in range(max(0, l - side), min(l, len(x) - span) + 1):
            yield ("span", c, None, l - s, side - (l - s), xxhash.xxh3_64_intdigest(x[s : s + span].encode("utf-8", "surrogatepass")) - (1 << 63))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield _links([w for c, l, x in zip(pdf["cls"], pdf["l"], pdf["ctx"], strict=True) for w in spans(c, l, x)])

    return run


class SharedSpans:
    """The spans of at least ``span`` characters that stand verbatim in more than one record.

    1. Copies of a whole text are one text id (``tid``, 64-bit hash); text ids, not copies, meet from here on. 2. Rabin-Karp
    hashes of every window of ``gram`` characters; ``anchors`` keeps those that must be shared if a span is. 3. They are
    counted by hash with partial sums, and those in one text only are dropped. 4. What stands
    around a repeated window (span - gram characters on either side) decides: equal surroundings are one class; classes
    that agree in nearly all of the missing characters (``STEPS`` keys, one for each way to divide them between the sides)
    are compared; keys of more than ``limit`` such classes are not compared, nor brought into one task, but their exact spans are
    counted. Both ways are exact, and a phrase of many documents that is too short for a span brings nothing together. 5. A class is covered from its farthest agreement on the
    left to that on the right; the union of covered ranges of a text is exactly its shared part.

    Null texts and texts shorter than ``span`` share nothing, rows without an id neither. Repeated ids of one text are one record.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM, limit: int = GROUP) -> None:
        side = span - gram
        step = max(1, -(-side // STEPS))
        base = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
        long = base.where(F.col("doc").isNotNull() & (F.length("text") >= span)).withColumn("tid", F.xxhash64("text"))
        self.lengths = base.select("doc", F.length("text").alias("n_chars"))
        self.members_ = long.select("tid", "doc", F.length("text").alias("n")).distinct()
        rows = stored(long.select("tid", "text").mapInArrow(_anchor_rows(span, gram), "hash long, tid long, pos int"))  # hashed once, read twice
        occ = checkpointed(rows.join(shared_keys(rows, "hash", "tid"), "hash", "left_semi").distinct())
        one = self.members_.groupBy("tid").agg(F.min("doc").alias("doc"))
        wanted = occ.groupBy("tid").agg(F.collect_list(F.struct("hash", "pos")).alias("occ")).join(one, "tid")
        around = wanted.join(long.select("doc", "text"), "doc").select("tid", "text", "occ").mapInPandas(_surroundings(span, gram), "hash long, tid long, pos int, l int, ctx string")
        around = around.withColumn("cls", F.xxhash64("hash", "l", "ctx"))
        self.around = around = checkpointed(around)
        cls = around.groupBy("hash", "cls").agg(F.min("l").alias("l"), F.min("ctx").alias("ctx"), F.min("tid").alias("t0"), F.max("tid").alias("t1"))
        # agreement of b characters on the right, b from r on, needs side - b on the left: of each step one hashed key
        right, keys = F.length("ctx") - F.col("l") - gram, []
        for r in range(0, side, step):
            need = max(0, side - r - step + 1) if r + step < side else 0
            keys.append(F.when((F.col("l") >= need) & (right >= r), F.xxhash64("hash", F.lit(r), F.col("ctx").substr(F.col("l") - need + 1, F.lit(need + gram + r)))))
        cls = checkpointed(cls)
        asked = cls.select(F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias("key"), "cls")
        met = asked.join(shared_keys(asked, "key", "cls"), "key").join(cls.select("cls", "l", "ctx", "t0", "t1"), "cls")
        few = met.where(F.col("n") <= limit).repartition("key").sortWithinPartitions("key", "cls").mapInPandas(_compared(span, gram), LINK)
        many = met.where(F.col("n") > limit).select("cls", "l", "ctx").distinct().mapInPandas(_listed(span, gram), LINK)
        links = checkpointed(few.unionByName(many))
        counted = links.where("kind = 'span'").select(F.xxhash64("span", "a").alias("key"), "x", "a", "b").distinct()
        self.links = links.where("kind = 'pair'").select("x", "y", "a", "b")
        self.classes = cls.select("cls", "l", right.alias("r"), "t0", "t1")
        texts = counted.join(self.classes.select(F.col("cls").alias("x"), "t0", "t1"), "x").groupBy("key").agg(F.min("t0").alias("lo"), F.max("t1").alias("hi"))
        self.counted = counted.join(texts.where("lo < hi").select("key"), "key")
        self.gram, self.span = gram, span

    def text_pairs(self) -> DataFrame:
        """p, q (p < q): text ids that share a span."""
        m = self.around.select("cls", "tid").distinct()
        mates = m.join(self.classes.where("t0 != t1").select("cls"), "cls")
        same = mates.select("cls", F.col("tid").alias("p")).join(mates.select("cls", F.col("tid").alias("q")), "cls").select("p", "q")
        c = self.counted
        both = self.links.select("x", "y").unionByName(c.select("key", "x").join(c.select("key", F.col("x").alias("y")), "key").where("x < y").select("x", "y"))
        both = both.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        cross = both.join(m.select(F.col("cls").alias("x"), F.col("tid").alias("p")), "x").join(m.select(F.col("cls").alias("y"), F.col("tid").alias("q")), "y").select("p", "q")
        return same.unionByName(cross).where("p != q").select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()

    def members(self) -> DataFrame:
        """doc_id, rep: every record with a text of at least ``span`` characters and the record that stands for all with the same text."""
        one = self.members_.groupBy("tid").agg(F.min("doc").alias("rep"))
        return self.members_.join(one, "tid").select(F.col("doc").alias("doc_id"), "rep").distinct()

    def links_of_representatives(self) -> DataFrame:
        """rep_a, rep_b (a < b): the representatives of different texts that share a span; no copy is expanded."""
        one = self.members_.groupBy("tid").agg(F.min("doc").alias("doc"))
        x, y = one.select(F.col("tid").alias("p"), F.col("doc").alias("a")), one.select(F.col("tid").alias("q"), F.col("doc").alias("b"))
        t = self.text_pairs().join(x, "p").join(y, "q").where("a != b")
        return t.select(F.least("a", "b").alias("rep_a"), F.greatest("a", "b").alias("rep_b")).distinct()

    def pairs(self) -> DataFrame:
        """doc_id_a, doc_id_b (a < b): records that share a span; copies of whole texts are expanded here, at the very end."""
        m = self.members_.select("tid", "doc").distinct()
        x = m.select(F.col("tid").alias("p"), F.col("doc").alias("a"))
        y = m.select(F.col("tid").alias("q"), F.col("doc").alias("b"))
        other = self.text_pairs().join(x, "p").join(y, "q").select("a", "b")
        many = m.groupBy("tid").agg(F.count("*").alias("n")).where("n > 1").select("tid")
        few = m.join(many, "tid")
        copies = few.select("tid", F.col("doc").alias("a")).join(few.select("tid", F.col("doc").alias("b")), "tid").where("a < b").select("a", "b")
        return other.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).unionByName(copies.toDF("doc_id_a", "doc_id_b")).distinct()

    def ranges(self) -> DataFrame:
        """tid, start, end: the maximal ranges of each text id (0-based, end exclusive) that other text ids share."""
        ext = self.links.select(F.col("x").alias("cls"), "a", "b").unionByName(self.links.select(F.col("y").alias("cls"), "a", "b"))
        ext = ext.unionByName(self.counted.select(F.col("x").alias("cls"), "a", "b"))
        ext = ext.unionByName(self.classes.where("t0 != t1").select("cls", F.col("l").alias("a"), F.col("r").alias("b")))
        ext = ext.groupBy("cls").agg(F.max("a").alias("a"), F.max("b").alias("b"))
        r = self.around.join(ext, "cls").select("tid", (F.col("pos") - F.col("a")).alias("start"), (F.col("pos") + self.gram + F.col("b")).alias("end"))
        w = Window.partitionBy("tid").orderBy("start", "end")
        r = r.withColumn("reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        r = r.withColumn("part", F.sum((F.col("reach").isNull() | (F.col("start") > F.col("reach"))).cast("int")).over(w))
        return r.groupBy("tid", "part").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("part")

    def shares(self) -> DataFrame:
        """doc_id, n_chars, shared_chars, share of every record: what of it stands elsewhere; a copied text is shared whole."""
        part = self.ranges().groupBy("tid").agg(F.sum(F.col("end") - F.col("start")).alias("part"))
        count = self.members_.groupBy("tid").agg(F.count("*").alias("copies"))
        m = self.members_.join(count, "tid").join(part, "tid", "left")
        m = m.groupBy("doc").agg(F.max(F.when(F.col("copies") > 1, F.col("n")).otherwise(F.coalesce("part", F.lit(0)))).alias("shared"))
        out = self.lengths.join(m, "doc", "left").select(F.col("doc").alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), F.coalesce("shared", F.lit(0)).cast("long").alias("shared_chars"))
        return out.withColumn("share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0))
