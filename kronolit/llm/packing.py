"""Filling fixed-capacity containers with items of varying length (problem 9)."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kronolit.llm.tokens import BatchEncoder, Merges, blocks, tokenizer_path
from kronolit.session import checkpointed

#: Tokens a container holds; items a block (shard of the index) holds; number of hashed terms, which bounds the table of
#: document frequencies; tokens of room that a better neighbour is worth; BM25 constants.
CAPACITY, BLOCK, TERMS, SLACK, K1, B = 1024, 4096, 1 << 18, 4, 1.2, 0.75


def _terms_of(words: list[str], terms: int) -> np.ndarray:
    """The hashed term of each pre-token: a word of letters, case folded; -1 for anything else."""
    import xxhash

    return np.fromiter((xxhash.xxh32_intdigest(w.strip().lower()) % terms if w.strip().isalpha() else -1 for w in words), dtype=np.int64, count=len(words))


def _sizer(shared, terms: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    """Token count, distinct hashed terms and how often each stands there, of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = BatchEncoder(shared.value, lambda words: _terms_of(words, terms))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in blocks(texts):
                index, counts = enc.pretokens(texts[a:b])
                owner = np.repeat(np.arange(b - a), counts)
                size, t = np.zeros(b - a, dtype=np.int64), np.zeros(0, dtype=np.int64)
                if len(index):
                    size = np.bincount(owner, weights=np.diff(enc.starts)[index], minlength=b - a).astype(np.int64)
                    t = enc.extra[index]
                both, often = np.unique(owner[t >= 0] * terms + t[t >= 0], return_counts=True)
                ends = np.zeros(b - a + 1, dtype=np.int32)
                np.cumsum(np.bincount(both // terms, minlength=b - a), out=ends[1:])
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (both % terms, often)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(size), *lists], names=["id", "grp", "size", "terms", "often"])

    return run


class Shard:
    """The inverted index of a block under BM25. ``drop`` leaves out items once half of the indexed ones are used."""

    def __init__(self, terms: list[np.ndarray], often: list[np.ndarray], idf: np.ndarray, mean_length: float) -> None:
        self.terms, n = terms, len(terms)
        owner, flat = np.repeat(np.arange(n), np.fromiter(map(len, terms), dtype=np.int64, count=n)), np.concatenate(terms) if n else np.zeros(0, dtype=np.int64)
        tf = np.concatenate(often).astype(float) if n else np.zeros(0)
        length = np.bincount(owner, weights=tf, minlength=n)
        weight = idf[flat] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[owner] / max(mean_length, 1e-9)))
        order = np.argsort(flat, kind="stable")
        self.n, self.post, self.weight, self.flat = n, owner[order], weight[order], flat[order]
        self._bounds()

    def _bounds(self) -> None:
        self.known, self.lo = np.unique(self.flat, return_index=True)
        self.hi = np.append(self.lo[1:], len(self.flat))

    def drop(self, unused: np.ndarray) -> None:
        keep = unused[self.post]
        self.post, self.weight, self.flat = self.post[keep], self.weight[keep], self.flat[keep]
        self._bounds()

    def scores(self, item: int) -> np.ndarray:
        """BM25 of every indexed item for the words of ``item``."""
        t = self.terms[item]
        if not len(t) or not len(self.known):
            return np.zeros(self.n)
        at = np.minimum(np.searchsorted(self.known, t), len(self.known) - 1)
        at = at[self.known[at] == t]
        lo, size = self.lo[at], self.hi[at] - self.lo[at]
        ends = np.cumsum(size)
        rows = np.repeat(lo - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)
        return np.bincount(self.post[rows], weights=self.weight[rows], minlength=self.n)


def pack_block(size: np.ndarray, terms: list[np.ndarray], often: list[np.ndarray], idf: np.ndarray, mean_length: float, capacity: int) -> list[list[int]]:
    """Containers (lists of item numbers) of a block whose items are no larger than ``capacity``.

    The largest unused item is the seed. The block's BM25 index scores all unused items for it; of those that fit, the one of
    the most related text (score x size^2, so that long ones go before the gaps that only short ones can close) is taken, again
    and again. When none is left, the largest unused item that fits closes the gap, and where room is still left, the last
    item is exchanged for the best scored of the largest ones (within ``SLACK`` tokens) that fit in its stead.
    """
    n = len(size)
    shard = Shard(terms, often, idf, mean_length)
    unused, indexed = np.ones(n, dtype=bool), n
    room_list = sorted((int(s), i) for i, s in enumerate(size))
    out = []
    while room_list:
        s, seed = room_list.pop()
        unused[seed] = False
        box, room, score = [seed], capacity - s, size
        if room > 0:
            if 2 * len(room_list) < indexed:
                shard.drop(unused)
                indexed = len(room_list)
            score = shard.scores(seed)
            value = np.where(unused & (size <= room), score * size.astype(float) ** 2, 0.0)
            while room > 0:
                best = int(value.argmax())
                if value[best] <= 0:
                    break
                box.append(best)
                unused[best] = False
                room_list.pop(bisect_right(room_list, (int(size[best]), best)) - 1)
                room -= int(size[best])
                value[best] = 0
                value[size > room] = 0
        while room_list and room >= 0:
            k = bisect_right(room_list, (room, n)) - 1
            if k < 0 or (room == 0 and room_list[k][0] > 0):
                break
            s, i = room_list.pop(k)
            box.append(i)
            unused[i] = False
            room -= s
        if room > 0 and len(box) > 1:
            last = (int(size[box[-1]]), box[-1])
            k = bisect_right(room_list, (last[0] + room, n)) - 1
            if k >= 0 and room_list[k][0] > last[0]:
                low = bisect_right(room_list, (max(last[0] + 1, room_list[k][0] - SLACK), -1))
                k = max(range(low, k + 1), key=lambda x: (score[room_list[x][1]], x))
                box[-1] = room_list.pop(k)[1]
                unused[box[-1]], unused[last[1]] = False, True
                insort(room_list, last)
        out.append(box)
    return out


def _packer(shared, capacity: int, block: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:  # noqa: ANN001
    def emit(rows: pd.DataFrame, first: int) -> tuple[pd.DataFrame, int]:
        idf, mean_length = shared.value
        size = rows["size"].to_numpy()
        terms, often = ([np.asarray(t, dtype=np.int64) for t in rows[c]] for c in ("terms", "often"))
        out_id, out_part, out_box, out_tokens, out_at = [], [], [], [], []
        box = first
        ids = rows["id"].to_numpy()
        for i in np.flatnonzero(size > capacity):  # an item larger than a container fills whole ones; its rest is an item
            for part in range(int(size[i]) // capacity):
                for lst, v in zip((out_id, out_part, out_box, out_tokens, out_at), (ids[i], part, box, capacity, 0), strict=True):
                    lst.append(v)
                box += 1
        rest = np.where(size > capacity, size % capacity, size)
        part = np.where(size > capacity, size // capacity, 0)
        keep = np.flatnonzero((rest > 0) | (size == 0))
        for members in pack_block(rest[keep], [terms[i] for i in keep], [often[i] for i in keep], idf, mean_length, capacity):
            at = 0
            for m in members:
                i = keep[m]
                for lst, v in zip((out_id, out_part, out_box, out_tokens, out_at), (ids[i], int(part[i]), box, int(rest[i]), at), strict=True):
                    lst.append(v)
                at += int(rest[i])
            box += 1
        return pd.DataFrame({"doc_id": out_id, "part": out_part, "container_id": out_box, "tokens": out_tokens, "offset": out_at}), box

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        box, held = TaskContext.get().partitionId() << 40, None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            while len(held) >= 2 * block:  # the last block of a partition has between one and two times the size
                out, box = emit(held.iloc[:block].reset_index(drop=True), box)
                yield out
                held = held.iloc[block:].reset_index(drop=True)
        if held is not None and len(held):
            yield emit(held, box)[0]

    return run


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", group_col: str = "issuer_key", block: int = BLOCK, terms: int = TERMS) -> DataFrame:
    """doc_id, part, container_id, tokens, offset: every document (its parts, if larger than a container) in a container.

    1. One narrow stage gives each text its size in tokens and its terms with their numbers, hashed to ``terms`` values. 2. Document
    frequencies of the hashed terms and the mean length are counted over all documents; the table has at most ``terms`` entries
    and is broadcast. 3. The items are range partitioned by ``group_col`` and id, so that related documents lie together and
    a hot group is cut, and each run of ``block`` items gets its own BM25 index and is packed (``pack_block``). Only a
    partition's last containers are less than full, whatever the number of documents.

    Null and empty texts have size 0 and lie in some container. A document larger than ``capacity`` fills whole containers
    in order (part 0, 1, ...) and its rest is packed as an item. Repeated ids are separate documents.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Merges(path or tokenizer_path()))
    kind = dict(docs.dtypes)[id_col]
    grp = F.col(group_col) if group_col in docs.columns else F.lit(None)
    sized = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), grp.cast("string").alias("grp")).mapInArrow(_sizer(shared, terms), f"id {kind}, grp string, size long, terms array<int>, often array<int>")
    sized = checkpointed(sized)
    df = np.zeros(terms)
    for r in sized.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most ``terms`` rows
        df[r["t"]] = r["count"]
    n, mean = sized.agg(F.count("*"), F.avg(F.aggregate("often", F.lit(0), lambda a, x: a + x))).first()
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    stats = spark.sparkContext.broadcast((idf, float(mean or 0)))
    parts = max(1, -(-n // (4 * block)))
    lain = sized.repartitionByRange(parts, "grp", "id").sortWithinPartitions("grp", "id").select("id", "size", "terms", "often")
    return lain.mapInPandas(_packer(stats, capacity, block), f"doc_id {kind}, part int, container_id long, tokens int, offset int")
