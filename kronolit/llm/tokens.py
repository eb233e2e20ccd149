"""Encoding of the whole corpus with a public byte-level BPE (problem 8)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed value: the split into pre-tokens of the byte-level BPE of 50,257 ids (regex module syntax).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BREAK = -1


def tokenizer_path(name: str = "byte_bpe_50k.json", folder: str = "/opt/tokenizers") -> str:
    return f"{folder}/{name}"


class Merges:
    """The merge table as arrays: ``byte_ids`` (id of each byte), ``left``, ``right``, ``merged`` (ids by rank), and the pairs
    sorted for look-up (``keys``, ``ranks``). Its size is that of the vocabulary."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # the files spell bytes as printable characters: printable ones stand for themselves, the others follow from 256 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in set(plain)]
        spelled = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
        self.byte_ids = np.array([vocab[spelled[b]] for b in range(256)], dtype=np.int32)
        self.left = np.array([vocab[a] for a, _ in merges], dtype=np.int32)
        self.right = np.array([vocab[b] for _, b in merges], dtype=np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        keys = self.left.astype(np.int64) << 32 | self.right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is no merge."""
        k = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.ranks[at], -1)


class RankQueue:
    """Buckets of positions by merge rank under a two-level bitmap: a summary word over words of 256 ranks each.

    The lowest rank is found by find-first-set on the summary and then on one word, whatever the number of ranks.
    """

    def __init__(self) -> None:
        self.summary, self.words, self.buckets = 0, {}, {}

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = [0, *cut.tolist(), len(ranks)]
        for r, s, e in zip(ranks[starts[:-1]].tolist(), starts[:-1], starts[1:], strict=True):
            bucket = self.buckets.get(r)
            if bucket is None:
                self.buckets[r] = [positions[s:e]]
                w = r >> 8
                self.words[w] = self.words.get(w, 0) | 1 << (r & 255)
                self.summary |= 1 << w
            else:
                bucket.append(positions[s:e])

    def pop(self) -> tuple[int, np.ndarray]:
        w = (self.summary & -self.summary).bit_length() - 1
        word = self.words[w]
        low = word & -word
        self.words[w] = word ^ low
        if word == low:
            self.summary ^= 1 << w
        r = w << 8 | low.bit_length() - 1
        parts = self.buckets.pop(r)
        return r, parts[0] if len(parts) == 1 else np.concatenate(parts)

    def __bool__(self) -> bool:
        return self.summary != 0


def encode_pretokens(pieces: list[bytes], m: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces one after the other, and where each piece's ids begin (one more entry than pieces).

    All pieces form one linked list of byte positions with breaks between them. The queue holds every adjacent pair with a
    merge in the bucket of its rank. The lowest bucket is taken; entries whose pair is gone are stale and skipped; the rest
    are merged at once, left to right where they overlap, and the new neighbours' pairs are pushed. A merge only makes pairs
    of higher rank, so the order inside each piece is that of BPE whatever the other pieces hold. O(bytes) pushes.
    """
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    n = int(sizes.sum())
    ids = m.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    ends = np.cumsum(sizes)
    nxt = np.arange(1, n + 1, dtype=np.int64)
    nxt[ends[sizes > 0] - 1] = BREAK
    prv = np.arange(-1, n - 1, dtype=np.int64)
    prv[(ends - sizes)[sizes > 0]] = BREAK
    alive = np.ones(n, dtype=bool)
    queue = RankQueue()
    at = np.flatnonzero(nxt != BREAK)
    r = m.rank(ids[at], ids[at + 1])
    queue.push(r[r >= 0], at[r >= 0])
    left, right, merged = m.left, m.right, m.merged
    while queue:
        rank, p = queue.pop()
        a, b = left[rank], right[rank]
        q = nxt[p]
        ok = alive[p] & (ids[p] == a) & (q != BREAK)
        p, q = p[ok], q[ok]
        ok = ids[q] == b
        p, q = p[ok], q[ok]
        if a == b and len(p) > 1:  # runs of one id: every other position, and none twice
            p = np.unique(p)
            take, used = [], -1
            for x, y in zip(p.tolist(), nxt[p].tolist(), strict=True):
                if x != used:
                    take.append(x)
                    used = y
            p = np.array(take, dtype=np.int64)
            q = nxt[p]
        if not len(p):
            continue
        after = nxt[q]
        ids[p] = merged[rank]
        alive[q] = False
        nxt[p] = after
        inside = after != BREAK
        prv[after[inside]] = p[inside]
        before = prv[p]
        first = p[before != BREAK]
        x = np.concatenate((prv[first], p[nxt[p] != BREAK]))
        r = m.rank(ids[x], ids[nxt[x]])
        hit = r >= 0
        queue.push(r[hit], x[hit])
    owner = np.repeat(np.arange(len(pieces)), sizes)[alive]
    starts = np.zeros(len(pieces) + 1, dtype=np.int64)
    np.cumsum(np.bincount(owner, minlength=len(pieces)), out=starts[1:])
    return ids[alive], starts


class BatchEncoder:
    """Encodes batches of texts; the distinct pre-tokens of a batch that are not yet known are encoded together.

    What is known is kept from batch to batch, with what ``also`` says of each pre-token, and forgotten as a whole beyond ``limit``
    bytes of pre-tokens, so that a task's memory is bounded.
    """

    def __init__(self, merges: Merges, also: Callable[[list[str]], np.ndarray] | None = None, limit: int = 8_000_000) -> None:
        import regex

        self.merges, self.also, self.limit, self.find = merges, also, limit, regex.compile(PATTERN).findall
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.starts, self.extra, self.held = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64), None, 0

    def _learn(self, words: list[str]) -> None:
        pieces = [w.encode() for w in words]
        ids, starts = encode_pretokens(pieces, self.merges)
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        self.starts = np.concatenate((self.starts, self.starts[-1] + starts[1:]))
        self.ids, self.held = np.concatenate((self.ids, ids)), self.held + sum(map(len, pieces))
        if self.also:
            more = self.also(words)
            self.extra = more if self.extra is None else np.concatenate((self.extra, more))

    def pretokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each text's pre-tokens in turn, and how many each text has. ``starts`` and ``ids`` hold what they stand for."""
        found = [self.find(t) if t else () for t in texts]
        distinct = dict.fromkeys(chain.from_iterable(found))
        if self.held > self.limit:
            self._forget()
        new = [w for w in distinct if w not in self.place]
        if new:
            self._learn(new)
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(map(self.place.__getitem__, chain.from_iterable(found)), dtype=np.int64, count=int(counts.sum())), counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets (one more than texts)."""
        index, counts = self.pretokens(texts)
        starts = self.starts[index]
        size = self.starts[index + 1] - starts
        ends = np.cumsum(size)
        flat = np.repeat(starts - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)
        offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum(counts, out=offsets[1:])
        return self.ids[flat], np.concatenate(([0], ends))[offsets]


def blocks(texts: list[str | None], limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of a batch with at most ``limit`` characters each (a longer text alone), so that memory stays bounded."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def _encoder(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = BatchEncoder(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in blocks(texts):
                ids, offsets = enc.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["doc_id", "ids"])

    return run


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: the ids of every document without special tokens; an empty list for a null or empty text.

    Strings of special tokens in a text are ordinary text. One narrow stage, no shuffle; the merge table (as large as the
    vocabulary, about 1 MB) is read on the driver and broadcast. Repeated ids stay repeated, extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Merges(path or tokenizer_path()))
    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(_encoder(shared), f"doc_id {kind}, ids array<int>")
