"""Mapping freely typed values to a list of reference entries (problem 4)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries in one BK-tree; a longer list is cut into shards whose winners are merged.
SHARD = 20_000
UNMATCHED = "UNMATCHED"


def folded(text: str) -> str:
    """Case and marks folded; letters without a decomposition that stand for one or two plain ones are spelled out."""
    t = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text)).casefold()
    return "".join(c for c in t if not unicodedata.combining(c)).translate({0xF8: "o", 0xE6: "ae", 0x153: "oe", 0x111: "d", 0x142: "l"})


def tokens(text: str) -> list[str]:
    """Letter runs in order, also cut where a capital follows a small letter; digits and signs only separate."""
    t = re.sub(r"(?<=[^\W\d_])(?<![A-ZÅÄÖÉÜ])(?=[A-ZÅÄÖÉÜ][^\W\d_A-ZÅÄÖÉÜ])", " ", unicodedata.normalize("NFC", text))
    return re.findall(r"[^\W\d_]+", folded(t))


def levenshtein(a: str, b: str, masks: dict[str, int] | None = None) -> int:
    """Insertions, deletions and substitutions from a to b: a true metric, by the bit-parallel recurrence of Myers.

    ``masks`` may hold the positions of each letter of ``a``.
    """
    m = len(a)
    if not m:
        return len(b)
    if masks is None:
        masks = letter_masks(a)
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, d = full, 0, m
    for c in b:
        x = masks.get(c, 0) | vn
        h = (((x & vp) + vp) ^ vp) | x
        hn, hp = vp & h, vn | ~(vp | h) & full
        if hp & top:
            d += 1
        elif hn & top:
            d -= 1
        hp = (hp << 1 | 1) & full
        hn = hn << 1 & full
        vp = hn | ~(x | hp) & full
        vn = hp & x
    return d


def letter_masks(a: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(a):
        out[c] = out.get(c, 0) | 1 << i
    return out


def damerau(a: str, b: str) -> int:
    """Edits with a swap of neighbours as one (unrestricted Damerau-Levenshtein, a true metric)."""
    last: dict[str, int] = {}
    big = len(a) + len(b)
    d = [[big] * (len(b) + 2), [big, *range(len(b) + 1)]]
    for i, ca in enumerate(a, 1):
        row, hit = [big, i] + [0] * len(b), 0
        for j, cb in enumerate(b, 1):
            k, m = last.get(cb, 0), hit
            cost = 1
            if ca == cb:
                cost, hit = 0, j
            row[j + 1] = min(d[i][j] + cost, row[j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        d.append(row)
        last[ca] = i
    return d[-1][-1]


class BKTree:
    """Burkhard-Keller tree under ``levenshtein``: every entry within a radius, by the triangle inequality."""

    def __init__(self, words: Iterable[str]) -> None:
        self.root: tuple[str, dict] | None = None
        for w in words:
            self.add(w)

    def add(self, word: str) -> None:
        if self.root is None:
            self.root = (word, {})
            return
        node = self.root
        while True:
            d = levenshtein(word, node[0])
            if d == 0:
                return
            if d not in node[1]:
                node[1][d] = (word, {})
                return
            node = node[1][d]

    def within(self, word: str, radius: int) -> list[tuple[int, str]]:
        if self.root is None:
            return []
        out, stack, masks = [], [self.root], letter_masks(word)
        while stack:
            w, kids = stack.pop()
            d = levenshtein(word, w, masks) if word else len(w)
            if d <= radius:
                out.append((d, w))
            stack.extend(kid for e, kid in kids.items() if d - radius <= e <= d + radius)
        return out


def allowed_edits(n: int) -> int:
    """Typing mistakes that a word or phrase of n letters may hold: none below 4 letters, then about one in five."""
    return 0 if n < 4 else max(1, round(n * 0.2))


class Canonicalizer:
    """The entries of one field, or of one shard of them. ``entries``: (code, spelling).

    Ranks, the lower the better: 0 the letters of a spelling in its order of words; 1 in any order; 2 abbreviated words, each cut
    short by a point; 3 a spelling with at most ``allowed_edits`` mistakes (BK-tree, words in order, reversed or sorted); 4 the
    letters of a spelling next to other words (distance: how many others). ``candidates`` gives every entry that can win in a
    rank, ties included, and ``decide`` picks among the candidates of all shards, so that a shard never settles a tie by itself.
    """

    def __init__(self, entries: Iterable[tuple[str, str]]) -> None:
        self.code: dict[str, set[str]] = {}
        self.bags: dict[str, set[str]] = {}
        self.words: list[tuple[str, list[str]]] = []
        for code, text in entries:
            t = tokens(text)
            if t:
                self.code.setdefault("".join(t), set()).add(code)
                self.bags.setdefault("".join(sorted(t)), set()).add(code)
                self.words.append((code, t))
        self.tree, self.bag_tree = BKTree(sorted(self.code)), BKTree(sorted(self.bags))

    def _near(self, word: str, tree: BKTree, codes: dict[str, set[str]]) -> list[tuple[int, str]]:
        k = allowed_edits(len(word))
        hits = tree.within(word, 2 * k) if k else []
        return [(d, c) for _, w in hits if (d := damerau(word, w)) <= min(k, allowed_edits(len(w))) for c in codes[w]]

    def candidates(self, text: str) -> list[tuple[int, int, str]]:
        """(rank, distance, code): of each rank the nearest entries of these. Ranks 0 and 1 win whatever comes after them."""
        t = tokens(text)
        word = "".join(t)
        if not word:
            return []
        for rank, got in enumerate((self.code.get(word), self.bags.get("".join(sorted(t))))):
            if got:
                return [(rank, 0, c) for c in sorted(got)]
        out: list[tuple[int, int, str]] = []
        cut = re.findall(r"([^\W\d_]+)(\.?)", folded(text))
        if any(dot for _, dot in cut):
            short = {c for c, w in self.words if len(w) == len(cut) and all((x.startswith(a) and len(a) > 1) if dot else x == a for (a, dot), x in zip(cut, w, strict=True))}
            out += [(2, 0, c) for c in sorted(short)]
        near = self._near(word, self.tree, self.code)
        if len(t) > 1:
            near += self._near("".join(sorted(t)), self.bag_tree, self.bags)
        if near:
            d = min(near)[0]
            out += [(3, d, c) for c in sorted({c for e, c in near if e == d})]
        for n in range(len(t) - 1, 0, -1):
            codes = {c for i in range(len(t) - n + 1) for c in self.code.get("".join(t[i : i + n]), ())}
            if codes:
                return out + [(4, len(t) - n, c) for c in sorted(codes)]
        return out

    def best(self, text: str) -> tuple[int, int, str] | None:
        return decide(self.candidates(text))


def decide(found: Iterable[tuple[int, int, str]]) -> tuple[int, int, str] | None:
    """The nearest candidate of the first rank that has any; None where several codes are equally near. Only abbreviated words (rank
    2) that fit several codes leave it to the next ranks."""
    by: dict[int, list[tuple[int, str]]] = {}
    for rank, d, c in found:
        by.setdefault(rank, []).append((d, c))
    for rank in sorted(by):
        d = min(by[rank])[0]
        codes = {c for e, c in by[rank] if e == d}
        if len(codes) == 1:
            return rank, d, codes.pop()
        if rank != 2:
            return None
    return None


def _matcher(entries: list[tuple[str, str, str]], field: str, value: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_field: dict[str, list[tuple[str, str]]] = {}
        for f, c, s in entries:
            by_field.setdefault(f, []).append((c, s))
        ready = {f: Canonicalizer(e) for f, e in by_field.items()}
        for pdf in batches:
            out = [(f, v, *x) for f, v in zip(pdf[field], pdf[value], strict=True) if f in ready for x in ready[f].candidates(v)]
            yield pd.DataFrame(out, columns=["field_name", "value", "rank", "distance", "code"])

    return run


def decided(found: DataFrame) -> DataFrame:
    """field_name, value, code of what ``decide`` picks among the candidates of a value, as grouped aggregates."""
    each = found.groupBy("field_name", "value", "rank", "distance").agg(F.min("code").alias("lo"), F.max("code").alias("hi"))
    best = each.groupBy("field_name", "value").agg(*[F.min(F.when(F.col("rank") == r, F.struct("distance", "lo", "hi"))).alias(f"r{r}") for r in range(5)])
    one = lambda r: F.when(F.col(f"r{r}.lo") == F.col(f"r{r}.hi"), F.col(f"r{r}.lo"))
    pick = F.coalesce(*[F.when(F.col(f"r{r}").isNotNull(), one(r) if r == 2 else F.coalesce(one(r), F.lit(UNMATCHED))) for r in range(5)], F.lit(UNMATCHED))
    return best.select("field_name", "value", pick.alias("code"))


def spellings(terms: DataFrame) -> DataFrame:
    """field_name, code, spelling of every label, label_en and alias of a reference list."""
    every = F.concat(F.array("label", "label_en"), F.coalesce("aliases", F.array().cast("array<string>")))
    return terms.select("field_name", "code", F.explode(every).alias("spelling")).where("field_name is not null and code is not null and trim(spelling) != ''").distinct()


def canonical_codes(rows: DataFrame, terms: DataFrame, id_col: str, fields: list[str], shard: int = SHARD) -> DataFrame:
    """id, field_name, value, code: each non-null, non-empty value that is not exactly a label or label_en, with the code of
    the entry meant or UNMATCHED.

    The values are reduced to distinct ones (partial aggregates first, so a value that a third of all rows hold is one row a
    task) and only those are looked up. The reference list, which is counted, goes to every task in one BK-tree a field and
    ``shard`` spellings at most; a longer one is cut into shards whose candidates are merged before anything is decided, so
    that the codes are the same whatever ``shard`` is. Several codes equally near: UNMATCHED. Equal rows come out as often as
    they stand there; an empty list gives UNMATCHED throughout.
    """
    long = rows.select(F.col(id_col).alias("id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])).alias("x")).select("id", "x.*").where("value != ''")
    exact = terms.select("field_name", F.explode(F.array("label", "label_en")).alias("value")).where("value is not null").distinct()
    sp = spellings(terms)
    n = sp.count()
    typed = long.join(F.broadcast(exact) if n <= shard else exact, ["field_name", "value"], "left_anti")
    values = typed.groupBy("field_name", "value").count().drop("count")
    schema = "field_name string, value string, rank int, distance int, code string"
    k = max(1, -(-n // shard))
    parts = sp.withColumn("shard", F.pmod(F.xxhash64("field_name", "spelling"), F.lit(k)))
    found = None
    for i in range(k):
        entries = [tuple(r) for r in parts.where(F.col("shard") == i).drop("shard").collect()]  # about ``shard`` rows
        part = values.mapInPandas(_matcher(entries, "field_name", "value"), schema)
        found = part if found is None else found.unionByName(part)
    return typed.join(decided(found), ["field_name", "value"], "left").select("id", "field_name", "value", F.coalesce("code", F.lit(UNMATCHED)).alias("code"))
