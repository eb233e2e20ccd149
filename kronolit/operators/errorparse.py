"""Delimited lines that fail to parse: minimum-cost error parse with stated reasons (problem 3)."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blanks that do not count around a value.
BLANKS = " \t\r\n\x0b\x0c\x1c\x1d\x1e\x1f\x85   "
#: The fields of a register line, and those with a type: reason, position.
N_FIELDS, TYPED = 22, {"published": 0, "trade_date": 15, "status": 21}
WHERE = {i: name for name, i in TYPED.items()}
STATUS = ("Aktuell", "Reviderad", "Makulerad", "Current", "Revised")
#: Cost of one edit, so that fewer quote edits always count before fewer delimiter edits before fewer invalid values.
QUOTE, DELIM, VALUE = 1_000_000_000, 10_000, 1
_STAMP = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})(?: ([0-9]{2}):([0-9]{2}):([0-9]{2}))?")


def valid_stamp(value: str) -> bool:
    m = _STAMP.fullmatch(value.strip(BLANKS))
    if not m:
        return False
    try:
        dt.datetime(*(int(x or 0) for x in m.groups()))
    except ValueError:
        return False
    return True


def bad_values(fields: list[str]) -> list[str]:
    v = [fields[i].strip(BLANKS) for i in TYPED.values()]
    ok = (valid_stamp(v[0]), not v[1] or valid_stamp(v[1]), v[2] in STATUS)
    return [r for r, good in zip(TYPED, ok, strict=True) if not good]


def lex(line: str, sep: str = ";", quote: str = '"') -> list[tuple[str, str, int]]:
    """Tokens (kind, text, end) between separators: ``plain``, ``quoted`` (text without its quotes), ``torn`` (a quoted field
    with text after its closing quote, up to the next separator), ``open`` (a field that begins with a quote and never closes;
    only up to the next separator, from where lexing goes on)."""
    out, i, n = [], 0, len(line)
    while True:
        if line.startswith(quote, i):
            j, close = i + 1, -1
            while (j := line.find(quote, j)) >= 0:
                if line.startswith(quote, j + 1):
                    j += 2
                    continue
                close = j
                break
            if close < 0:
                e = line.find(sep, i)
                e = n if e < 0 else e
                out.append(("open", line[i:e], e))
            else:
                e = close + 1
                if e == n or line.startswith(sep, e):
                    out.append(("quoted", line[i + 1 : close].replace(quote * 2, quote), e))
                else:
                    e = line.find(sep, e)
                    e = n if e < 0 else e
                    out.append(("torn", line[i:e], e))
        else:
            e = line.find(sep, i)
            e = n if e < 0 else e
            out.append(("plain", line[i:e], e))
        if e >= n:
            return out
        i = e + len(sep)


def repair(tokens: list[tuple[str, str, int]], sep: str = ";", quote: str = '"', n_fields: int = N_FIELDS) -> tuple[int, list[str], list[str]]:
    """Cost, fields and edits of the cheapest way to read the tokens as ``n_fields`` fields.

    Dynamic programme over (tokens read, fields made, inside a repaired quotation). Edits: delete a quote (``torn``, ``open``),
    insert the closing quote of an ``open`` token after any later token, delete a separator (join a token to the field before),
    insert a separator (an empty field), replace an invalid value. A surplus empty last field is free. O(tokens x fields).
    """
    toks = tokens[:-1] if len(tokens) == n_fields + 1 and tokens[-1][0] != "open" and not tokens[-1][1].strip(BLANKS) else tokens
    big, w = 1 << 50, n_fields + 1
    shut, inside = np.full(w, big), np.full(w, big)
    shut[0] = 0
    trace: list[tuple] = []
    for kind, text, _ in toks:
        typed = np.zeros(n_fields, dtype=np.int64)
        for i, ok in ((0, kind != "open" and valid_stamp(text)), (15, not text.strip(BLANKS) or valid_stamp(text)), (21, text.strip(BLANKS) in STATUS)):
            typed[i] = 0 if ok or i >= n_fields else VALUE
        # empty fields may be inserted before the token: running minimum over (cost - DELIM x fields)
        base = shut - DELIM * np.arange(w)
        low = np.minimum.accumulate(base)
        at = np.maximum.accumulate(np.where(base == low, np.arange(w), 0))
        full = low + DELIM * np.arange(w)
        fee = QUOTE if kind in ("torn", "open") else 0
        new, glue, shut_in = np.full(w, big), shut + DELIM, inside + (QUOTE if kind != "open" else big)
        glue[0] = big
        new[1:] = full[:-1] + fee + typed
        if fee:
            glue = glue + fee
        s = np.minimum(np.minimum(new, glue), shut_in)
        how = np.where(s == new, 0, np.where(s == glue, 1, 2))
        start = np.full(w, big)
        if kind == "open":
            start[1:] = full[:-1]
        inner = np.minimum(start, inside)
        trace.append((how, at, start <= inside, typed))
        shut, inside = s, inner
    # at the end empty fields may follow; a quotation still open closes here
    ends = np.minimum(shut, inside + QUOTE)
    tail = ends + DELIM * (n_fields - np.arange(w))
    j = int(tail.argmin())
    cost, mode = int(tail[j]), "in" if inside[j] + QUOTE < shut[j] else "out"
    edits, pieces = [f"insert {n_fields - j} separators at the end"] * (j < n_fields), [[] for _ in range(n_fields)]
    if mode == "in":
        edits.append("insert closing quote at the end")
    for i in range(len(toks) - 1, -1, -1):
        how, at, began, typed = trace[i]
        kind, text, end = toks[i]
        if mode == "in":
            pieces[j - 1].append(text)
            if began[j]:
                mode, j = "out", j - 1
                if at[j] < j:
                    edits.append(f"insert {j - at[j]} separators before {end - len(text)}")
                j = int(at[j])
            continue
        pieces[j - 1].append(text)
        if kind in ("torn", "open") and how[j] != 2:
            edits.append(f"delete quote in token ending at {end}")
        if how[j] == 0:
            j -= 1
            if typed[j]:
                edits.append(f"replace value of {WHERE[j]}")
            if at[j] < j:
                edits.append(f"insert {j - at[j]} separators before {end - len(text)}")
            j = int(at[j])
        elif how[j] == 1:
            edits.append(f"delete separator before {end - len(text)}")
        else:
            edits.append(f"insert closing quote at {end}")
            mode = "in"
    return cost, [sep.join(reversed(p)) for p in pieces], edits[::-1]


def parse_line(line: str) -> tuple[list[str], list[str], list[str]]:
    """Fields, reasons and edits of one line. A line that splits into its fields as it stands, with valid values, is a parse of cost
    zero; for any other the cheapest edits are found, and they are the reasons."""
    tokens = lex(line)
    fields = [t[1] for t in tokens]
    if len(fields) == N_FIELDS + 1 and not fields[-1].strip(BLANKS):
        fields = fields[:-1]
    if len(fields) == N_FIELDS and all(t[0] in ("plain", "quoted") for t in tokens) and not bad_values(fields):
        return fields, [], []
    cost, fields, edits = repair(tokens)
    reasons = ["quoting"] if cost >= QUOTE else ["column_count"] if cost >= DELIM else [r for r in TYPED if f"replace value of {r}" in edits]
    return fields, reasons, edits


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(None, ["column_count"], []) if x is None else parse_line(x) for x in pdf["line"]]
        yield pd.DataFrame({"id": pdf["id"], "fields": [r[0] for r in rows], "reasons": [r[1] for r in rows], "edits": [r[2] for r in rows]})


def _typed_ok(fields: Column) -> Column:
    """Array of the failing typed fields' reasons, as expressions."""
    trim = lambda i: F.regexp_replace(F.get(fields, F.lit(i)), rf"^[{BLANKS}]+|[{BLANKS}]+$", "")
    stamp = lambda c: F.coalesce(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}( [0-9]{2}:[0-9]{2}:[0-9]{2})?\z") & ~c.startswith("0000") & F.when(F.length(c) > 10, F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull()).otherwise(c.try_cast("date").isNotNull()), F.lit(False))
    p, t, s = (trim(i) for i in TYPED.values())
    return F.array_compact(F.array(F.when(~stamp(p), "published"), F.when((t != "") & ~stamp(t), "trade_date"), F.when(~s.isin(*STATUS), "status")))


def parse_register(lines: DataFrame, id_col: str = "line_id", line_col: str = "raw_line") -> DataFrame:
    """id, fields (22 strings), reasons, edits of every line; a line without reasons is loaded, the others are set apart.

    A line without a field that begins with a quote that splits into 22 fields (an empty 23rd is free) with valid values is a
    parse of cost zero; that much is decided in Spark expressions. All other lines go through ``lex`` and the dynamic programme
    ``repair``, each by itself, and every line that fails has the edits that would mend it. Reasons: ``quoting`` if every
    reading edits quotes, else ``column_count`` if every reading edits separators, else the typed fields whose values are
    replaced. A null line comes out with null fields and the reason ``column_count``, an empty one as a line of one field.
    Extra columns are ignored; repeated ids stay repeated.
    """
    df = lines.select(F.col(id_col).alias("id"), F.col(line_col).alias("line"))
    parts = F.split("line", ";", -1)
    blank = F.get(parts, F.lit(N_FIELDS)).rlike(rf"^[{BLANKS}]*\z")
    easy = ~F.col("line").rlike(r'(^|;)"') & ((F.size(parts) == N_FIELDS) | ((F.size(parts) == N_FIELDS + 1) & blank))
    none = F.array().cast("array<string>")
    df = df.withColumn("easy", F.coalesce(easy & (F.size(_typed_ok(parts)) == 0), F.lit(False)))
    good = df.where("easy").select("id", F.slice(parts, 1, N_FIELDS).alias("fields"), none.alias("reasons"), none.alias("edits"))
    kind = dict(df.dtypes)["id"]
    hard = df.where("not easy").select("id", "line").mapInPandas(_parse_batches, f"id {kind}, fields array<string>, reasons array<string>, edits array<string>")
    return good.unionByName(hard)
