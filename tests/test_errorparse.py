import random

import pytest

from kronolit.operators.errorparse import DELIM, QUOTE, bad_values, lex, parse_line, parse_register, repair, valid_stamp

F22 = ["2024-05-01 10:00:00", "Bolag AB", "LEI", "A", "B", "VD", "", "", "", "Ja", "", "Förvärv", "Aktie", "Bolag B", "SE0", "2024-04-30", "1,0", "Antal", "2,5", "SEK", "XSTO", "Aktuell"]


def line(**change):
    f = list(F22)
    for k, v in change.items():
        f[int(k[1:])] = v
    return ";".join(f)


CASES = [
    (line(), []),
    (line() + ";", []),
    (line() + ";  \t", []),
    (line() + ";x", ["column_count"]),
    (line() + ";;", ["column_count"]),
    (";".join(F22[:-1]), ["column_count"]),
    ("", ["column_count"]),
    (line(_1='"Bolag; ""två"" AB"'), []),
    (line(_1='"rad\nrad"'), []),
    (line(_1='Bolag "två" AB'), []),
    (line(_1='"Bolag" AB'), ["quoting"]),
    (line(_1='"Bolag'), ["quoting"]),
    (line(_21='"Aktuell"'), []),
    (line(_21='"Aktuell'), ["quoting"]),
    (line(_1='a"b;c'), ["column_count"]),
    (line(_0=" 2024-05-01 "), []),
    (line(_0=""), ["published"]),
    (line(_0="2024-02-30"), ["published"]),
    (line(_0="2024-05-01 24:00:00"), ["published"]),
    (line(_0="2024-05-01  10:00:00"), ["published"]),
    (line(_0="0000-01-01"), ["published"]),
    (line(_0="2024-05-01T10:00:00"), ["published"]),
    (line(_15=""), []),
    (line(_15=" "), []),
    (line(_15="45000"), ["trade_date"]),
    (line(_15="2024-02-29"), []),
    (line(_15="2023-02-29"), ["trade_date"]),
    (line(_21=" Current "), []),
    (line(_21="aktuell"), ["status"]),
    (line(_21=""), ["status"]),
    (line(_0="x", _15="x", _21="x"), ["published", "trade_date", "status"]),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, c[0], "x", "y") for i, c in enumerate(CASES)], "line_id long, raw_line string, id string, fields string")
    got = {r["id"]: (list(r["reasons"]), r["fields"]) for r in parse_register(df).collect()}
    for i, (text, reasons) in enumerate(CASES):
        assert got[i][0] == reasons, text
        if not reasons:
            assert len(got[i][1]) == 22


def test_null_long_repeated_and_empty(spark):
    long = line(_8='"' + "x;" * 200_000 + '"')
    df = spark.createDataFrame([(1, None), (1, None), (2, long), (3, ";" * 5000), (4, '"' * 3001)], "line_id long, raw_line string")
    got = sorted((r["id"], list(r["reasons"])) for r in parse_register(df).collect())
    assert got == [(1, ["column_count"]), (1, ["column_count"]), (2, []), (3, ["column_count"]), (4, ["quoting"])]
    assert parse_register(df.where("line_id > 9")).count() == 0


def strict(text):
    """Character by character, as the rules are stated."""
    i, n, fields = 0, len(text), []
    while True:
        if i < n and text[i] == '"':
            j, buf = i + 1, ""
            while j < n and not (text[j] == '"' and text[j + 1 : j + 2] != '"'):
                buf += text[j]
                j += 2 if text[j] == '"' else 1
            if j >= n or text[j + 1 : j + 2] not in ("", ";"):
                return ["quoting"]
            fields.append(buf)
            i = j + 1
        else:
            j = text.find(";", i)
            j = n if j < 0 else j
            fields.append(text[i:j])
            i = j
        if i >= n:
            break
        i += 1
    if len(fields) == 23 and not fields[-1].strip():
        fields.pop()
    return bad_values(fields) if len(fields) == 22 else ["column_count"]


@pytest.mark.parametrize("seed", range(30))
def test_random_damage(seed):
    r = random.Random(seed)
    for _ in range(60):
        t = line(_1=r.choice(['"a;b"', '"a""b"', "a", '"a"', '"']))
        for _ in range(r.randint(0, 4)):
            i = r.randrange(len(t) + 1)
            t = r.choice([t[:i] + t[i + 1 :], t[:i] + '"' + t[i:], t[:i] + ";" + t[i:], t[:i] + "x" + t[i:]])
        fields, reasons, edits = parse_line(t)
        assert reasons == strict(t), t
        if reasons in (["quoting"], ["column_count"]):
            assert edits and len(fields) == 22, t
        assert bool(edits) == bool(reasons) and (reasons == [] or reasons[0] in ("quoting", "column_count") or edits == [f"replace value of {x}" for x in reasons]), (t, edits)


def cheapest(tokens):
    """Least cost over all ways, by recursion without a table."""
    from functools import cache

    from kronolit.operators.errorparse import BLANKS, STATUS

    toks = tokens

    def typed(i, kind, text):
        ok = {0: kind != "open" and valid_stamp(text), 15: not text.strip(BLANKS) or valid_stamp(text), 21: text.strip(BLANKS) in STATUS}.get(i, True)
        return 0 if ok else 1

    @cache
    def best(i, j, inside):
        if j > 22:
            return 1 << 60
        if i == len(toks):
            return (QUOTE if inside else 0) + DELIM * (22 - j)
        kind, text, _ = toks[i]
        if inside:
            shut = best(i + 1, j, False) + QUOTE if kind != "open" else 1 << 60
            return min(best(i + 1, j, True), shut)
        fee = QUOTE if kind in ("torn", "open") else 0
        out = [best(i, j + 1, False) + DELIM] if j < 22 else []
        if j < 22:
            out.append(best(i + 1, j + 1, False) + fee + typed(j, kind, text))
            if kind == "open":
                out.append(best(i + 1, j + 1, True))
        if j > 0:
            out.append(best(i + 1, j, False) + DELIM + fee)
        return min(out)

    return best(0, 0, False)


@pytest.mark.parametrize("seed", range(12))
def test_repair_is_cheapest(seed):
    r = random.Random(seed)
    t = ";".join(r.choice(["", "x", '"x', '"x"', '"x"y', F22[0], "Aktuell"]) for _ in range(r.randint(1, 26)))
    toks = lex(t)
    if not (len(toks) == 23 and not toks[-1][1].strip()):
        assert repair(toks)[0] == cheapest(toks), t
