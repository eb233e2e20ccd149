import random

import pytest

from kronolit.llm.canonical import BKTree, Canonicalizer, canonical_codes, damerau, levenshtein, tokens


def plain(a, b, swap=False):
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
    return d[len(a) - 1, len(b) - 1]


@pytest.mark.parametrize("seed", range(10))
def test_metrics(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abc") for _ in range(r.randint(0, 70 if seed == 0 else 7))) for _ in range(25)]
    for a in words:
        for b in words:
            assert levenshtein(a, b) == plain(a, b)
            assert damerau(a, b) == damerau(b, a) <= plain(a, b)
    for a in words[:9]:
        for b in words[:9]:
            for c in words[:9]:
                assert damerau(a, c) <= damerau(a, b) + damerau(b, c)
    tree = BKTree(words)
    for a in words:
        for k in (0, 1, 3):
            assert sorted(tree.within(a, k)) == sorted((plain(a, w), w) for w in set(words) if plain(a, w) <= k)
    assert damerau("ca", "abc") == 2 and damerau("akite", "aktie") == 1


def test_tokens():
    assert tokens("LösenÖkning (se not)") == ["losen", "okning", "se", "not"] and tokens("VD/CEO 2") == ["vd", "ceo"] and tokens("") == []


E = [("ceo", "Verkställande direktör"), ("ceo", "VD"), ("deputy", "vice VD"), ("deputy", "Vice verkställande direktör"), ("chair", "ordf. i styrelsen"), ("chair", "Styrelseordförande"), ("board", "Styrelseledamot"), ("in", "Lösen ökning"), ("out", "Lösen minskning"), ("cto", "CTO"), ("cfo", "CFO")]


def test_best():
    c = Canonicalizer(E)
    want = {"vd": "ceo", "vice vd": "deputy", "vixe VD": "deputy", "tf VD": "ceo", "VERKSTÄLLANDE DIREKTÖR": "ceo", "direktör, verkställande": "ceo", "VerkställandeDirektör": "ceo", "Verks. direk.": "ceo", "Vekrställande direktör": "ceo", "Styrelsele.": "board", "styrelse.": None,
            "Lösen-ökning": "in", "losen okning": "in", "Lösne minskning": "out", "ökning, Lösen": "in", "CTO (tillträdande)": "cto", "CXO": None, "Kusin": None, "77": None, "": None, "vd, cto": None, "'Styrelseledamot'": "board", "ordf i styrelsen & grundare": "chair"}
    for text, code in want.items():
        got = c.best(text)
        assert (got[2] if got else None) == code, (text, got)
    assert Canonicalizer([]).best("vd") is None


R = "term_id long, field_name string, code string, label string, label_en string, aliases array<string>"


@pytest.mark.parametrize("shard", [20_000, 3])
def test_table(spark, shard):
    terms = spark.createDataFrame([(1, "f", "ceo", "Verkställande direktör", "Chief executive officer", ["VD"]), (2, "f", "board", "Styrelseledamot", None, []), (3, "g", "share", "Aktie", "Share", None), (4, "f", "x", None, None, None)], R)
    rows = [(1, "VD", "Aktie"), (2, "Styrelseledamott", "akite"), (3, None, ""), (4, "Styrelseledamot", "aktie"), (5, "zzz", " "), (5, "zzz", " "), (6, "v" * 100_000, "Share")]
    df = spark.createDataFrame([(*r, "q", "w") for r in rows], "row_id long, f string, g string, code string, value string")
    got = sorted((r["id"], r["field_name"], r["code"]) for r in canonical_codes(df, terms, "row_id", ["f", "g"], shard=shard).collect())
    assert got == [(1, "f", "ceo"), (2, "f", "board"), (2, "g", "share"), (4, "g", "share"), *[(5, "f", "UNMATCHED")] * 2, *[(5, "g", "UNMATCHED")] * 2, (6, "f", "UNMATCHED")]


@pytest.mark.parametrize("seed", range(3))
def test_shards_cannot_be_seen(spark, seed):
    """Random lists full of near ties: the same codes for every shard size, those of the list as a whole."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("ab") for _ in range(r.randint(3, 9)))
    names = [" ".join(word() for _ in range(r.randint(1, 3))) for _ in range(40)]
    names += ["forvaltare x", "forvaltara x", "forvaltxre xx"]
    terms = spark.createDataFrame([(i, "f", f"c{i % 25}", x, None, [names[i - 1]] if i % 7 == 0 else None) for i, x in enumerate(names)], R)
    typed = ["forvaltarx x", *(" ".join(word() + r.choice(["", "."]) for _ in range(r.randint(1, 3))) for _ in range(150))]
    df = spark.createDataFrame(list(enumerate(typed)), "row_id long, f string")
    got = [sorted((x["id"], x["code"]) for x in canonical_codes(df, terms, "row_id", ["f"], shard=k).collect()) for k in (20_000, 11, 2)]
    assert got[0] == got[1] == got[2]
    entries = [(f"c{i % 25}", x) for i, x in enumerate(names)] + [(f"c{i % 25}", names[i - 1]) for i in range(len(names)) if i % 7 == 0]
    whole = Canonicalizer(entries)
    assert dict(got[0]) == {i: (b[2] if (b := whole.best(x)) else "UNMATCHED") for i, x in enumerate(typed) if x not in names}
    assert dict(got[0])[0] == "UNMATCHED"


def test_empty(spark):
    terms = spark.createDataFrame([], R)
    df = spark.createDataFrame([(1, "a", None)], "row_id long, f string, g string")
    assert [tuple(r) for r in canonical_codes(df, terms, "row_id", ["f", "g"]).collect()] == [(1, "f", "a", "UNMATCHED")]
    assert canonical_codes(df.where("false"), terms, "row_id", ["f", "g"]).count() == 0
