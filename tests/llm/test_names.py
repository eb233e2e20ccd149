import random

import pytest

from kronolit.llm.names import components, jaro_winkler, linked_names, linked_pairs, parse_name, same


def test_jaro_winkler():
    assert jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert jaro_winkler("", "a") == 0 and jaro_winkler("a", "a") == 1 and jaro_winkler("abc", "xyz") == 0


ALIKE = [("Åsa Öberg", "ÖBERG, Åsa"), ("Karl Åkvfors", "Karl Aakvfors"), ("Karl Åkvfors", "Dr Kal Åkvfors"), ("Ulf Nubblida", "Uffe Emil Nubblida"), ("William Stäk", "Wille Stäk"), ("Filip Stäk", "Fille Stäk"), ("Søren Träskstigh", "Søen Träskstigh"), ("Kristina Ek", "KristinaEk"), ("Sofia Ek", "Sophia Ek"),
         ("Havsbris Konsult AB", "Havsbris Kons. AB (publ)"), ("Älvkröken Kapital 1 AB", "AB Älvkröken Kapital 1"), ("Björnloka Konsult AB", "Björnlokakonsult Aktiebolag"), ("Silverlo Holding AB", "Silverlo Holdibg ab"), ("Anna Maria Ekdal", "Ekdal, Anna M."), ("Robert Stäk", "Roert Stäk")]
APART = [("Ulf Nubblida", "Kristina Nubblida"), ("Älvkröken Kapital 1 AB", "Älvkröken Kapital 2 AB"), ("Älvkröken Kapital AB", "Älvkröken Invest AB"), ("Wille Stäk", "Fille Stäk"), ("Anna Ek", "Anna Alm"), ("Ek AB", "Anna Ek"), ("Ek Invest AB", "Ek Invest 1 AB"), ("Anna Maria Ek", "Anna Karin Ek"), ("Anna M. Ek", "Anna K. Ek"), ("Anna Maria Ek", "Anna K. Ek")]


def test_pairs():
    for a, b in ALIKE:
        assert same(parse_name(a), parse_name(b)), (a, b)
    for a, b in APART:
        assert not same(parse_name(a), parse_name(b)), (a, b)


S = "name_id long, issuer_key string, full_name string, entity string, id int, grp string"


def test_table(spark):
    rows, i = [], 0
    for n, (a, b) in enumerate(ALIKE):
        rows += [(10 * n, f"k{n}", a), (10 * n + 1, f"k{n}", b), (10 * n + 2, f"k{n}", b)]
    rows += [(1000 + 2 * n + m, f"a{n}", x) for n, p in enumerate(APART) for m, x in enumerate(p)]
    rows += [(2000, "i", "Anders Ek"), (2001, "i", "A. Ek"), (2002, "i", "A Ek"), (2003, "j", "Anna Ek"), (2004, "j", "Anders Ek"), (2005, "j", "A. Ek"), (2006, "j", "A Ek")]
    rows += [(3000, None, "Anna Ek"), (3001, "i", None), (3002, "i", ""), (3003, "i", "  "), (3004, "i", "x" * 50_000), (3005, "i", "..."), (3006, "i", "...")]
    df = spark.createDataFrame([(*r, "e", 1, "g") for r in rows], S)
    e = linked_names(df)
    got = {tuple(r) for r in linked_pairs(e).collect()}
    want = {p for n in range(len(ALIKE)) for p in ((10 * n, 10 * n + 1), (10 * n, 10 * n + 2), (10 * n + 1, 10 * n + 2))}
    want |= {(2000, 2001), (2000, 2002), (2001, 2002), (2005, 2006), (3005, 3006)}
    assert got == want
    assert {r["id"] for r in e.collect()} == {r[0] for r in rows} - {3000, 3001, 3002, 3003}


def test_middle_names(spark):
    """A name without a middle name joins those that have one only where these are one person."""
    one = ["Anna Ekdal", "Anna Maria Ekdal", "Anna M. Ekdal", "Ekdal, Anna"]
    two = ["Anna Ekdal", "Anna Maria Ekdal", "Anna Karin Ekdal", "Ekdal Anna", "Anna K. Ekdal"]
    rows = [(i, "p", x, "e", 1, "g") for i, x in enumerate(one)] + [(10 + i, "q", x, "e", 1, "g") for i, x in enumerate(two)]
    got = {}
    for r in linked_names(spark.createDataFrame(rows, S)).collect():
        got.setdefault(r["entity"], set()).add(r["id"])
    assert sorted(map(sorted, got.values())) == [[0, 1, 2, 3], [10, 13], [11], [12, 14]]


def test_empty(spark):
    df = spark.createDataFrame([], S)
    assert linked_pairs(linked_names(df)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(None, 5), (7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {x["id"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: min(w for w in root if find(w) == find(v)) for v in root}
