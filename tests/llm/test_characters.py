import pytest
from pyspark.sql import functions as F

from kronolit.llm.characters import clean_pattern, consistent, inconsistent_fields, latin_lookalikes, normalizer, scripts_of


@pytest.fixture(scope="module")
def look(spark):
    return latin_lookalikes(spark)


CASES = {
    "Åsa Öberg": "Åsa Öberg", "Søren Müller-É": "Søren Müller-É", "": "", "Тихон Брягорев": "Тихон Брягорев", "Θεόδοτος Ξυλογιάννης": "Θεόδοτος Ξυλογιάννης",
    "Ｙｘｔｙｂｙｌ ＡＢ": "Yxtybyl AB", "Åsa": "Åsa", "Öberg": "Öberg", "Sko­g​s﻿": "Skogs", "a b　c d": "a b c d", "A‑aktie": "A-aktie", "A－aktie": "A-aktie", "ﬁnans": "finans", "Karl": "Karl", "Åsa": "Åsa",
    "Pеr": "Per", "Α-aktie": "A-aktie", "sιalɑ": "siala", "SDВ": "SDB", "ΒΤΑ": "BTA", "Bolag АВ": "Bolag AB", "Іndustri": "Industri", "á": "á", "а̊ngstrӧm": "ångström",
    "Dĳkstra ǆ": "Dijkstra dž", "Yta m² 1ª ½": "Yta m² 1ª ½", "O´Brien": "O´Brien", "ꓐꓳꓡꓮꓖ AB": "BOLAG AB", "𝐀𝐁": "AB", "ıſ": "ıs", "日本 АВ": "日本 AB",
    "Тихoн Брягорев": "Тихон Брягорев", "Тихон​ Брягорев": "Тихон Брягорев", "Сор Брягорев": "Сор Брягорев", "Сор Berg": "Cop Berg", "x̧́": "x̧́",
}


def test_cases(look):
    one = normalizer(look)
    for text, want in CASES.items():
        assert one(text) == want, (text, one(text))
        assert one(want) == want  # the form is stable


def test_table(spark, look):
    rows = [(i, a, b, "x") for i, (a, b) in enumerate(CASES.items())] + [(99, None, None, "x"), (100, "Pеr " * 30_000, "Per " * 30_000, "x")]
    df = spark.createDataFrame(rows, "row_id long, s string, want string, found string")
    assert df.where(~consistent(spark, F.col("s"), look).eqNullSafe(F.col("want"))).count() == 0
    found = {(r["id"], r["field_name"]) for r in inconsistent_fields(df, "row_id", ["s", "want"]).collect()}
    assert found == {(i, "s") for i, a, b, _ in rows if a != b}
    assert inconsistent_fields(df.where("row_id < 0"), "row_id", ["s"]).count() == 0
    twice = spark.createDataFrame([(1, "Pеr"), (1, "Pеr")], "row_id long, s string")
    assert inconsistent_fields(twice, "row_id", ["s"]).count() == 2


def test_lookalikes_keep_case(look):
    assert all(a.isupper() == b.isupper() for a, b in look.items() if a.isupper() or a.islower())
    assert look["а"] == "a" and look["І"] == "I" and look["і"] == "i" and "я" not in look


def test_clean_class_is_what_the_normalizer_leaves_alone(spark, look):
    """Over all code points of the Latin blocks, and for texts of several of them."""
    one = normalizer(look)
    pattern = clean_pattern(one)
    chars = [chr(c) for c in [*range(0x20, 0x250), *range(0x1E00, 0x1F00)]]
    df = spark.createDataFrame([(i, c, f"a{c}b") for i, c in enumerate(chars)], "i int, c string, t string")
    got = {r["i"]: (r["x"], r["y"]) for r in df.select("i", F.col("c").rlike(pattern).alias("x"), F.col("t").rlike(pattern).alias("y")).collect()}
    assert got == {i: (one(c) == c, one(f"a{c}b") == f"a{c}b") for i, c in enumerate(chars)}
    good = [c for i, c in enumerate(chars) if got[i][0]]
    assert all(one(a + b) == a + b for a in good[::7] for b in good[::3])


def test_scripts():
    assert scripts_of("a") == {"Latin"} and scripts_of("α") == {"Greek"} and scripts_of("я") >= {"Cyrillic"} and scripts_of("-") == frozenset() and len(scripts_of("日")) == 1
