import pytest
from pyspark.sql import functions as F

from kronolit.functions import taxonomy as tx
from kronolit.functions.parsing import associate_kind, band_label, is_entity, is_natural_person, name_key, present, recency_label, slug, tidy


def ask(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r["x"] for r in df.select("i", f(F.col("s")).alias("x")).orderBy("i").collect()]


def test_kinds(spark):
    kinds = {"Förvärv": ("acq_purchase", 1), " FÖRVÄRV ": ("acq_purchase", 1), "Interntransaktion – Förvärv": ("internal_in", 1), "Lösen minskning": ("exercise_out", -1), "Blankning": ("short", -1), "Pantsättning": ("pledge", 0), "Köp": ("unmapped", 0), "": ("unmapped", 0), None: ("unmapped", 0)}
    assert ask(spark, tx.txn_kind, list(kinds)) == [k for k, _ in kinds.values()]
    assert ask(spark, tx.direction, [k for k, _ in kinds.values()]) == [d for _, d in kinds.values()]


def test_venues(spark):
    venues = {"NASDAQ STOCKHOLM AB": "xsto", "First North Sweden": "fnse", "AKTIETORGET": "spotlight", "Nordic SME": "ngm", "NGM": "ngm", "SINGMA": "other_venue", "Utanför handelsplats": "off_venue", "CBOE EUROPE": "mtf_si", "Oslo Børs": "foreign_exchange", "XYZ": "other_venue", "  ": "unknown", None: "unknown"}
    assert ask(spark, tx.venue_class, list(venues)) == list(venues.values())
    assert ask(spark, tx.on_venue, ["off_venue", "unknown", "xsto"]) == [False, False, True]


def test_roles(spark):
    titles = {"Verkställande direktör (VD)": ["ceo"], "Vice VD": ["deputy_ceo"], "Vice VD och CFO": ["cfo", "deputy_ceo"], "Styrelseordförande": ["chair"], "vice ordförande": ["board"], "Vice styrelseordförande": ["chair"], "Styrelsesuppleant": ["deputy_board"], "Arbetstagarrepresentant styrelseledamot": ["employee_rep"],
              "Försäljningschef": ["other_exec"], "Grundare, styrelseledamot": ["board", "owner_keyword"], "VD, affärsområdeschef": ["ceo"], "": [], None: []}
    assert ask(spark, tx.role_set, list(titles)) == list(titles.values())


def test_instruments(spark):
    assert ask(spark, tx.instrument_type, ["Aktie", "SWAP", "BTA (betald tecknad aktie)", "Annat", "", None]) == ["share", "derivative_other", "bta", None, None, None]
    assert ask(spark, tx.instrument_type_by_name, ["Bolag BTA", "Bolag TO 3", "Bolag B", "Personaloption 2024", "Bolag SDB", "", None]) == ["bta", "subscription_warrant", None, "option", "depositary_receipt", None, None]


@pytest.mark.parametrize(
    ("name", "want"),
    [("Bolag ser. B", ("B", False, False, None)), ("Bolag A-aktie", ("A", False, False, None)), ("Bolag klass c", ("C", False, False, None)), ("Bolag B", ("B", False, False, None)), ("Bolag AB", (None, False, False, None)), ("B", (None, False, False, None)), ("Bolag b", (None, False, False, None)),
     ("Bolag Pref B", ("B", True, False, None)), ("Bolag SDB", (None, False, True, None)), ("Bolag B BTA", ("B", False, False, "BTA")), ("Bolag TO 3", (None, False, False, "TO")), (None, (None, False, False, None))],
)
def test_share_class(spark, name, want):
    assert tuple(ask(spark, tx.share_class, [name])[0]) == want


def test_names(spark):
    assert ask(spark, tx.issuer_short_name, ["Bolag AB (publ)", "AKTIEBOLAGET Bolag", "Bolag & Co. Abba", "", None]) == ["bolag", "bolag", "bolag co abba", "", ""]
    names = ["Ek Investering", "Ek Stiftelsekassa", "Anna Ek", "Trust Me", "Anna", "", None, "Ek, Anna"]
    assert ask(spark, is_entity, names)[:6] == [True, True, False, True, False, False]
    assert ask(spark, is_natural_person, names) == [False, False, True, False, None, False, False, True]
    assert ask(spark, name_key, ["Ek, Anna", "EK ,Anna Maria", "Ek AB, Anna", "von Ek, Anna", "Ek,", None, "", "a, b, c", "Ａnna  Ek"]) == ["anna ek", "anna maria ek", "ek ab, anna", "von ek, anna", "ek,", None, "", "a, b, c", "anna ek"]
    assert ask(spark, tidy, ["  Ａ  b", None, ""]) == ["A b", None, ""]
    df = spark.createDataFrame([("Anna Ek", "Ek, Anna"), ("Ek AB", "Anna Ek"), ("Bo Ek", "Anna Ek"), (None, ""), (None, "Anna Ek")], "n string, p string")
    got = [r["x"] for r in df.select(associate_kind(F.col("n"), name_key(F.col("n")), name_key(F.col("p"))).alias("x")).collect()]
    assert got == ["self", "vehicle", "family", "self", "family"]


def test_small_functions(spark):
    assert ask(spark, present, ["a", "", None, " "]) == [True, False, False, True]
    assert ask(spark, slug, ["Bolag & Co. (publ)", "--x--", "Å", None, "a" * 50]) == ["bolag-co-publ", "x", "", None, "a" * 40]
    df = spark.createDataFrame([(0, 1.0), (1, 5.0), (2, 10.0), (3, float("nan")), (4, None), (5, float("inf"))], "i int, v double")
    assert [r["x"] for r in df.select("i", band_label(F.col("v"), 5, 10, ("a", "b", "c")).alias("x")).orderBy("i").collect()] == ["a", "b", "c", None, None, None]
    days = spark.createDataFrame([(0, 0), (1, 30), (2, 31), (3, 200), (4, 201), (5, None)], "i int, d int")
    assert [r["x"] for r in days.select("i", recency_label(F.col("d"), 30).alias("x")).orderBy("i").collect()] == ["IN_WINDOW", "IN_WINDOW", "OUTSIDE", "OUTSIDE", "UNKNOWN", "UNKNOWN"]


def test_median_between(spark):
    from kronolit.operators.relational import median_between

    df = spark.createDataFrame([(9.0,), (10.0,), (500.0,), (None,)], "rate double")
    assert median_between(df, "rate", 4, 20) == 10.0
    for low, high in ((4, 10), (10, 20)):
        with pytest.raises(ValueError):
            median_between(df, "rate", low, high)
    with pytest.raises(ValueError):
        median_between(df.where("rate < 0"), "rate", 4, 20)
