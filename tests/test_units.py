import datetime as dt
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kronolit.functions.units import is_share, mcap_unit, note_unit, price_unit, stated_number
from kronolit.operators.units import CAP, PENALTY, PRICE_UNITS, SIGMA, _chain, _deciding, _summaries, mcap_units, point_costs, price_units, segment_levels, sure_points


def ask(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r["x"] for r in df.select("i", f(F.col("s")).alias("x")).orderBy("i").collect()]


def test_words(spark):
    words = {"SEK": "SEK", " sek": "SEK", "Svenska kronor": "SEK", "kr": "SEK", "SEK/st": "SEK", "SEK/100": "ORE", "Öre (SEK)": "ORE", "ÖRE": "ORE", "SEK (000)": "TSEK", "tusen kr": "TSEK", "kSEK": "TSEK", "€": "EUR", "euros": "EUR",
             "U.S. dollar": "USD", "US$": "USD", "Dollar (US)": "USD", "norska kronor": "NOK", "NKr": "NOK", "danska kr": "DKK", "SFr": "CHF", "GBp": "GBX", "GB pence": "GBX", "Pund": "GBP", "£": "GBP", None: None, "": None, "xyz": None}
    assert ask(spark, price_unit, list(words)) == list(words.values())
    sizes = {"Mkr": "MSEK", "SEKm": "MSEK", "miljoner kr": "MSEK", "SEK bn": "BSEK", "Mdr SEK": "BSEK", "mdkr": "BSEK", "SEK thousand": "TSEK", "US$ m": "MUSD", "m€": "MEUR", "ca 1 234,50 Mkr": "MSEK", "12,5USDm": "MUSD", "kr": "SEK", None: None}
    assert ask(spark, mcap_unit, list(sizes)) == list(sizes.values())


def test_notes(spark):
    notes = {"pris: euro, ej omräknat": "EUR", "Kursen avser norska kronor per aktie": "NOK", "Beloppen i prisfältet är i öre": "ORE", "price quoted in GBX": "GBX", "OBS: USD (pris per styck)": "USD", "Nu omräknat från euro till kronor": "SEK",
             "previously reported in USD, now corrected to SEK": "SEK", "Rättat pris, tidigare felaktigt angivet i öre": None, "Courtage på 45 euro tillkommer, ingår ej i priset": None, "Rättelse": None, "Volymen avrundad": None, None: None, "": None}
    assert ask(spark, note_unit, list(notes)) == list(notes.values())


def test_numbers(spark):
    texts = {"market cap 1 033,73 MSEK": 1033.73, "ca 30,100.86 Mkr": 30100.86, "4.24 Mdr SEK enligt bokslut": 4.24, "47585753,87 TSEK": 47585753.87, "31 089 608 kr": 31089608.0, "ingen": None, None: None, "": None}
    assert ask(spark, stated_number, list(texts)) == list(texts.values())


def test_shares(spark):
    names = {"Bolag B": True, "Bolag serie A": True, "Bolag ser. B": True, "Bolag Α-аktie": True, "Bolag TO 3": False, "Bolag köpoption 2026-03": False, "Bolag köpοptiοn 2026": False, "Ｂｏｌａｇ SDB": False, "Bolag swaр": False, "": False}
    df = spark.createDataFrame([(i, v) for i, v in enumerate(names)], "i int, s string")
    assert [r["x"] for r in df.select("i", is_share(F.col("s"), F.lit(None).cast("string")).alias("x")).orderBy("i").collect()] == list(names.values())


@pytest.mark.parametrize("seed", range(25))
def test_segmentation_is_optimal(seed):
    """Least cost over all assignments of levels, one by one."""
    r = random.Random(seed)
    n, m = r.randint(1, 6), 3
    levels = np.tile([0.0, 2.0, -3.0], (n, 1))
    y = np.array([r.choice([0.0, 2.0, -3.0, 1.0, 9.0]) + r.gauss(0, 0.1) for _ in range(n)])
    prior = np.array([[0.0, r.choice([0, 2, 6]), r.choice([0, 2, 6])] for _ in range(n)])
    block = np.array([0] * (n // 2) + [1] * (n - n // 2))
    got = segment_levels(y, levels, prior, block)

    def cost(path):
        c = 0.0
        for i, s in enumerate(path):
            misfit = ((y[i] - levels[i, s]) / SIGMA) ** 2 / 2
            c += (min(misfit, CAP) if s == 0 else misfit if misfit < CAP else 1e9) + prior[i, s]
            before = path[i - 1] if i and block[i - 1] == block[i] else 0
            c += PENALTY * (s != before)
        return c

    best = min(cost(p) for p in itertools.product(range(m), repeat=n))
    assert cost(tuple(got)) <= best + 1e-9


@pytest.mark.parametrize("seed", range(30))
def test_parts_and_batches_cannot_be_seen(seed):
    """Histories cut into parts and batches at random: the same cost as the search in memory over the whole history."""
    r, m = random.Random(seed), 4
    n = r.choice([1, 5, 40])
    levels = np.tile([0.0, 2.0, -3.0, 1.7], (n, 1))
    y = np.cumsum([r.random() < 0.2 for _ in range(n)]) % 3 * 2.0 - 2 + np.array([r.gauss(0, 0.15) for _ in range(n)])
    prior = np.array([[0.0, *(r.choice([0, 2, 6]) for _ in range(m - 1))] for _ in range(n)])
    cost, hist = point_costs(y, levels, prior), np.sort([r.randrange(2) for _ in range(n)])
    sure = sure_points(cost)
    part = np.zeros(n, dtype=int)
    for i in range(1, n):
        part[i] = 0 if hist[i] != hist[i - 1] else part[i - 1] + (r.random() < 0.3)
    near = lambda i, d: bool(0 <= i + d < n and hist[i + d] == hist[i] and part[i + d] == part[i] and sure[i + d])
    first = lambda i: i == 0 or hist[i - 1] != hist[i] or part[i - 1] != part[i]
    rows = pd.DataFrame({"hist": hist.astype(str), "part": [f"{p:03}" for p in part], "cost": [None if s else c for c, s in zip(cost, sure, strict=True)], "cut": [near(i, -1) for i in range(n)], "stop": [near(i, 1) for i in range(n)], "first_": [first(i) for i in range(n)]})
    rows = rows.assign(kind="price", id=np.arange(n), value=1.0, day=None, unit="SEK", sek=1.0, worth=[[0.0] * m] * n)

    def batches(df):
        i = 0
        while i < len(df):
            k = r.randint(1, 7)
            yield df.iloc[i : i + k]
            i += k

    sums = pd.concat(_summaries(m, PENALTY)(batches(rows[rows["cost"].notna() | rows["first_"]])))
    ends = pd.concat(_chain(m)(batches(sums)))
    both = rows.drop(columns="first_").merge(ends, on=["hist", "part"], how="left")
    units = ["ORE", "TSEK", "EUR"]
    out = pd.concat(_deciding(units, PENALTY, hold=r.choice([2, 50_000]))(batches(both))).set_index("id")["unit"]
    got = np.array([["SEK", *units].index(out[i]) for i in range(n)])

    def total(path):
        change = [PENALTY * (s != (path[i - 1] if i and hist[i - 1] == hist[i] else 0)) for i, s in enumerate(path)]
        return sum(change) + cost[np.arange(n), path].sum()

    assert total(got) == pytest.approx(total(segment_levels(y, levels, prior, hist)))


def test_batch_size_cannot_be_seen(spark):
    r, rows = random.Random(3), []
    for i in range(300):
        unit = ["SEK", "ORE", "EUR"][(i // 20) % 3]
        price = 100 * {"SEK": 1, "ORE": 100, "EUR": 1 / 11.5}[unit] * (1 + r.gauss(0, 0.1))
        rows.append((i, "a", "bulk", price, D + dt.timedelta(days=i // 3), AT, None, None, "Bolag B", None, "", 0.0, ""))
    df, got = spark.createDataFrame(rows, T), []
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("3", "17", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got.append(sorted((x["id"], x["unit"]) for x in price_units(df.repartition(5), points(spark), fx(spark)).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got[0] == got[1] == got[2] and {"SEK", "ORE"} < {u for _, u in got[0]} < set(PRICE_UNITS)


T = "row_id long, issuer_key string, source string, price double, trade_date date, published_at timestamp_ntz, amendment_note string, currency string, instrument_name string, instrument_type_raw string, unit string, y double, day string"
P = "point_id long, issuer_key string, as_of_day date, mcap_sek double, mcap_unit string, mcap_text string, shares double, price_used double, value double, price_source string"
D = dt.date(2024, 5, 6)
AT = dt.datetime(2024, 5, 7, 9)


def fx(spark):
    return spark.createDataFrame([("EUR", D, 11.5), ("EUR", D, 11.5), ("USD", D - dt.timedelta(days=3), 10.5), ("NOK", D, 0.98), ("DKK", D, 1.55), ("GBP", D, 13.0), ("CHF", D, 12.0)], "currency string, fx_date date, rate double")


def points(spark, rows=None):
    rows = rows if rows is not None else [(1, "a", D - dt.timedelta(days=5), 1e9, None, None, 1e7, 100.0, 0.0, None)]
    return spark.createDataFrame(rows, P)


def test_prices(spark):
    rows = [
        (1, 101.0, None, "SEK", "Bolag B", "SEK"), (2, 10100.0, None, "SEK", "Bolag B", "ORE"), (3, 0.099, None, None, "Bolag B", "TSEK"), (4, 8.8, None, "EUR", "Bolag B", "EUR"), (5, 8.8, "pris: euro, ej omräknat", "SEK", "Bolag B", "EUR"),
        (6, 99.0, "Nu omräknat från euro till kronor", "EUR", "Bolag B", "SEK"), (7, 10100.0, None, "SEK", "Bolag TO 3", "SEK"), (8, 5.0, None, "usd", "Bolag köpoption 2026", "USD"), (9, 0.0, None, "öre", "Bolag B", "ORE"),
        (10, float("nan"), None, "SEK", "Bolag B", "SEK"), (11, 102.0, None, None, None, "SEK"), (12, 770.0, None, "GBX", "Bolag B", "GBX"),
    ]
    df = spark.createDataFrame([(i, "a", "bulk", p, D, AT, n, c, name, None, "x", 1.0, "z") for i, p, n, c, name, _ in rows] + [(90, "a", "bulk", None, D, AT, None, "EUR", "B", None, "", 0.0, "")], T)
    got = {r["id"]: r for r in price_units(df, points(spark), fx(spark)).collect()}
    assert {i: got[i]["unit"] for i in got} == {r[0]: r[-1] for r in rows}
    assert got[4]["sek"] == pytest.approx(8.8 * 11.5) and got[2]["sek"] == pytest.approx(101.0) and got[12]["sek"] == pytest.approx(100.1) and got[8]["sek"] == pytest.approx(52.5)


def test_price_edges(spark):
    rows = [(1, None, None, 5.0, None, None, None, "EUR", None, None, "", 0.0, ""), (2, "b", None, 7.0, D, None, "", "", "", "", "", 0.0, ""), (2, "b", None, 7.0, D, None, "", "", "", "", "", 0.0, ""), (3, "a", None, 6.0, dt.date(2030, 1, 1), None, "x" * 100_000, "EUR", "y" * 100_000, None, "", 0.0, "")]
    df = spark.createDataFrame(rows, T)
    got = sorted((r["id"], r["unit"], r["sek"]) for r in price_units(df, points(spark), fx(spark)).collect())
    assert got == [(1, "EUR", None), (2, "SEK", 7.0), (2, "SEK", 7.0), (3, "EUR", 69.0)]
    none = points(spark, [])
    assert price_units(df.where("false"), points(spark), fx(spark)).count() == 0
    assert price_units(df, none, fx(spark).where("false")).count() == 4


def test_mcaps(spark):
    rows = [
        (1, 1e9, None, None, 1e7, "SEK"), (2, 1e6, None, None, 1e7, "TSEK"), (3, 1000.0, None, "ca 1 000,00 MSEK", 1e7, "MSEK"), (4, 1e9, "SEK", "ca 1 000,00 MSEK", 1e7, "SEK"), (5, 1.0, "mdkr", None, 1e7, "BSEK"), (6, 1e9 / 11.5 / 1e6, None, None, 1e7, "MEUR"),
        (7, 1e9 / 10.5 / 1e6, "US$ m", None, 1e7, "MUSD"), (8, 87.0, None, "Börsvärde 87.00 MEUR", None, "MEUR"), (9, 1000.0, None, None, None, "MSEK"), (10, 250.0, None, "ca 250,00 MEUR", None, "MEUR"),
    ]
    table = [(i, "a", D, v, u, t, s, 100.0, 0.0, "register") for i, v, u, t, s, _ in rows]
    table += [(20, None, D, 5.0, None, None, None, None, 0.0, None), (21, "c", None, 5.0, "Mkr", "", 1.0, 1.0, 0.0, ""), (22, "a", D, None, "Mkr", None, 1e7, 100.0, 0.0, None)]
    got = {r["id"]: r["unit"] for r in mcap_units(points(spark, table), fx(spark)).collect()}
    assert got == {r[0]: r[-1] for r in rows} | {20: "SEK", 21: "MSEK"}
    assert mcap_units(points(spark, []), fx(spark)).count() == 0
