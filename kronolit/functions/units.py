"""What unit a text states, as Spark expressions (problem 1)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that name a unit, in lower case.
PRICE_WORDS = {
    "TSEK": ["tsek", "ksek", "tkr", "tusen kr", "tusen kronor", "tusental kronor", "tusental kr", "sek thousand", "thousand sek", "sek (000)"],
    "ORE": ["öre", "ore", "sek/100", "öre (sek)"],
    "GBX": ["gbx", "pence", "penny", "gb pence"],
    "NOK": ["nok", "nkr", "norska kronor", "norska kr"],
    "DKK": ["dkk", "dkr", "danska kronor", "danska kr"],
    "CHF": ["chf", "sfr", "schweizerfranc", "schweiziska franc", "swiss franc", "swiss francs"],
    "EUR": ["eur", "euro", "euros", "€"],
    "USD": ["usd", "us$", "$", "dollar", "dollars", "u.s. dollar", "u.s. dollars", "us-dollar"],
    "GBP": ["gbp", "£", "pund", "pund sterling", "pound", "pounds", "pound sterling", "pounds sterling"],
    "SEK": ["sek", "skr", "kr", "kronor", "krona", "svenska kronor", "svenska kr"],
}
MCAP_WORDS = {
    "MEUR": ["meur", "m€", "€m", "eurm", "eur m", "miljoner euro", "million euro", "million euros", "mn eur"],
    "MUSD": ["musd", "usdm", "usd m", "us$ m", "us$m", "m$", "$m", "miljoner dollar", "million dollars", "mn usd"],
    "BSEK": ["bsek", "mdkr", "mdr", "mdr sek", "mdr kr", "miljarder", "miljarder kronor", "miljarder kr", "sek bn", "bn sek", "sekbn"],
    "MSEK": ["msek", "mkr", "mnkr", "sekm", "sek m", "mn sek", "miljoner kronor", "miljoner kr", "miljoner sek", "million sek", "sek million"],
    "TSEK": PRICE_WORDS["TSEK"],
    "SEK": PRICE_WORDS["SEK"],
}
# SEK a unit is worth, before any exchange rate, and the currency whose rate comes on top.
UNITS = {"SEK": (1.0, None), "ORE": (0.01, None), "TSEK": (1e3, None), "MSEK": (1e6, None), "BSEK": (1e9, None), "EUR": (1.0, "EUR"), "USD": (1.0, "USD"), "NOK": (1.0, "NOK"), "DKK": (1.0, "DKK"), "GBP": (1.0, "GBP"), "GBX": (0.01, "GBP"), "CHF": (1.0, "CHF"), "MEUR": (1e6, "EUR"), "MUSD": (1e6, "USD")}


def _first(text: Column, words: dict[str, list[str]]) -> Column:
    """The unit of the first word of the lists that stands in the text; of words that start together the longest counts."""
    listed = sorted(((w, u) for u, ws in words.items() for w in ws), key=lambda x: (-len(x[0]), x[0]))
    any_word = "|".join(re.escape(w) for w, _ in listed)
    t = F.regexp_replace(F.lower(text), r"[\s\u00a0\u2007\u202f]+", " ")
    got = F.regexp_extract(t, rf"(?<![\p{{L}}\p{{N}}])({any_word})(?![\p{{L}}\p{{N}}])", 1)
    return F.create_map(*[F.lit(x) for wu in listed for x in wu])[F.nullif(got, F.lit(""))]


def price_unit(text: Column) -> Column:
    """The unit that a currency field or a piece of a note names; null if none. A bare "kr" is SEK, GBp (with a small p) pence.

    A field that is a code as it stands, as most are, needs no search."""
    codes = [u for u in ("SEK", "EUR", "USD", "NOK", "DKK", "GBP", "CHF", "GBX") if u.lower() in PRICE_WORDS[u]]
    return F.when(text.isin(*codes), text).when(text.rlike(r"(?<!\p{L})GBp(?!\p{L})"), "GBX").otherwise(_first(text, PRICE_WORDS))


def mcap_unit(text: Column) -> Column:
    return _first(F.regexp_replace(text, r"(\d)(?=\p{L}|[€$£])", "$1 "), MCAP_WORDS)


def note_unit(note: Column) -> Column:
    """The unit of the present price according to a note; null if the note says nothing of the present price.

    Of "converted from X to Y" only Y is present; "formerly in X" and costs on top of the price say nothing of it.
    """
    n = F.regexp_replace(F.lower(note), r"[\s\u00a0\u2007\u202f]+", " ")
    to = r"(?U)(?:\bfrån\b.*\btill|\bfrom\b.*\bto|\bcorrected to|\bconverted to|\bomräknat till)\b(.*)$"
    beside = r"(?U)\b(?:courtage|brokerage|commission|avgift|fee|tidigare|previously|formerly|earlier)\b"
    about = r"(?U)\b(?:pris\w*|kurs\w*|belopp\w*|price\w*|quoted|amounts?|omräknat)\b|per styck|per aktie|per share"
    present = F.when(n.rlike(to), F.regexp_extract(n, to, 1)).when(n.rlike(about) & ~n.rlike(beside), n)
    return price_unit(present)


def stated_number(text: Column) -> Column:
    """The first number of a text, with blanks, points or commas between groups of thousands; null if there is none."""
    raw = F.regexp_extract(text, r"\d[\d.,\s   ]*", 0)
    t = F.regexp_replace(raw, r"[\s   ]+|[.,\s]+$", "")
    whole = F.regexp_replace(F.regexp_replace(t, r"[.,](\d{1,2})$", ""), r"[.,]", "")
    part = F.regexp_extract(t, r"[.,](\d{1,2})$", 1)
    return F.when(raw != "", F.concat(whole, F.lit("."), part, F.lit("0")).try_cast("double"))


# Cyrillic and Greek letters in the shape of Latin ones, and what they look like.
LOOK = ("АВЕКМНОРСТУХІЈЅаеорсухіјѕԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυχɑ", "ABEKMHOPCTYXIJSaeopcyxijsdqwABEZHIKMNOPTYXaivopuxa")


def plain(text: Column) -> Column:
    """Lower-case text with look-alikes, width forms and marks reduced to ASCII where that is a matter of a table."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    t = F.regexp_replace(text, r"[̀-ͯ\p{Cf}]", "")
    t = F.translate(t, wide + LOOK[0], "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + LOOK[1])
    t = F.regexp_replace(F.regexp_replace(t, r"[\p{Z}\s]+", " "), r"\p{Pd}", "-")
    # most texts are of plain letters and single blanks already
    t = F.when(text.rlike(r"^[ -~åäöÅÄÖéÉ]*\z") & ~text.contains("  "), text).otherwise(t)
    return F.translate(F.lower(F.trim(t)), "åäáàâöøóòôéèêëüúñ", "aaaaaoooooeeeeuun")


def is_share(name: Column, kind: Column) -> Column:
    """Whether an instrument is a share, by its name and, where that is missing, its type as typed."""
    n, k = plain(name), plain(kind)
    other = r"option|obligation|\bbond|\bbta\b|\bbtu\b|\btr\b|\bto ?\d|\bkv ?\d|\bsdb\b|interim|redemption|inlosen|\bswap|futures|termin|emission|certificate|kapitalandel|konvertib|convertib|teckningsratt|unitratt|subscri|warrant|depabevis|depositary|utslapp"
    return F.when(F.coalesce(n, F.lit("")) != "", ~n.rlike(other)).otherwise(F.coalesce(k.rlike("akti|share|stamak") & ~k.rlike(other), F.lit(False)))
