"""Closed vocabularies of the register (kind, venue, role, instrument, share class) as Spark expressions. What is not listed is
``unmapped`` or null, never guessed."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Nature of a transaction as the register writes it, and its kind.
KINDS = {
    "förvärv": "acq_purchase", "avyttring": "disp_sale", "teckning": "subscription", "tilldelning": "grant", "lösen ökning": "exercise_in", "lösen minskning": "exercise_out", "gåva mottagen": "gift_in", "gåva lämnad": "gift_out",
    "lån utlåning": "loan_out", "lån mottaget": "loan_in", "lån återgång ökning": "loan_return_in", "lån återgång minskning": "loan_return_out", "utbyte ökning": "exchange_in", "utbyte minskning": "exchange_out",
    "konvertering ökning": "conversion_in", "konvertering minskning": "conversion_out", "utdelning mottagen": "dividend_in", "utdelning lämnad": "dividend_out", "inlösen egenutfärdat instrument": "redemption", "utfärdande av instrument": "issuance",
    "pantsättning": "pledge", "pantsättning åter": "pledge_release", "fusion ökning": "merger_in", "fusion minskning": "merger_out", "fission ökning": "demerger_in", "fission minskning": "demerger_out",
    "interntransaktion - förvärv": "internal_in", "interntransaktion - avyttring": "internal_out", "koncernintern överföring ökning": "internal_in", "koncernintern överföring förvärv": "internal_in", "koncernintern överföring minskning": "internal_out", "koncernintern överföring avyttring": "internal_out",
    "arv mottagen": "inheritance_in", "arv ökning": "inheritance_in", "arv lämnad": "inheritance_out", "arv minskning": "inheritance_out", "bodelning ökning": "division_in", "bodelning förvärv": "division_in", "bodelning minskning": "division_out", "bodelning avyttring": "division_out", "blankning": "short",
    "acquisition": "acq_purchase", "disposal": "disp_sale", "subscription": "subscription", "allotment": "grant",
}
# Kinds that raise or lower a holding without saying so in their name.
RAISING, LOWERING = ["acq_purchase", "subscription", "grant"], ["disp_sale", "redemption", "short"]
# Venue classes in the order in which they are tried, each with the pattern of its names in upper case.
VENUES = [
    ("off_venue", r"UTANFÖR|OUTSIDE|OFF-EXCHANGE|NO MARKET|UNLISTED"),
    ("fnse", r"FIRST NORTH"),
    ("spotlight", r"SPOTLIGHT|AKTIETORGET"),
    ("ngm", r"NORDIC GROWTH MARKET|NORDIC SME|NORDIC MTF|\bNGM\b"),
    ("xsto", r"STOCKHOLM.*(NASDAQ|OMX)|(NASDAQ|OMX).*STOCKHOLM"),
    ("mtf_si", r"SYSTEMATIC INTERNALI|\bSI\b|\bMTF\b|CBOE|AQUIS|TURQUOISE|DARK|BLOOMBERG|INTERACTIVE BROKERS|\bATS\b|SEB ENSKILDA|HANDELSBANKEN|SWEDBANK|NORDEA|DANSKE|CARNEGIE|POSIT|EQUIDUCT|LIQUIDNET|\bUBS\b|GOLDMAN|MORGAN|CITI|BARCLAYS|VIRTU|JANE STREET|\bXTX\b|OPTIVER|SUSQUEHANNA|BATS|CHI-X|INSTINET|KEPLER|SIGMA X|FIDELITY|CROSSSTREAM|TOWER RESEARCH|DEUTSCHE BANK|CREDIT SUISSE|NASDAQ OMX EUROPE|INTERNET DIRECT-ACCESS"),
    ("foreign_exchange", r"TORONTO|\bTSX|OSLO|HELSINKI|COPENHAGEN|KØBENHAVN|LONDON|NEW YORK|NYSE|XETRA|FRANKFURT|EURONEXT|\bSIX\b|WARSAW|ICELAND|TALLINN|RIGA|VILNIUS|\bOTC|ASX|AUSTRALIAN|BÖRSE|BORSE|BOERSE|BORSA|MADRID|VIENNA|CANADIAN|\bCSE\b|VENTURE|TRADEGATE|MERKUR|NASDAQ CAPITAL MARKET|NORWEGIAN OVER THE COUNTER"),
]
# Roles and the pattern of their titles in lower case. What the first three match is no part of a later title.
TAKEN_ROLES = [
    ("employee_rep", r"arbetstagarrepresentant|arbetstagarsuppleant|employee representative"),
    ("other_admin_body", r"annan medlem i bolagets administrations"),
    ("deputy_ceo", r"\b(vice|deputy|ställföreträdande|biträdande)\s*(vd|verkställande|ceo|managing director|chief executive)"),
]
ROLES = [
    ("ceo", r"verkställande direktör|\bvd\b|\bceo\b|managing director|chief executive"),
    ("cfo", r"ekonomichef|finanschef|finansdirektör|\bcfo\b|chief financial|ekonomi\s*/|ekonomidirektör"),
    ("chair", r"(?<!vice )(styrelse)?ordförande|chairman|\bchair\b"),
    ("deputy_board", r"suppleant|board deputy|deputy board|alternate"),
    ("board", r"styrelseledamot|styrelsemedlem|\bledamot\b|board member|member of the board|board of directors|\bdirector\b|\bstyrelse\b|vice ordförande|adjungerad"),
    ("other_exec", r"annan ledande befattningshavare|koncernledning|ledningsgrupp|\bchef\b|chef\b|\bhead\b|\bcoo\b|\bcto\b|\bcmo\b|\bcio\b|\bcco\b|\bcso\b|\bcpo\b|\bcdo\b|\bchro\b|general counsel|chefsjurist|affärsområde|business area|president|\bvp\b|\bsvp\b|\bevp\b|direktör|officer|manager|controller|ec member|management team|verkställande ledning|redovisningsansvarig"),
    ("owner_keyword", r"ägare|\bowner\b|grundare|founder|aktieägare|shareholder|10\s*\+?\s*%"),
]
# Instrument types as the register writes them, and the patterns of instrument names in the order in which they are tried.
INSTRUMENTS = {
    "aktie": "share", "share": "share", "teckningsoption": "subscription_warrant", "bta (betald tecknad aktie)": "bta", "btu (betald tecknad unit)": "btu", "teckningsrätt/uniträtt": "subscription_right", "teckningsrätt": "subscription_right",
    "option": "option", "köpoption": "option", "säljoption": "option", "syntetisk option": "option", "warrant": "warrant", "obligation": "bond", "företagscertifikat": "bond", "konvertibel": "convertible", "övriga derivatkontrakt": "derivative_other", "swap": "derivative_other", "terminer": "derivative_other",
    "finansiella kontrakt avseende prisdifferenser (cfd)": "derivative_other", "inlösenaktie": "redemption_share", "inlösenrätt": "redemption_right", "interimsaktie": "interim_share", "kapitalandelsbevis": "capital_certificate", "depåbevis": "depositary_receipt", "utsläppsrätt": "emission_allowance", "auktionerad produkt baserad på en utsläppsrätt": "emission_allowance",
}
INSTRUMENT_NAMES = [
    ("bta", r"\bbta\b|betald tecknad aktie"), ("btu", r"\bbtu\b|betald tecknad unit"), ("subscription_warrant", r"teckningsoption|\bto\s?\d|\bto\b|\bwarrants? (series|serie)|optionsrätt"), ("subscription_right", r"teckningsrätt|uniträtt|\btr\b|\bur\b|subscription right"),
    ("interim_share", r"interimsaktie|\bia\b"), ("convertible", r"konvertib|\bkv\b|convertible"), ("bond", r"obligation|\bbond\b|\bfrn\b|certifikat|\bnote\b"), ("redemption_share", r"inlösenaktie|\bia\b|\bir\b"), ("option", r"option|köpopt|säljopt|\bcall\b|\bput\b|\blti\b|aktiesparprogram|personaloption"),
    ("warrant", r"warrant"), ("depositary_receipt", r"depåbevis|\bsdb\b|\bsdr\b"),
]
# Marks of depositary receipts, preference shares, issue instruments and class letters in an instrument's name.
RECEIPT, PREFERENCE = r"\b(sdb|sdr)\b|depåbevis", r"\bpref\b|\bpreferens(aktie)?\b|\bpreference\b"
HINTS = [("BTA", r"\bbta\b"), ("BTU", r"\bbtu\b"), ("TO", r"\bto\s?\d+\b"), ("TR", r"\btr\b")]
LETTERS = [r"\bser(?:ie)?\.?\s*([a-d])\b", r"\b(?:class|klass)\s*([a-d])\b", r"\b([a-d])[- ]aktie"]
ISSUER_FORMS = r"\b(publ|aktiebolag|aktiebolaget|ab)\b"


def bounded(pattern: str, left: str = r"(?<![\p{L}\p{N}_])", right: str = r"(?![\p{L}\p{N}_])") -> str:
    """The pattern with its word boundaries written out: a word is of letters, digits and underscores of any script, and nothing that
    joins characters unseen is part of one. A boundary before a letter or a group is a left one."""
    return re.sub(r"\\b(?=[^\W_]|\()", lambda m: left, pattern).replace(r"\b", right)


def plain_term(text: Column) -> Column:
    """Lower case, one kind of dash, single blanks; null is empty."""
    return F.lower(F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "–—", "--"), r"(?U)\s+", " ")))


def _first_of(text: Column, rules: list[tuple[str, str]], flags: str = "(?U)") -> Column:
    return F.coalesce(*[F.when(text.rlike(flags + bounded(p)), name) for name, p in rules])


def _listed(text: Column, terms: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in terms.items() for x in kv])[text]


def txn_kind(nature: Column) -> Column:
    return F.coalesce(_listed(plain_term(nature), KINDS), F.lit("unmapped"))


def direction(kind: Column) -> Column:
    """1 if a kind raises a holding, -1 if it lowers one, else 0."""
    up = kind.isin(*RAISING) | kind.endswith("_in")
    return F.when(up, 1).when(kind.isin(*LOWERING) | kind.endswith("_out"), -1).otherwise(0)


def venue_class(venue: Column) -> Column:
    """The first class whose pattern the name has, ``other_venue`` for any other name, ``unknown`` for none."""
    t = F.upper(F.trim(F.translate(F.coalesce(venue, F.lit("")), " ", " ")))
    return F.when(t == "", "unknown").otherwise(F.coalesce(_first_of(t, VENUES, "(?Us)"), F.lit("other_venue")))


def on_venue(venue_cls: Column) -> Column:
    return ~venue_cls.isin("off_venue", "unknown")


def role_set(title: Column) -> Column:
    """The roles of a title, sorted; an employee representative is no ordinary member of the board, a chief no other executive."""
    left, found = plain_term(title), []
    for name, p in TAKEN_ROLES:
        found.append(F.when(left.rlike("(?U)" + bounded(p)), name))
        left = F.regexp_replace(left, "(?U)" + bounded(p), " ")
    found += [F.when(left.rlike("(?U)" + bounded(p)), name) for name, p in ROLES]
    all_ = F.array_sort(F.array_compact(F.array(*found)))
    without = lambda when, drop: F.when(F.arrays_overlap(all_, F.array(*map(F.lit, when))), F.array(*map(F.lit, drop))).otherwise(F.array().cast("array<string>"))
    return F.array_except(F.array_except(all_, without(["employee_rep"], ["board", "deputy_board"])), without(["ceo", "cfo", "deputy_ceo"], ["other_exec"]))


def instrument_type(kind: Column) -> Column:
    return _listed(plain_term(kind), INSTRUMENTS)


def instrument_type_by_name(name: Column) -> Column:
    return _first_of(plain_term(name), INSTRUMENT_NAMES)


def share_class(name: Column) -> Column:
    """Struct share_class (A to D or null), is_pref, is_sdr, type_hint of an instrument's name. A class letter stands behind "serie"
    or "class", before "aktie", or, as a capital, at the end of what is left without the other marks."""
    t = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)\s+", " "))
    rest = t
    for p in (RECEIPT, PREFERENCE, *(p for _, p in HINTS)):
        rest = F.regexp_replace(rest, "(?iuU)" + bounded(p), "")
    rest = F.regexp_replace(F.regexp_replace(rest, r"\s+", " "), r"^[ ,.\-]+|[ ,.\-]+$", "")
    letter = F.coalesce(*[F.nullif(F.upper(F.regexp_extract(t, "(?iuU)" + bounded(p), 1)), F.lit("")) for p in LETTERS], F.when(F.length(rest) > 2, F.nullif(F.regexp_extract(rest, r"\s([A-D])\z", 1), F.lit(""))))
    return F.struct(letter.alias("share_class"), t.rlike("(?iuU)" + bounded(PREFERENCE)).alias("is_pref"), t.rlike("(?iuU)" + bounded(RECEIPT)).alias("is_sdr"), _first_of(t, HINTS, "(?iuU)").alias("type_hint"))


def issuer_short_name(name: Column) -> Column:
    """An issuer's name in lower case without its legal form and punctuation; null is empty."""
    t = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}_]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "(?U)" + bounded(ISSUER_FORMS), " "), " +", " "))
