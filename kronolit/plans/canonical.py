"""Queries of the closed vocabularies and of revision chains over the register tables, and the same in SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kronolit.functions import taxonomy as tx
from kronolit.functions.parsing import associate_kind, is_natural_person, name_key, tidy
from kronolit.session import table
from kronolit.sources.register import canonical_rows, mapped_rows


def _values(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Each combination of values once, with its number of rows, so that it is mapped once."""
    return table(spark, d, "register_txns").groupBy(*cols).agg(F.count("*").alias("n"))


def txn_kinds(spark: SparkSession, d: str) -> DataFrame:
    v = _values(spark, d, "nature_raw").withColumn("kind", tx.txn_kind(F.col("nature_raw")))
    return v.groupBy("kind").agg(F.max(tx.direction(F.col("kind"))).alias("direction"), F.sum("n").alias("n"), F.count("*").alias("n_values"))


def venue_classes(spark: SparkSession, d: str) -> DataFrame:
    v = _values(spark, d, "venue_raw").withColumn("venue_class", tx.venue_class(F.col("venue_raw")))
    return v.select("venue_raw", "venue_class", tx.on_venue(F.col("venue_class")).alias("on_venue"), "n")


def role_sets(spark: SparkSession, d: str) -> DataFrame:
    v = _values(spark, d, "role_raw")
    return v.select("role_raw", F.array_join(tx.role_set(F.col("role_raw")), "|").alias("roles"), "n")


def instrument_types(spark: SparkSession, d: str) -> DataFrame:
    v = _values(spark, d, "instrument_type_raw", "instrument_name")
    return v.select("instrument_type_raw", "instrument_name", tx.instrument_type(F.col("instrument_type_raw")).alias("by_value"), tx.instrument_type_by_name(F.col("instrument_name")).alias("by_name"), "n")


def share_classes(spark: SparkSession, d: str) -> DataFrame:
    return _values(spark, d, "instrument_name").select("instrument_name", tx.share_class(F.col("instrument_name")).alias("x"), "n").select("instrument_name", "x.*", "n")


def issuer_short_names(spark: SparkSession, d: str) -> DataFrame:
    return _values(spark, d, "issuer_name_raw").select("issuer_name_raw", tx.issuer_short_name(F.col("issuer_name_raw")).alias("short_name"), "n")


def associates(spark: SparkSession, d: str) -> DataFrame:
    """Who notifies for whom: a person for themselves, a company, or family, and whether the person is a natural one."""
    v = _values(spark, d, "notifier_name", "pdmr_name").select("n", tidy(F.col("notifier_name")).alias("notifier"), tidy(F.col("pdmr_name")).alias("person"))
    v = v.select("n", is_natural_person(F.col("person")).alias("natural"), associate_kind(F.col("notifier"), name_key(F.col("notifier")), name_key(F.col("person"))).alias("associate_kind"))
    return v.groupBy("associate_kind", "natural").agg(F.sum("n").alias("n"))


def mapped_register(spark: SparkSession, d: str) -> DataFrame:
    """The loaded lines of the raw register as typed rows with kind, direction, venue, roles, instrument, share class and errors."""
    return mapped_rows(canonical_rows(table(spark, d, "raw_register"))[0])


QUERIES = {f.__name__: f for f in (txn_kinds, venue_classes, role_sets, instrument_types, share_classes, issuer_short_names, associates, mapped_register)}


def _re2(pattern: str, named: bool = False) -> str:
    """A pattern of ``taxonomy`` for RE2, whose word boundaries and digits know ASCII only. ``named``: what stands at a boundary is
    a group, so that a replacement can put it back."""
    o = "(" if named else "(?:"
    return tx.bounded(pattern, o + r"^|[^\p{L}\p{N}_])", o + r"$|[^\p{L}\p{N}_])").replace(r"\d", r"\p{Nd}")


def _dropped(text: str, pattern: str, by: str = "") -> str:
    """``text`` without what an alternative of the pattern matches; the patterns dropped have a boundary on both sides or on none."""
    for p in re.split(r"\|(?![^(]*\))", pattern):
        p = re.sub(r"\((?!\?)", "(?:", p)
        text = f"regexp_replace({text}, {_q(_re2(p, True))}, '{chr(92) + '1' + by + chr(92) + '2' if p.endswith(chr(92) + 'b') else chr(92) + '1' + by if p.startswith(chr(92) + 'b') else by}', 'gi')"
    return text


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# every blank of Unicode, as RE2 spells it
_SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _term(col: str) -> str:
    return f"lower(trim(regexp_replace(translate(coalesce({col}, ''), '–—', '--'), '{_SPACE}', ' ', 'g')))"


def _case(text: str, rules: list[tuple[str, str]], flags: str = "s") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {_q(_re2(p))}, '{flags}') THEN {_q(n)}" for n, p in rules) + " END"


def _list(terms: dict[str, str]) -> str:
    return "(VALUES " + ", ".join(f"({_q(a)}, {_q(b)})" for a, b in terms.items()) + ") m(a, b)"


_TITLE, _LEFT = _term("role_raw"), "left3"
# RE2 has no look-behind: a chair is a word "ordförande" that does not follow "vice "
_FOUND = ", ".join(
    [f"CASE WHEN regexp_matches(left{i}, {_q(_re2(p))}) THEN {_q(n)} END" for i, (n, p) in enumerate(tx.TAKEN_ROLES)]
    + [f"CASE WHEN regexp_matches({'replace(left3, ' + _q('vice ordförande') + ', ' + _q('vice') + ')' if n == 'chair' else 'left3'}, {_q(_re2(p.replace('(?<!vice )', '')))}) THEN {_q(n)} END" for n, p in tx.ROLES]
)
_RAW = f"trim(regexp_replace(coalesce(instrument_name, ''), '{_SPACE}', ' ', 'g'))"
_REST = _RAW
for _p in (tx.RECEIPT, tx.PREFERENCE, *(p for _, p in tx.HINTS)):
    _REST = _dropped(_REST, _p)
_REST = f"regexp_replace(regexp_replace({_REST}, '\\s+', ' ', 'g'), '^[ ,.\\-]+|[ ,.\\-]+$', '', 'g')"
SQL = {
    "txn_kinds": f"""WITH v AS (SELECT nature_raw, count(*) AS n, {_term("nature_raw")} AS t FROM register_txns GROUP BY nature_raw), k AS (SELECT coalesce(m.b, 'unmapped') AS kind, n FROM v LEFT JOIN {_list(tx.KINDS)} ON m.a = v.t)
        SELECT kind, CAST(max(CASE WHEN kind IN ('acq_purchase', 'subscription', 'grant') OR kind LIKE '%\\_in' ESCAPE '\\' THEN 1 WHEN kind IN ('disp_sale', 'redemption', 'short') OR kind LIKE '%\\_out' ESCAPE '\\' THEN -1 ELSE 0 END) AS INTEGER) AS direction, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_values FROM k GROUP BY kind""",
    "venue_classes": f"""WITH v AS (SELECT venue_raw, count(*) AS n, upper(trim(translate(coalesce(venue_raw, ''), ' ', ' '))) AS t FROM register_txns GROUP BY venue_raw), c AS (SELECT *, CASE WHEN t = '' THEN 'unknown' ELSE coalesce({_case("t", tx.VENUES)}, 'other_venue') END AS venue_class FROM v)
        SELECT venue_raw, venue_class, venue_class NOT IN ('off_venue', 'unknown') AS on_venue, n FROM c""",
    "role_sets": f"""WITH v AS (SELECT role_raw, count(*) AS n, {_TITLE} AS left0 FROM register_txns GROUP BY role_raw), a AS (SELECT *, {_dropped("left0", tx.TAKEN_ROLES[0][1], " ")} AS left1 FROM v), b AS (SELECT *, {_dropped("left1", tx.TAKEN_ROLES[1][1], " ")} AS left2 FROM a),
        c AS (SELECT *, {_dropped("left2", tx.TAKEN_ROLES[2][1], " ")} AS left3 FROM b), f AS (SELECT role_raw, n, list_sort(list_filter([{_FOUND}], lambda x: x IS NOT NULL)) AS r FROM c)
        SELECT role_raw, array_to_string(list_filter(r, lambda x: NOT (list_contains(r, 'employee_rep') AND x IN ('board', 'deputy_board')) AND NOT (list_has_any(r, ['ceo', 'cfo', 'deputy_ceo']) AND x = 'other_exec')), '|') AS roles, n FROM f""",
    "instrument_types": f"""WITH v AS (SELECT instrument_type_raw, instrument_name, count(*) AS n, {_term("instrument_type_raw")} AS t, {_term("instrument_name")} AS u FROM register_txns GROUP BY ALL)
        SELECT instrument_type_raw, instrument_name, m.b AS by_value, {_case("u", tx.INSTRUMENT_NAMES)} AS by_name, n FROM v LEFT JOIN {_list(tx.INSTRUMENTS)} ON m.a = v.t""",
    "share_classes": f"""WITH v AS (SELECT instrument_name, count(*) AS n, {_RAW} AS t, {_REST} AS rest FROM register_txns GROUP BY instrument_name)
        SELECT instrument_name, coalesce({", ".join(f"nullif(upper(regexp_extract(t, {_q(_re2(p))}, 1, 'i')), '')" for p in tx.LETTERS)}, CASE WHEN length(rest) > 2 THEN nullif(regexp_extract(rest, '\\s([A-D])$', 1), '') END) AS share_class,
        regexp_matches(t, {_q(_re2(tx.PREFERENCE))}, 'i') AS is_pref, regexp_matches(t, {_q(_re2(tx.RECEIPT))}, 'i') AS is_sdr, {_case("t", tx.HINTS, "i")} AS type_hint, n FROM v""",
    "issuer_short_names": f"""SELECT issuer_name_raw, trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(issuer_name_raw, '')), '[^\\p{{L}}\\p{{N}}_]', ' ', 'g'), {_q(tx.ISSUER_FORMS)}, ' ', 'g'), ' +', ' ', 'g')) AS short_name, count(*) AS n FROM register_txns GROUP BY issuer_name_raw""",
}
