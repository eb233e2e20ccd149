"""Visually identical text with different characters (problem 7)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters without a shape that are not of category Cf.
SHAPELESS = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ" + "".join(chr(c) for c in range(0xFE00, 0xFE10))
DASHES = "−⁃﹘"
#: Compatibility forms that look different from what they decompose into, and so are in order: raised and lowered ones, fractions.
OWN_SHAPE = ("<super>", "<sub>", "<fraction>")
#: Where the letters of orthographies written in Latin stand: these are themselves, whatever they resemble.
LATIN = ((0x20, 0x24F), (0x1E00, 0x1EFF))


def _asked() -> list[str]:
    """Every letter of Unicode but ideographs, syllables of Hangul and the like, which have no look-alikes in ASCII, and the letters
    of Latin orthographies."""
    wordy = ("CJK", "HANGUL", "TANGUT", "NUSHU", "KHITAN", "CUNEIFORM", "EGYPTIAN", "ANATOLIAN", "BAMUM", "VAI", "YI", "LINEAR")
    latin = set().union(*(range(a, b + 1) for a, b in LATIN))
    some = (chr(c) for c in range(0x80, 0x20000) if c not in latin and not 0xD800 <= c < 0xE000)
    return [c for c in some if unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nl") and unicodedata.name(c, "CJK").split(" ")[0] not in wordy and unicodedata.normalize("NFKC", c) == c]


def latin_lookalikes(spark: SparkSession) -> dict[str, str]:
    """Letter -> ASCII letter of the same shape, from the confusables data of the ICU library that Spark ships.

    Two letters look alike when their skeletons (Unicode Technical Standard 39) are equal; the case must agree where a letter
    has one. The skeleton of I, l and 1 is one and the same, so an upper-case letter stands for I there and any other for l.
    """
    icu = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    letters = _asked()
    skeletons = icu.getSkeleton("\n".join(letters)).split("\n")
    out = {}
    for c, s in zip(letters, skeletons, strict=True):
        if len(s) == 1 and s.isascii() and s.isalpha():
            if s == "l" and c.isupper():
                s = "I"
            if not (c.isupper() or c.islower()) or s.isupper() == c.isupper():
                out[c] = s
    return out


@lru_cache(maxsize=1)
def _script_patterns() -> dict:
    import regex

    names = ["Latin", "Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "Georgian", "Cherokee", "Coptic", "Lisu", "Deseret", "Gothic", "Osage", "Warang_Citi", "Canadian_Aboriginal", "Old_Italic", "Runic", "Carian", "Lycian", "Lydian", "Miao", "Tifinagh", "Thai", "Devanagari"]
    return {n: regex.compile(rf"\p{{scx={n}}}") for n in names} | {"Common": regex.compile(r"[\p{scx=Common}\p{scx=Inherited}]")}


@lru_cache(maxsize=1 << 16)
def scripts_of(c: str) -> frozenset[str]:
    """The scripts that a letter is used in (script extensions); empty for what belongs to all. Scripts without a name here, of which
    few letters resemble others, are told apart by the first word of the letter's name."""
    hit = frozenset(n for n, p in _script_patterns().items() if p.match(c))
    return frozenset() if "Common" in hit else hit or frozenset((unicodedata.name(c, "?").split(" ")[0],))


@lru_cache(maxsize=1 << 16)
def compatible(c: str) -> str:
    """A character without width, ligature or styled form; what has a shape of its own stays."""
    d = unicodedata.decomposition(c)
    if d.startswith(OWN_SHAPE) or (d.startswith("<compat> 0020")):  # spacing accents
        return c
    return unicodedata.normalize("NFKD", c)


def clean_pattern(one: Callable[[str], str]) -> str:
    """The texts that need no look, as a pattern: those of characters of the Latin blocks that the normalizer leaves alone."""
    runs: list[list[int]] = []
    for c in (c for a, b in LATIN for c in range(a, b + 1) if one(chr(c)) == chr(c)):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "^[" + "".join(rf"\u{a:04x}-\u{b:04x}" for a, b in runs) + "]*\\z"


def normalizer(look: dict[str, str]) -> Callable[[str], str]:
    """The function that brings one text to the consistent form.

    Invisible characters go, spaces and hyphens become plain, compatibility forms (width, ligatures, styles) resolve (NFKC but for
    raised and lowered characters, fractions and spacing accents, which look different). Then each token with a letter beyond
    Latin-with-marks is decided: every letter has the set of scripts it can be spelled in, its own (script extensions) and
    that of its look-alike; the sets are intersected over the token. One script left: the token is spelled in it. Several
    left (mixed or whole-script confusable): the script of the field's tokens that allow one script only, Latin where the field
    is silent. None left: the token honestly mixes scripts and stays. Marks are composed last (NFC).
    """
    back: dict[tuple[str, str], str] = {}
    others: dict[str, set[str]] = {}
    for c, latin in look.items():
        for script in scripts_of(c) - {"Latin"}:
            back.setdefault((latin, script), c)
            others.setdefault(latin, set()).add(script)

    def scripts(c: str) -> set[str] | frozenset[str]:
        own = scripts_of(c)
        if "Latin" in own:
            return own | others.get(look.get(c, c), set())
        return own | {"Latin"} if c in look and own else own

    def spelled(c: str, script: str) -> str:
        if script in scripts_of(c) and (script != "Latin" or c not in look):
            return c
        return look.get(c, c) if script == "Latin" else back.get((look.get(c, c), script), c)

    def run(text: str) -> str:
        seen = "".join(" " if unicodedata.category(c) in ("Zs", "Zl", "Zp") or c in "\t\n\r" else c for c in text if unicodedata.category(c) not in ("Cf", "Cc") or c in "\t\n\r")
        if any(c in SHAPELESS for c in seen):
            seen = "".join(c for c in seen if c not in SHAPELESS)
        seen = unicodedata.normalize("NFC", "".join(map(compatible, seen)))
        seen = "".join("-" if unicodedata.category(c) == "Pd" or c in DASHES else c for c in seen)
        if any(ord(c) > 0x24F and c.isalpha() for c in seen):
            tokens = [unicodedata.normalize("NFD", t) for t in seen.split(" ")]
            allowed = []
            for t in tokens:
                sets = [x for c in t if c.isalpha() and (x := scripts(c))]
                allowed.append(frozenset.intersection(*map(frozenset, sets)) if sets else None)
            sure = [next(iter(a)) for a in allowed if a is not None and len(a) == 1]
            other = max(set(sure) - {"Latin"}, key=sure.count, default=None)
            for i, a in enumerate(allowed):
                if a:
                    pick = next(iter(a)) if len(a) == 1 else other if other in a and "Latin" not in sure and not all(c.isascii() for c in tokens[i]) else "Latin"
                    if pick in a:
                        tokens[i] = "".join(spelled(c, pick) if c.isalpha() else c for c in tokens[i])
            seen = " ".join(tokens)
        return unicodedata.normalize("NFC", seen)

    return run


def consistent(spark: SparkSession, col: Column, look: dict[str, str] | None = None) -> Column:
    """The text in the consistent form; null stays null, empty stays empty. Clean text never leaves the JVM."""
    look = latin_lookalikes(spark) if look is None else look

    clean = clean_pattern(normalizer(look))

    @F.pandas_udf("string")
    def fix(s: pd.Series) -> pd.Series:
        one, known = normalizer(look), {}
        return s.map(lambda x: None if x is None else known[x] if x in known else known.setdefault(x, one(x)))

    return F.when(col.rlike(clean), col).otherwise(fix(F.when(~col.rlike(clean), col)))


def inconsistent_fields(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """id, field_name, found, form: one row per field of a row that is not in the consistent form.

    Only the values that are not clean reach Python. Nulls and empty texts are in order; repeated rows come out as often as
    they stand there.
    """
    spark = df.sparkSession
    look = latin_lookalikes(spark)
    clean = clean_pattern(normalizer(look))
    odd = [F.when(~F.col(f).rlike(clean), F.struct(F.lit(f).alias("field_name"), F.col(f).alias("found"))) for f in fields]
    long = df.select(F.col(id_col).alias("id"), F.explode(F.array_compact(F.array(*odd))).alias("x")).select("id", "x.*")
    return long.withColumn("form", consistent(spark, F.col("found"), look)).where(F.col("form") != F.col("found"))
