"""Variant spellings of names typed by people (problem 2)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kronolit.llm.canonical import damerau, folded
from kronolit.session import checkpointed

# Short and pet forms of given names, each with the name it stands for.
NICKNAMES = {
    "adde": "anders", "ante": "anders", "alex": "alexander", "lexa": "alexander", "sandra": "alexandra", "anna-lena": "annalena", "annie": "annika",
    "berra": "bertil", "bettan": "elisabeth", "lisa": "elisabeth", "elsa": "elisabeth", "beth": "elisabeth", "gittan": "birgitta", "gitta": "birgitta", "bob": "robert", "robban": "robert", "rob": "robert", "bill": "william", "wille": "william", "will": "william",
    "lotta": "charlotta", "lottie": "charlotta", "charlotte": "charlotta", "dessi": "desiree", "daggan": "dagmar", "ebban": "ebba", "erkki": "erik", "erkan": "erik", "eje": "erik", "evis": "eva", "fille": "filip", "figge": "fredrik", "fredde": "fredrik", "frippe": "fredrik",
    "gurra": "gustaf", "gusten": "gustaf", "gustavo": "gustaf", "nilla": "gunilla", "gun": "gunilla", "hasse": "hans", "hampe": "hampus", "inga": "ingrid", "janne": "jan", "johan": "johan", "johnny": "john", "jocke": "joakim", "kim": "joakim", "jurre": "jurgen", "kalle": "karl", "kattis": "katarina", "kata": "katarina", "kajsa": "katarina", "stina": "kristina", "kicki": "kristina", "tina": "kristina",
    "lasse": "lars", "leffe": "leif", "maggan": "margareta", "greta": "margareta", "mange": "magnus", "tilda": "matilda", "micke": "mikael", "mike": "mikael", "nicke": "niklas", "nisse": "nils", "ogge": "oskar", "olle": "olof", "pelle": "per", "par": "per", "peter": "per", "petter": "per", "ricke": "rickard", "rickan": "rickard", "dick": "rickard", "rick": "rickard",
    "soffan": "sofia", "sofie": "sofia", "soffi": "sofia", "svenne": "sven", "sorre": "soren", "tompa": "tomas", "tommy": "tomas", "totte": "torsten", "uffe": "ulf", "vickan": "viktoria", "vicky": "viktoria", "vendla": "vendela", "zacke": "zakarias", "zac": "zakarias", "orre": "orjan", "asis": "asa",
}
# Titles before or after a name, legal forms of companies, and words for what a company is for.
TITLES = {"dr", "ing", "tekn", "prof", "professor", "fil", "med", "jur", "kand", "lic", "civ", "civing", "civilekonom", "herr", "fru", "mr", "mrs", "ms", "direktor"}
LEGAL = {"ab", "aktiebolag", "aktiebolaget", "publ", "hb", "kb", "handelsbolag", "kommanditbolag", "ltd", "limited", "inc", "oy", "oyj", "aps", "gmbh", "plc", "llc"}
PURPOSES = ["kapital", "holding", "fastigheter", "konsult", "invest", "forvaltning", "consulting", "capital", "investment", "ventures", "trading", "finans", "media", "teknik", "bygg"]


def sounds(token: str) -> str:
    """A folded token written as it sounds: c/ck/ch/q as k, ph and w/v as f, th as t, z as s, inner y and j as i, no double letters."""
    t = token
    for a, b in (("ck", "k"), ("ch", "k"), ("ph", "f"), ("th", "t"), ("c", "k"), ("q", "k"), ("w", "f"), ("v", "f"), ("z", "s")):
        t = t.replace(a, b)
    t = t[:1] + t[1:].replace("y", "i").replace("j", "i")
    return re.sub(r"(.)\1+", r"\1", t)


def plain_letters(text: str) -> str:
    """Case and marks folded; aa, ae, oe and ue, as typed for å, ä, ö and ü, become the plain vowel first."""
    t = unicodedata.normalize("NFC", text).casefold()
    return folded(re.sub(r"a[ae]|oe|ue", lambda m: m[0][0], t))


#: Nicknames as typed, and as they sound where the sound is that of one of them only.
_TYPED = {plain_letters(a): sounds(plain_letters(b)) for a, b in NICKNAMES.items()}
_HEARD = {s: next(iter(v)) for s in {sounds(a) for a in _TYPED} if len(v := {b for a, b in _TYPED.items() if sounds(a) == s}) == 1}


def given(word: str) -> str:
    """A token as it sounds, a nickname replaced by its name."""
    return _TYPED.get(word) or _HEARD.get(sounds(word), sounds(word))


def code(token: str) -> str:
    """Phonetic code: first sound and the sorted distinct consonants after it, so that vowels, doubling and swaps do not count."""
    t = sounds(token)
    return t[:1] + "".join(sorted(set(re.sub(r"[aeiou]", "", t[1:]))))


#: Jaro-Winkler similarity from which two tokens are spellings of one, and below which they are not.
LIKE, UNLIKE = 0.9, 0.8


@lru_cache(maxsize=1 << 16)
def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    m = len(hits)
    if not m:
        return 0.0
    t = sum(x != y for x, y in zip(hits, (c for c, u in zip(b, used, strict=True) if u), strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    p = 0
    while p < min(4, len(a), len(b)) and a[p] == b[p]:
        p += 1
    return jaro + p * 0.1 * (1 - jaro)


@lru_cache(maxsize=1 << 16)
def purpose_of(word: str, cut: bool) -> str | None:
    """The purpose word that a word of a company's name is: itself, cut short by a point (``cut``), or mistyped."""
    exact = next((p for p in PURPOSES if word == p or cut and len(word) > 1 and p.startswith(word)), None)
    return exact or next((p for p in PURPOSES if len(word) > 4 and abs(len(word) - len(p)) <= (few := 1 + (len(p) > 8)) and damerau(word, p) <= few), None)


def parse_name(text: str) -> dict:
    """What a typed name says: ``company``, ``number``, ``purpose`` (companies), ``tokens`` (as they sound, sorted, nicknames
    resolved), ``initials`` (letters that stand for a name), ``middle`` (the words or initials between first and last name).
    Titles are dropped."""
    t = unicodedata.normalize("NFKC", text)
    t = re.sub(r"(?<=[^\W\d_])(?<![A-ZÅÄÖÉÜØ])(?=[A-ZÅÄÖÉÜØ][^\W\d_A-ZÅÄÖÉÜØ])", " ", t)
    raw = re.findall(r"[^\W\d_]+\.?|\d+", plain_letters(re.sub(r"\b([A-Za-z])\.\s?([A-Za-z])\.(?!\w)", r"\1\2", t)))
    bare = [w.rstrip(".") for w in raw]
    company = any(w in LEGAL for w in bare) and not any(w in TITLES for w in bare)
    if company:
        number = "".join(w for w in bare if w.isdigit())
        purpose, base = "", []
        for w, dotted in zip(bare, raw, strict=True):
            if w.isdigit() or w in LEGAL:
                continue
            hit = purpose_of(w, dotted.endswith("."))
            if hit is None and len(w) > 8:  # joined to the name
                tail = next((p for p in PURPOSES if w.endswith(p) and len(w) > len(p) + 2), None)
                if tail:
                    base.append(sounds(w[: -len(tail)]))
                    purpose += sounds(tail)
                    continue
            if hit:
                purpose += sounds(hit)
            else:
                base.append(sounds(w))
        return {"company": True, "number": number, "purpose": purpose, "tokens": sorted(base), "initials": [], "middle": []}
    words = [w for w in bare if w not in TITLES and not w.isdigit()]
    middle = []
    if len(words) > 2:
        turned = "," in t.split(" ")[0]  # "Last, First Middle"
        middle, words = (words[2:], words[:2]) if turned else (words[1:-1], [words[0], words[-1]])
    full = sorted(given(w) for w in words if len(w) > 1)
    return {"company": False, "number": "", "purpose": "", "tokens": full, "initials": sorted(sounds(w)[:1] for w in words if len(w) == 1), "middle": [given(w) if len(w) > 1 else sounds(w)[:1] for w in middle]}


def keys(p: dict) -> list[str]:
    """Block keys: phonetic codes of two sorted tokens, and of one token with the first or last letters of the other, so that
    one mistyped token still meets its clean form. Companies add number and purpose. One full token with an initial:
    the code of the token, and its first and last three letters, with the initial."""
    t, out = p["tokens"], set()
    if p["company"]:
        tail = f"|{p['number']}|{p['purpose']}"
        w = "".join(t)
        return sorted({f"c|{x}{tail}" for x in (code(w), w[:2], ">" + w[-3:])})
    for i in range(len(t)):
        for j in range(len(t)):
            if i != j:
                a, b = t[i], t[j]
                if i < j:
                    out.add("|".join(sorted((code(a), code(b)))))
                out.update((f"{code(a)}|{b[:4]}<", f"{code(a)}|>{b[-4:]}", f"{code(a)}|{b[:1]}", f"{code(a)}|>{b[-2:]}"))
    return sorted(out)


def surname_keys(token: str) -> list[str]:
    return sorted({code(token), token[:3] + "<", ">" + token[-3:]})


@lru_cache(maxsize=1 << 16)
def token_cost(a: str, b: str) -> int | None:
    """Typing mistakes between two tokens, None if they are no spellings of one. Jaro-Winkler decides from ``LIKE`` up and below
    ``UNLIKE``; in between, where its greedy matching is blind to a single wrong letter, the mistakes must be few. At most 2."""
    if a == b:
        return 0
    n = min(len(a), len(b))
    if n < 3 or abs(len(a) - len(b)) > 2 or (j := jaro_winkler(a, b)) < UNLIKE:
        return None
    d = damerau(a, b)
    return d if d <= (1 if n < 6 else 2) else 2 if j >= LIKE else None


def middle_agrees(a: list[str], b: list[str]) -> bool:
    """Whether the middle names of the one can all be found among those of the other; an initial stands for any name it begins."""
    few, left = sorted((a, list(b)), key=len)
    left = list(left)
    for x in few:
        hit = next((y for y in left if (len(min(x, y, key=len)) == 1 and x[0] == y[0]) or token_cost(x, y) is not None), None)
        if hit is None:
            return False
        left.remove(hit)
    return True


def same(p: dict, q: dict) -> bool:
    """Whether two parsed names are one person or company: every token of the one has its own token in the other, with at
    most two mistakes in all, what companies must share (number, purpose) is equal, and middle names agree where
    both have any. A person needs two full tokens."""
    if p["company"] != q["company"] or p["number"] != q["number"] or p["purpose"] != q["purpose"]:
        return False
    if p["company"]:
        a, b = "".join(p["tokens"]), "".join(q["tokens"])
        return bool(a and b) and token_cost(a, b) is not None
    if p["middle"] and q["middle"] and not middle_agrees(p["middle"], q["middle"]):
        return False
    a, b = sorted((p["tokens"], q["tokens"]), key=len)
    if len(a) < 2:
        return False
    left, total = list(b), 0
    for x in a:
        got = min(((c, y) for y in left if (c := token_cost(x, y)) is not None), default=None)
        if got is None:
            return False
        total += got[0]
        left.remove(got[1])
    return total <= 2


def _key_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for g, i, name in zip(pdf["grp"], pdf["id"], pdf["name"], strict=True):
            p = parse_name(name)
            form = "\x1f".join([str(int(p["company"])), p["number"], p["purpose"], " ".join(p["tokens"]), " ".join(p["initials"]), " ".join(p["middle"])])
            rows.append((g, i, form))
        yield pd.DataFrame(rows, columns=["grp", "id", "form"])


@lru_cache(maxsize=1 << 14)
def unpack(form: str) -> dict:
    company, number, purpose, toks, initials, middle = form.split("\x1f")
    return {"company": company == "1", "number": number, "purpose": purpose, "tokens": toks.split(), "initials": initials.split(), "middle": middle.split()}


def _block_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for g, rep, form in zip(pdf["grp"], pdf["rep"], pdf["form"], strict=True):
            p = unpack(form)
            short = not p["company"] and len(p["tokens"]) == 1 and p["initials"]
            if short:
                rows.extend((g, rep, form, True, f"{k}|{i}") for k in surname_keys(p["tokens"][0]) for i in p["initials"][:1])
            else:
                rows.extend((g, rep, form, False, k) for k in keys(p))
                if not p["company"] and len(p["tokens"]) > 1:
                    rows.extend((g, rep, form, None, f"{k}|{b[:1]}") for a in p["tokens"] for b in p["tokens"] if a != b for k in surname_keys(a))
        yield pd.DataFrame(rows, columns=["grp", "rep", "form", "short", "block"])


def _accept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Accepted pairs a, b. Where one of them has a middle name and the other has none, ``bare`` is the one without and ``sign`` the
    middle name of the other as it sounds."""
    for pdf in batches:
        out = []
        for a, b, fa, fb in zip(pdf["a"], pdf["b"], pdf["form_a"], pdf["form_b"], strict=True):
            p, q = unpack(fa), unpack(fb)
            if same(p, q):
                one = bool(p["middle"]) != bool(q["middle"])
                m = (p["middle"] or q["middle"])[0] if one else None
                out.append((a, b, (b if p["middle"] else a) if one else None, m[:1] if one else None, code(m) if one and len(m) > 1 else None))
        yield pd.DataFrame(out, columns=["a", "b", "bare", "initial", "sign"]).astype({"bare": "Int64"} if pdf["a"].dtype.kind == "i" else {})


def agreed_pairs(accepted: DataFrame) -> DataFrame:
    """a, b: the accepted pairs, but a name without a middle name is linked to names with one only if all those agree on it."""
    loose = accepted.where("bare is not null")
    one = loose.groupBy("bare").agg(F.min("initial").alias("i"), F.max("initial").alias("j"), F.min("sign").alias("s"), F.max("sign").alias("t")).where("i = j and (s is null or s = t)").select("bare")
    return accepted.where("bare is null").select("a", "b").unionByName(loose.join(one, "bare", "left_semi").select("a", "b"))


def _accept_short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """An initial and one token against a full name: another token must begin with the initial."""
    for pdf in batches:
        ok = []
        for s, f in zip(pdf["form_a"], pdf["form_b"], strict=True):
            p, q = unpack(s), unpack(f)
            t, i = p["tokens"][0], p["initials"][0]
            if len(q["tokens"]) < 2:
                ok.append(q["initials"][:1] == [i] and token_cost(t, q["tokens"][0]) is not None)
            else:
                ok.append(any(token_cost(t, a) is not None and any(b != a and b.startswith(i) for b in q["tokens"]) for a in q["tokens"]))
        yield pdf.loc[ok, ["a", "b"]]


def components(edges: DataFrame) -> DataFrame:
    """id, component (its smallest id) of every vertex of ``edges`` (a, b), by alternating large-star and small-star steps.

    Each round is a grouped minimum and a join; the edges are written to the shared checkpoint folder after each. Ends only when
    a round changes nothing, which is when every edge leads to its component's smallest id; a chain of n vertices takes O(log n) rounds. Nothing is collected but one number a round.
    """
    e = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a != b").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        e = checkpointed(small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    members = e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
    return members.unionByName(members.select(F.col("component").alias("id"), "component").distinct())


def linked_names(names: DataFrame, id_col: str = "name_id", group: str = "issuer_key", name: str = "full_name") -> DataFrame:
    """id, grp, entity: every row with a non-blank name and a group, ``entity`` the smallest id of its person or company.

    1. Rows whose parsed name is the same (case, order, title, legal form, nickname) are one form, by a grouped minimum, so
       copies never meet in pairs. 2. Forms meet in blocks of a group (``keys``) and are compared (``same``: Jaro-Winkler on
       tokens as they sound, nicknames resolved). Different middle names tell persons apart; a form without one joins those
       that have one only if they agree. 3. Accepted pairs are joined by connected components. 4. Forms of
       an initial and one token join the only entity of their group that fits; where several fit they stay by themselves,
       and equal ones stay together. Null or blank names or groups belong to nobody and are left out.
    """
    n = names.select(F.col(id_col).alias("id"), F.col(group).alias("grp"), F.col(name).alias("name")).where("id is not null and grp is not null and trim(name) != ''")
    idt = dict(n.dtypes)["id"]
    forms = checkpointed(n.mapInPandas(_key_rows, f"grp string, id {idt}, form string"))
    reps = checkpointed(forms.groupBy("grp", "form").agg(F.min("id").alias("rep")))
    blocks = checkpointed(reps.mapInPandas(_block_rows, f"grp string, rep {idt}, form string, short boolean, block string"))
    full = blocks.where("not short").select("grp", "block", F.col("rep").alias("a"), F.col("form").alias("form_a"))
    other = full.select("grp", "block", F.col("a").alias("b"), F.col("form_a").alias("form_b"))
    cand = full.join(other, ["grp", "block"]).where("a < b").select("a", "b", "form_a", "form_b").distinct()
    accepted = checkpointed(cand.mapInPandas(_accept, f"a {idt}, b {idt}, bare {idt}, initial string, sign string"))
    comp = components(agreed_pairs(accepted))
    ent = reps.join(comp, reps["rep"] == comp["id"], "left").select("grp", "form", "rep", F.coalesce("component", "rep").alias("entity"))
    ent = checkpointed(ent)
    short = blocks.where("short").select("grp", "block", F.col("rep").alias("a"), F.col("form").alias("form_a"))
    hosts = blocks.where("short is null").select("grp", "block", F.col("rep").alias("b"), F.col("form").alias("form_b"))
    fits = short.join(hosts, ["grp", "block"]).select("a", "b", "form_a", "form_b").distinct().mapInPandas(_accept_short, f"a {idt}, b {idt}")
    fits = fits.join(ent.select(F.col("rep").alias("b"), "entity"), "b").groupBy("a").agg(F.min("entity").alias("lo"), F.max("entity").alias("hi"))
    fits = fits.where("lo = hi").select(F.col("a").alias("rep"), F.col("lo").alias("host"))
    final = ent.join(fits, "rep", "left").select("grp", "form", F.coalesce("host", "entity").alias("entity"))
    out = forms.join(final, ["grp", "form"]).select("id", "grp", "entity")
    low = out.groupBy("entity").agg(F.min("id").alias("lowest"))
    return out.join(low, "entity").select("id", "grp", F.col("lowest").alias("entity"))


def linked_pairs(entities: DataFrame) -> DataFrame:
    """a, b (a < b): every two rows of one entity. The rows asked for are quadratic in an entity's spellings, which are few."""
    x = entities.select("entity", F.col("id").alias("a"))
    y = entities.select("entity", F.col("id").alias("b"))
    return x.join(y, "entity").where("a < b").select("a", "b").distinct()
