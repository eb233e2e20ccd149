import random

import pytest

from kronolit.llm.spans import SharedSpans, anchors, common

S = "doc_id long, text string, hash long, tid long, doc int"


def brute(rows, span):
    where = {}
    texts = {}
    for i, t, *_ in rows:
        if i is not None and t is not None and len(t) >= span:
            texts[i] = t
            for k in range(len(t) - span + 1):
                where.setdefault(t[k : k + span], set()).add(i)
    pairs = {(a, b) for v in where.values() for a in v for b in v if a < b}
    cover = {}
    for i, t in texts.items():
        c = bytearray(len(t))
        for k in range(len(t) - span + 1):
            if len(where[t[k : k + span]]) > 1:
                c[k : k + span] = b"\1" * span
        cover[i] = sum(c)
    return pairs, cover


def corpus(seed, span):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abcåé 🙂\n") for _ in range(n))
    shared = [word(r.choice([span - 1, span, span + 1, 2 * span, 5 * span])) for _ in range(5)] + ["z" * (2 * span)]
    stock = word(span * 3 // 4)  # a phrase of many documents, too short to be a span
    rows = []
    for i in range(50):
        parts = [word(r.randint(0, 2 * span))]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice([*shared, stock, stock, stock]), word(r.randint(0, span))]
        rows.append((i, "".join(parts), 0, 0, 0))
    return [*rows, (100, rows[3][1], 0, 0, 0), (101, rows[3][1], 0, 0, 0), (102, None, 0, 0, 0), (103, "", 0, 0, 0), (104, shared[1], 0, 0, 0)]


@pytest.mark.parametrize(("seed", "limit"), [(1, 64), (2, 1), (3, 3), (4, 1), (5, 64)])
def test_against_brute_force(spark, seed, limit):
    span = 24
    rows = corpus(seed, span)
    s = SharedSpans(spark.createDataFrame(rows, S), span=span, gram=9, limit=limit)
    pairs, cover = brute(rows, span)
    assert {tuple(r) for r in s.pairs().collect()} == pairs
    group = {}
    for r in s.members().collect():
        group.setdefault(r["rep"], set()).add(r["doc_id"])
    links = {tuple(r) for r in s.links_of_representatives().collect()}
    whole = {(a, b) for m in group.values() for a in m for b in m} | {p for x, y in links for a in group[x] for b in group[y] for p in ((a, b), (b, a))}
    assert {(a, b) for a, b in whole if a < b} == pairs and all(min(m) == k for k, m in group.items())
    got = {r["doc_id"]: r["shared_chars"] for r in s.shares().collect()}
    assert got == {i: cover.get(i, 0) for i, *_ in rows}


def test_test_data(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    s = SharedSpans(docs)
    pairs, cover = brute([(r["doc_id"], r["text"]) for r in docs.collect()], 160)
    assert {tuple(r) for r in s.pairs().collect()} == pairs
    assert all(r["shared_chars"] == cover.get(r["doc_id"], 0) for r in s.shares().collect())


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([], S)
    s = SharedSpans(df)
    assert s.pairs().count() == 0 and s.shares().count() == 0
    t = "abc " * 100
    s = SharedSpans(spark.createDataFrame([(1, t, 0, 0, 0), (1, t, 0, 0, 0), (2, "x" + t, 0, 0, 0), (None, t, 0, 0, 0)], S))
    assert [tuple(r) for r in s.pairs().collect()] == [(1, 2)]


@pytest.mark.parametrize("seed", range(10))
def test_equal_stretches_share_an_anchor(seed):
    r = random.Random(seed)
    core = "".join(r.choice("ab") for _ in range(40))
    a = "".join(r.choice("abc") for _ in range(30)) + core + "x" * r.randint(0, 20)
    b = "".join(r.choice("abc") for _ in range(7)) + core
    h, t, p = anchors([a, b], 40, 11)
    own = [{(int(x), int(y)) for x, z, y in zip(h, t, p, strict=True) if z == k} for k in (0, 1)]
    start = (a.index(core), b.index(core))
    inside = [{(x, y - start[k]) for x, y in own[k] if start[k] <= y <= start[k] + 29} for k in (0, 1)]
    assert inside[0] & inside[1]


def test_common():
    assert [common("abc", "abd"), common("", "a"), common("abc", "abc"), common("xbc", "abc"), common("ab", "abc")] == [2, 0, 3, 0, 2]
