import os
import random

import numpy as np
import pytest

from kronolit.llm.packing import K1, B, Shard, pack_block, pack_documents
from kronolit.llm.tokens import encode_documents, tokenizer_path

needs_files = pytest.mark.skipif(not os.path.exists(tokenizer_path()), reason="no tokenizer files")


@pytest.mark.parametrize("seed", range(5))
def test_block(seed):
    r = random.Random(seed)
    n = 400
    size = np.array([r.choice([0, 1, 5, r.randint(1, 100)]) for _ in range(n)])
    terms = [np.unique([r.randrange(50) for _ in range(r.randint(0, 8))]).astype(np.int64) for _ in range(n)]
    boxes = pack_block(size, terms, [np.ones(len(t), dtype=np.int64) for t in terms], np.ones(50), 4.0, 100)
    assert sorted(i for b in boxes for i in b) == list(range(n))
    fill = [int(size[b].sum()) for b in boxes]
    assert max(fill) <= 100
    assert len(boxes) <= -(-int(size.sum()) // 100) + 3


def test_neighbours_share_a_container():
    """Two subjects of equal sizes: containers hold one subject each."""
    size = np.full(40, 25)
    terms = [np.array([i % 2 * 10 + k for k in range(3)]) for i in range(40)]
    boxes = pack_block(size, terms, [np.ones(3, dtype=np.int64)] * 40, np.ones(20), 3.0, 100)
    assert len(boxes) == 10 and all(len({i % 2 for i in b}) == 1 for b in boxes)


@pytest.mark.parametrize("seed", range(3))
def test_scores_are_bm25(seed):
    r = random.Random(seed)
    bags = [[r.randrange(30) for _ in range(r.randint(0, 40))] for _ in range(60)]
    terms, often = zip(*(np.unique(np.array(b, dtype=np.int64), return_counts=True) for b in bags), strict=True)
    idf, mean = np.array([r.random() for _ in range(30)]), 17.0
    shard, unused = Shard(list(terms), list(often), idf, mean), np.array([r.random() < 0.7 for _ in bags])
    for drop in (False, True):
        if drop:
            shard.drop(unused)
        for q in range(0, 60, 7):
            want = [sum(idf[t] * b.count(t) * (K1 + 1) / (b.count(t) + K1 * (1 - B + B * len(b) / mean)) for t in set(bags[q]) if t in b) * (not drop or unused[i]) for i, b in enumerate(bags)]
            assert shard.scores(q) == pytest.approx(want)


def test_empty_block():
    assert pack_block(np.zeros(0, dtype=np.int64), [], [], np.ones(4), 0.0, 100) == []


def check(spark, docs, capacity, **kw):
    size = {}
    for r in encode_documents(docs).collect():
        size.setdefault(r["doc_id"], []).append(len(r["ids"]))
    rows = [r.asDict() for r in pack_documents(docs, capacity, **kw).collect()]
    box, whole = {}, {}
    for r in rows:
        box.setdefault(r["container_id"], []).append((r["offset"], r["tokens"]))
        whole.setdefault(r["doc_id"], []).append((r["part"], r["tokens"]))
    for items in box.values():
        at = 0
        for o, t in sorted(items):
            assert o == at
            at += t
        assert at <= capacity
    assert {d: sum(t for _, t in p) for d, p in whole.items()} == {d: sum(s) for d, s in size.items()}
    for d, s in size.items():
        if len(s) == 1:
            assert len(whole[d]) == max(1, -(-s[0] // capacity))
            assert [p for p, _ in sorted(whole[d])] == list(range(len(whole[d])))
    total = sum(sum(s) for s in size.values())
    return len(box), -(-total // capacity)


@needs_files
def test_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    used, least = check(spark, docs, 1024)
    assert used <= least * 1.1 + 2
    used, least = check(spark, docs, 64, block=32)
    assert used <= least * 1.1 + 8


@needs_files
def test_edges(spark):
    rows = [(1, None, "k"), (2, "", "k"), (3, "ord " * 900, None), (4, "ord", "k"), (4, "ord", "k"), (5, " ", "k"), (6, "a" * 20_000, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, issuer_key string")
    check(spark, df, 50)
    check(spark, df.drop("issuer_key"), 50)
    assert pack_documents(df.where("doc_id > 9")).count() == 0
