import base64
import os
import random

import pytest

from kronolit.llm.tokens import BatchEncoder, Merges, blocks, encode_documents, encode_pretokens, tokenizer_path

PATH = tokenizer_path()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    from kronolit.llm.tokens import PATTERN

    with open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_against_other_implementation(reference):
    enc, r = BatchEncoder(Merges(PATH)), random.Random(1)
    texts = ["".join(r.choice("aab  é🙂́ß漢1'stre\n\t") for _ in range(r.randint(0, 80))) for _ in range(1500)]
    texts += ["a" * 5000, " " * 3000, "\n" * 777, "ab" * 4000, "<|endoftext|>", "it's we'll I'd", "12345678 34 557 373,10"]
    ids, at = enc.encode(texts)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == reference(t), t


def test_bank_of_pretokens_forgets(reference):
    """Batch by batch with a bank that is full at once: the same ids."""
    enc, r = BatchEncoder(Merges(PATH), limit=40), random.Random(2)
    for _ in range(30):
        texts = ["".join(r.choice("abc  é1") for _ in range(r.randint(0, 30))) for _ in range(5)] + [None, ""]
        ids, at = enc.encode(texts)
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(7)] == [reference(t) if t else [] for t in texts]
    assert enc.held < 5000


def test_one_very_long_pretoken(reference):
    ids, at = encode_pretokens([b"abcab" * 60_000, b"", b"x"], Merges(PATH))
    assert at.tolist()[1] == at.tolist()[2] and at.tolist()[3] == len(ids)
    assert ids[: at[1]].tolist() == reference("abcab" * 60_000)


def test_table(spark, reference):
    rows = [(1, "Hej på dig", 5), (2, None, 5), (3, "", 5), (4, "   ", 5), (5, "x " * 50_000, 5), (1, "Hej på dig", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted((r["doc_id"], list(r["ids"])) for r in encode_documents(df).collect())
    assert got == sorted((i, reference(t) if t else []) for i, t, _ in rows)
    assert encode_documents(df.where("doc_id > 9")).count() == 0


def test_ids_decode_to_the_text(spark, data, reference):
    """Exact round trip of the whole corpus of the test data."""
    import json

    with open(PATH, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    spelled = {i: bytes(back[c] for c in w) for w, i in vocab.items() if all(c in back for c in w)}
    docs = spark.read.parquet(f"{data}/documents.parquet")
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in encode_documents(docs).collect():
        assert b"".join(spelled[i] for i in r["ids"]).decode() == text[r["doc_id"]]


def test_blocks_cover_everything():
    texts = ["x" * n for n in (5, 0, 3, 100, 2)] + [None]
    assert list(blocks(texts, 8)) == [(0, 3), (3, 4), (4, 6)]
    assert list(blocks([], 8)) == []
