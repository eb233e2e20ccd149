import gzip

import pytest

from kronolit.sources.snapshot import AnswerCache, HashMismatch, export_url, load_pinned, pin, upsert_meta, user_agent


def test_pin(tmp_path):
    asked = []

    def get(url):
        asked.append(url)
        return b"a;b\n" * 10

    s = pin(tmp_path, "abc", "u://x", get)
    assert s.n_bytes == 40 and pin(tmp_path, "abc", "u://x", get) == s and asked == ["u://x"]
    assert load_pinned(tmp_path, "abc", s.sha256) == (b"a;b\n" * 10, s)
    with pytest.raises(HashMismatch):
        load_pinned(tmp_path, "abc", "0" * 64)
    (tmp_path / "abc" / "data.gz").write_bytes(gzip.compress(b"other"))
    with pytest.raises(HashMismatch):
        load_pinned(tmp_path, "abc")
    with pytest.raises(FileNotFoundError):
        load_pinned(tmp_path, "missing")


def test_urls():
    assert export_url("u://x", {"Från": "2024-01-02", "tom": "", "b": "a b"}) == "u://x?Fr%C3%A5n=2024-01-02&tom=&b=a+b"
    assert user_agent("tool ", None) == "tool" and user_agent("tool", " me@x ") == "tool me@x"


def test_answers(tmp_path):
    asked = []

    def fetch(kind, key):
        asked.append((kind, key))
        if key == "bad":
            raise OSError("no net")
        return None if key == "none" else f"{kind} {key}"

    c = AnswerCache(tmp_path, fetch, pause=0.0)
    assert [c.get("h", k) for k in ("A/B", "A_B", "none", "A/B", "none")] == ["h A/B", "h A_B", None, "h A/B", None]
    assert asked == [("h", "A/B"), ("h", "A_B"), ("h", "none")]
    for _ in range(2):
        with pytest.raises(OSError):
            c.get("h", "bad")
    assert len(asked) == 5


def test_meta(tmp_path):
    p = tmp_path / "meta.json"
    upsert_meta(p, "a", 1)
    assert upsert_meta(p, "b", [2]) == {"a": 1, "b": [2]} and upsert_meta(p, "a", "å") == {"a": "å", "b": [2]}
