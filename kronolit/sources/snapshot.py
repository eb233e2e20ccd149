"""Pinned files and cached answers: what has been fetched once is kept with its hash and read from there. The call over the network is
handed in, so that everything else works without one."""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass
from pathlib import Path


class HashMismatch(ValueError):
    """A kept file is not the one that was fetched."""


@dataclass(frozen=True)
class Snapshot:
    """What is known of a pinned file: its version, where it came from, its size and SHA-256 before compression."""

    version: str
    url: str
    n_bytes: int
    sha256: str


def http_get(url: str, accept: str = "*/*", agent: str = "kronolit", timeout: float = 180) -> bytes:
    request = urllib.request.Request(url, headers={"Accept": accept, "User-Agent": agent})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return answer.read()


def export_url(base: str, fields: Mapping[str, str]) -> str:
    """``base`` with its query, in the order given, empty fields included."""
    return f"{base}?{urllib.parse.urlencode(dict(fields))}"


def user_agent(name: str, contact: str | None = None) -> str:
    return " ".join(x for x in (name.strip(), (contact or "").strip()) if x)


def pin(folder: str | Path, version: str, url: str, get: Callable[[str], bytes] = http_get) -> Snapshot:
    """Fetch a version of a file unless it is kept already, and keep it compressed beside a manifest, which is written last."""
    home = Path(folder) / version
    manifest = home / "manifest.json"
    if manifest.exists():
        return Snapshot(**json.loads(manifest.read_text()))
    data = get(url)
    s = Snapshot(version, url, len(data), hashlib.sha256(data).hexdigest())
    home.mkdir(parents=True, exist_ok=True)
    (home / "data.gz").write_bytes(gzip.compress(data, mtime=0))
    manifest.write_text(json.dumps(asdict(s), indent=1))
    return s


def load_pinned(folder: str | Path, version: str, sha256: str | None = None) -> tuple[bytes, Snapshot]:
    """A pinned file and its manifest. Its hash has to be the manifest's, and ``sha256`` if a setting names one."""
    home = Path(folder) / version
    s = Snapshot(**json.loads((home / "manifest.json").read_text()))
    data = gzip.decompress((home / "data.gz").read_bytes())
    found = hashlib.sha256(data).hexdigest()
    if found != s.sha256 or sha256 not in (None, found):
        raise HashMismatch(f"{version}: {found}, expected {sha256 or s.sha256}")
    return data, s


def upsert_meta(path: str | Path, key: str, value: object) -> dict:
    """A JSON file of settings with ``key`` set to ``value``; the file is replaced as a whole."""
    p = Path(path)
    all_ = json.loads(p.read_text()) if p.exists() else {}
    all_[key] = value
    new = p.with_suffix(".new")
    new.write_text(json.dumps(all_, indent=1, ensure_ascii=False))
    new.replace(p)
    return all_


class AnswerCache:
    """Answers by kind and key as text files. ``fetch(kind, key)`` gives text or None; that there is no answer is kept too, by an empty
    file of its own. Calls over the network are at least ``pause`` seconds apart; one that fails is not kept."""

    def __init__(self, folder: str | Path, fetch: Callable[[str, str], str | None], pause: float = 0.5) -> None:
        self.folder, self.fetch, self.pause, self.last = Path(folder), fetch, pause, float("-inf")

    def path(self, kind: str, key: str) -> Path:
        """Keys differ in their file names even where a character is no letter of one."""
        return self.folder / kind / (re.sub(r"[^A-Za-z0-9._=^-]", lambda m: f"%{ord(m[0]):x}", key) + ".csv")

    def get(self, kind: str, key: str) -> str | None:
        p = self.path(kind, key)
        none = p.with_suffix(".empty")
        if p.exists():
            return p.read_text()
        if none.exists():
            return None
        time.sleep(max(0.0, self.last + self.pause - time.monotonic()))
        try:
            text = self.fetch(kind, key)
        finally:
            self.last = time.monotonic()
        p.parent.mkdir(parents=True, exist_ok=True)
        if text:
            p.write_text(text)
        else:
            none.touch()
        return text or None
