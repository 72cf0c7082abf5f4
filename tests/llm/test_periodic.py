"""Periodic runs against a brute-force search over all starts and periods."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from timelore.llm import periodic
from timelore.llm.queries import QUERIES


def brute_runs(words: list) -> list[tuple[int, int, int]]:
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            stretch = words[i : i + length]
            if length >= max(6, 4 * q) and not any(stretch[d:] == stretch[:-d] for d in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id: int | None, text: str | None) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and words and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    best = (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(kept))


@pytest.mark.parametrize("symbols", [1, 2, 3, 5])
def test_runs_of_random_words(symbols):
    draw = random.Random(symbols)
    for _ in range(150):
        docs = []
        for _ in range(draw.randint(1, 6)):
            words: list[int] = []
            while len(words) < draw.randint(0, 80):
                part = [draw.randrange(symbols) for _ in range(draw.randint(1, 7))]
                words += part * draw.choice([1, 1, 2, 4, 6])
            docs.append(words)
        assert periodic.runs_of([np.array(x, np.int32) for x in docs]) == [brute_runs(x) for x in docs]


def test_a_long_run_and_a_long_period():
    one = np.zeros(200_000, np.int32)
    far = np.resize(np.random.default_rng(1).integers(0, 1 << 30, 40_000, dtype=np.int32), 170_001)
    assert periodic.runs_of([one, far]) == [[(0, 200_000, 1)], [(0, 170_001, 40_000)]]


def test_words_in_parts(monkeypatch):
    text = ("één  twee\tdrie\n" * 50).encode()
    spelled = lambda known: [list(known)[i] for i in periodic.word_numbers(text, known)]
    for size in (1, 7, 64):
        monkeypatch.setattr(periodic, "CHUNK_BYTES", size)
        assert spelled({}) == ["één".encode(), b"twee", b"drie"] * 50


def test_rows_of_odd_tables(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a " * 7), (4, "a " * 7), (5, "x b c d b c d b c d b c d b y"), (None, "p q " * 9), (6, "a a " * 6 + "end"), (7, "w " * 5)]
    rows += [(i, " ".join(f"w{j % (i + 3)}" for j in range(40))) for i in range(10, 60)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, runs string, collapsed string")
    got = sorted(map(tuple, periodic.digest(periodic.detect(docs, periodic.periodic_tail)).collect()), key=repr)
    assert got == sorted((brute_row(*r) for r in rows), key=repr)
    assert periodic.digest(periodic.detect(docs.limit(0))).count() == 0


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    some = [r for r in docs if len(r.text or "") < 6_000]
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for r in some:
        assert got[r.doc_id] == brute_row(r.doc_id, r.text)
