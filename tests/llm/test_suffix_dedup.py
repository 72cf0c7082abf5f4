import hashlib
import os
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from timelore.llm import suffix_dedup
from tests.llm.conftest import words


@given(st.lists(st.binary(min_size=0, max_size=12).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=7), st.integers(1, 6))
@settings(max_examples=150, deadline=None)
def test_construction_equals_sorted_suffixes(pieces, cap):
    transform, common, piece, length = suffix_dedup.collection_bwt(pieces, cap)
    suffixes = sorted(((p[len(p) - k :], i, k) for i, p in enumerate(pieces) for k in range(len(p) + 1)), key=lambda x: x[:2])
    assert [(i, k) for _, i, k in suffixes] == list(zip(piece.tolist(), length.tolist()))
    assert transform.tolist() == [0 if k == len(pieces[i]) else 1 + pieces[i][len(pieces[i]) - k - 1] for _, i, k in suffixes]
    for r in range(1, len(suffixes)):
        assert common[r] == min(cap, len(os.path.commonprefix([suffixes[r - 1][0], suffixes[r][0]])))


def brute(rows):
    """doc -> figures; rows in order."""
    seen, out = set(), []
    for doc, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(data[s : s + 100])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc, len(data), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, suffix_dedup.dedup(docs, **options).collect()), key=lambda r: (r[0] is not None, r[0], r[1:]))
    assert got == sorted(brute(rows), key=lambda r: (r[0] is not None, r[0], r[1:]))


def test_random_documents_with_shared_passages(spark):
    rng = random.Random(1)
    passages = [words(i, 40) for i in range(4)] + ["ab" * 150, "x" * 260]
    rows = []
    for i in range(40):
        parts = [words(100 + i, 30)] + [rng.choice(passages)[rng.randint(0, 20) :] for _ in range(3)]
        rng.shuffle(parts)
        rows.append((i, " ".join(parts)))
    rows += [(50, rows[3][1]), (51, rows[3][1] + "!"), (52, None), (53, ""), (54, "é" * 120), (55, "é" * 49 + "日本語" * 60)]
    check(spark, rows)


def test_hot_fingerprint_is_split(spark):
    """A common core with other neighbours in each document: its pieces go to several blocks."""
    core = words(7, 14)[:90]
    rng = random.Random(2)
    check(spark, [(i, f"{rng.randint(0, 2)}" * 25 + core + f"{rng.randint(0, 2)}" * 28) for i in range(14)], group_pieces=3)


def test_hot_fingerprint_over_many_batches(spark):
    """The rows of a fingerprint come in batches of three; what is handed on early and late agrees."""
    core = words(7, 14)[:90]
    rng = random.Random(4)
    rows = [(i, f"{rng.randint(0, 4)}" * 25 + core + f"{rng.randint(0, 4)}" * 28) for i in range(40)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        check(spark, rows, group_pieces=2)
        check(spark, rows, group_pieces=7)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_split_groups_agree(spark):
    """Strings of a fingerprint that several blocks share are settled by the aggregation over blocks."""
    text = words(3, 60).encode()
    rows = [(5, salt, True, d, 0, text[:140]) for d, salt in ((1, 0), (2, 1), (3, 1))] + [(5, 0, True, 4, 0, text[10:150])]
    pieces = spark.createDataFrame(rows, "mark long, salt int, shared boolean, doc long, start long, bytes binary")
    built = suffix_dedup.constructed(pieces, 3).collect()
    gone = {(r.doc, r.start + i) for r in built if r.gone for i in range(r["count"])}
    open_ = [(r.string, (r.doc, r.start)) for r in built if not r.gone]
    least = {}
    for s, at in open_:
        least[s] = min(least.get(s, at), at)
    gone |= {at for s, at in open_ if at > least[s]}
    assert gone == {(d, s) for d in (2, 3) for s in range(41)} | {(4, s) for s in range(31)}


def test_long_text_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 500)
    data = words(9, 300).encode()
    data = data[:900] + data[100:600]
    parts = list(suffix_dedup.text_parts([data]))
    starts = sorted((n, o + s + k) for chunk, stops, number, offset in parts for m, c, c2, s0, cnt, sv in [suffix_dedup.cut_pieces(chunk, stops)] for s, t in zip(s0, cnt) for k in range(t) for n, o in [(number[np.searchsorted(stops, s, side="right")], offset[np.searchsorted(stops, s, side="right")] - np.concatenate([[0], stops[:-1]])[np.searchsorted(stops, s, side="right")])])
    assert starts == [(0, i) for i in range(len(data) - 99)]


def test_hard_documents(spark, hard_docs, no_docs):
    from pyspark.sql import functions as F

    ordered = hard_docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")).cast("binary"))).collect()
    ordered.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    want = brute([(r.doc_id, r.text) for r in ordered])
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(map(tuple, suffix_dedup.dedup(hard_docs).collect()), key=key) == sorted(want, key=key)
    assert suffix_dedup.dedup(no_docs).collect() == []
