import random
from collections import Counter

import numpy as np
import pytest

from timelore.llm import common, near_dup
from tests.llm.conftest import words


def brute(rows):
    grams, parent, key = {}, {}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, text in rows:
        parent[i] = i
        if text is None:
            continue
        w = near_dup.WORD.findall(text.lower())
        k = " ".join(w) if w else "raw" + text
        if k in key:
            parent[i] = key[k]
            continue
        key[k] = i
        if w:
            grams[i] = Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)))
    ids = list(grams)
    for a in range(len(ids)):
        for b in range(a):
            x, y = grams[ids[a]], grams[ids[b]]
            shared = sum((x & y).values())
            if shared >= 0.8 * (x.total() + y.total() - shared):
                p, q = find(ids[a]), find(ids[b])
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in rows}


def edited(text, rng, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
    return " ".join(w)


@pytest.mark.parametrize("few", [common.FEW_ROWS, 0])
def test_classes_equal_brute_force(spark, monkeypatch, few):
    """With small tables sent to every executor, and with merge joins alone. A star of near copies whose leaves are mostly unlike each other, chains, copies, short and empty texts."""
    monkeypatch.setattr(common, "FEW_ROWS", few)
    rng = random.Random(4)
    base = words(1, 150)
    rows = [(i, edited(base, rng, 3)) for i in range(60)] + [(60, base)]
    rows += [(100 + i, words(200 + i, 80)) for i in range(20)] + [(130, words(201, 80).upper()), (131, words(202, 80) + " x")]
    chain = words(5, 100)
    for i in range(6):
        chain = edited(chain, rng, 2)
        rows.append((200 + i, chain))
    rows += [(300, ""), (301, ""), (302, "!!"), (303, None), (304, None), (305, "two words"), (306, "Two, words!"), (307, "the " * 300), (308, "the " * 310)]
    rng.shuffle(rows)
    got = dict(map(tuple, near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute(sorted(rows, key=lambda r: r[0]))


def test_signature_agreement_estimates_weighted_similarity():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    x, y = rng.integers(1, 6, 400).astype(float), rng.integers(1, 6, 400).astype(float)
    keep = rng.random(400) < 0.9
    want = np.minimum(x, y)[keep].sum() / (x.sum() + y[keep].sum() - np.minimum(x, y)[keep].sum())
    k = 2000
    names = near_dup.dart_signatures(np.concatenate([base, base[keep]]), np.concatenate([x, y[keep]]), np.repeat([0, 1], [400, keep.sum()]), 2, k)
    assert abs((names[0] == names[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / k)


def test_signature_does_not_depend_on_the_batch():
    a, b = words(1, 50).split(), words(2, 700).split()

    def sign(lists):
        return near_dup.dart_signatures(*near_dup.shingle_weights(lists), len(lists))

    assert (sign([a, b])[0] == sign([a])[0]).all() and (sign([[], b])[1] == sign([b])[0]).all()


def test_outsiders_of_a_bucket_meet_each_other(spark):
    """Two groups that share a bucket are linked through members that aren't leaders."""
    import pyarrow as pa

    rng = random.Random(8)
    one = words(21, 100)
    texts = [one, edited(one, rng, 2), words(22, 100)]
    h, w, o = near_dup.shingle_weights([t.split() for t in texts])
    bands = near_dup.band_hashes(near_dup.dart_signatures(h, w, o, 3)).view(np.int64)
    shared = int(np.flatnonzero(bands[0] == bands[1])[0])
    cut = np.searchsorted(o, np.arange(4))
    elements = [near_dup.elements_of(h[a:b], w[a:b]) for a, b in zip(cut, cut[1:])]
    table = pa.table({
        "bucket": pa.array([int(bands[0][shared])] * 3), "chunk": pa.array([0] * 3, pa.int32()), "block": pa.array([0] * 3, pa.int32()), "rep": pa.array([1, 2, 3]), "class": pa.array([1, 2, 3]),
        "bins": [np.bincount(e % np.uint64(near_dup.BINS), minlength=near_dup.BINS).astype("<u4").tobytes() for e in elements],
        "bands": pa.array([list(b) for b in bands], pa.list_(pa.int64())), "elements": [e.astype("<u8").tobytes() for e in elements],
    })
    got = near_dup._outside_group(table.slice(1, 1), table).to_pylist()
    first = next(i for i in range(near_dup.BANDS) if bands[0][i] == bands[1][i])
    assert got == ([{"a": 2, "b": 1}] if first == shared else [])


def test_bound_is_never_below_what_is_shared():
    rng = np.random.default_rng(3)
    for n in (1, 20, 400, 5_000):
        a, b = rng.integers(0, 2**63, n, dtype=np.uint64), rng.integers(0, 2**63, n, dtype=np.uint64)
        b[: n // 2] = a[: n // 2]
        one, two = near_dup.elements_of(np.sort(a), rng.integers(1, 4, n)), near_dup.elements_of(np.sort(b), rng.integers(1, 4, n))
        bins = [np.bincount(x % np.uint64(near_dup.BINS), minlength=near_dup.BINS) for x in (one, two)]
        assert near_dup.most_shared(bins[0], bins[1][None])[0] >= len(np.intersect1d(one, two))


def test_links_through_any_text_of_an_id(spark):
    """Whichever of its two texts has the link, 5 and 6 are one document's class; equal rows are kept once."""
    rng = random.Random(3)
    one, two = words(31, 90), words(32, 90)
    for near in (one, two):
        docs = spark.createDataFrame([(5, one), (5, two), (6, edited(near, rng, 1)), (7, words(33, 90)), (7, words(33, 90)), (None, words(33, 90)), (None, words(34, 90))], "doc_id long, text string")
        got = [tuple(r) for r in near_dup.classes(docs).collect()]
        assert sorted((x for x in got if x[0]), key=str) == [(5, 5), (5, 5), (6, 5), (7, 7), (7, 7)] and sorted((x[1] for x in got if x[0] is None), key=str) == [7, None]
        assert sorted((r.doc_id or 0) for r in near_dup.one_of_each(docs).collect()) == [0, 5, 7]


def test_hard_documents(hard_docs, no_docs):
    rows = near_dup.classes(hard_docs).collect()
    assert len(rows) == hard_docs.count()
    got = {r.doc_id: r.class_id for r in rows if r.doc_id is not None}
    assert got[1] == got[2] == got[12] and got[7] == 7 and got[4] == 4 and len({got[i] for i in (3, 6, 8, 9, 10, 11)}) == 6
    kept = near_dup.one_of_each(hard_docs)
    assert kept.columns == hard_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 4, 5, 6, 7, 8, 9, 10, 11]
    assert near_dup.classes(no_docs).collect() == [] and near_dup.one_of_each(no_docs).collect() == []
