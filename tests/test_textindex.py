"""The stored index against plain scans, before and after changes; vectors on the grid against a full scan."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from timelore.operators import search, textindex, vectorgrid
from timelore.sources import shared

EVIDENCE = "evidence_seq long, segment_id long, evidence_type string, text string, start_ms long, end_ms long"
TERMS = ["station", "STA", "ta", "é", "Éta", "aaaa", "aa", "a", "the ", "zz top", "nothing at all", "İs", "\\Q.", "😀a", "ab\\Eab", "tat", "tatta"]


def text(rng):
    parts = ["station", "tatta", "aaaaa", "Éta", "the", "zz top", "İstanbul", "\\Q.\\E", "😀a", "ab\\Eab\\Eab", "ß", "x"]
    return " ".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 5, 30])))


def rows(seed, n, start=0):
    rng = random.Random(seed)
    return [(start + i, (start + i) % 97, rng.choice(search.KINDS), None if rng.random() < 0.02 else text(rng), i, i + 5) for i in range(n)]


def answers(spark, evidence, visible, asked, most, index=None):
    found = index.candidates(evidence, visible, asked, most) if index is not None else search.literal_top(search.bm25(search.literal_matches(evidence, asked), evidence, asked).join(visible, "evidence_seq", "left_semi"), 1)
    keep = found.filter(F.col("pos") <= most).select("query_id", "evidence_seq", F.col("f").cast("long"), F.round("rank", 9), "pos", "chars", "segment_id")
    return sorted(map(tuple, keep.collect()))


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TERMS + TERMS[:4])], "query_id long, query string")


def test_index_answers_as_a_scan(spark, asked, tmp_path):
    evidence = spark.createDataFrame(rows(1, 3_000), EVIDENCE)
    visible = evidence.filter("evidence_seq % 5 <> 1").select("evidence_seq")
    index = textindex.create(evidence.repartition(3), f"file://{tmp_path}/i")
    trimmed = search.cleaned_rows(asked)
    scanned = answers(spark, evidence, visible, trimmed, 40)
    assert answers(spark, evidence, visible, trimmed, 40, index) == scanned
    assert answers(spark, evidence, visible, trimmed, 3, index) == [r for r in scanned if r[4] <= 3]
    assert answers(spark, evidence, visible, trimmed.limit(0), 3, index) == []
    nothing = textindex.create(evidence.limit(0), f"file://{tmp_path}/none")
    assert answers(spark, evidence.limit(0), visible, trimmed, 3, nothing) == []


def test_index_keeps_up_with_changes(spark, asked, tmp_path):
    path = f"file://{tmp_path}/i"
    now = {r[0]: r for r in rows(2, 1_500)}
    index = textindex.create(spark.createDataFrame(list(now.values()), EVIDENCE), path)
    rng, seen, parts = random.Random(3), None, []
    for turn in range(6):
        change = rng.sample(sorted(now), 40)
        fresh = rows(10 + turn, 30, 10_000 * (turn + 1))
        old = [now[i] for i in change]
        new = [(*now[i][:3], text(rng), *now[i][4:]) for i in change[:25]] + fresh
        before = {f: os.stat(f).st_mtime_ns for d, _, names in os.walk(tmp_path / "i" / "parts") for f in (os.path.join(d, x) for x in names)}
        index = index.apply(spark.createDataFrame(new, EVIDENCE), spark.createDataFrame(old, EVIDENCE))
        assert all(os.stat(f).st_mtime_ns == t for f, t in before.items()), "a written file was changed"
        for i in change:
            del now[i]
        now.update({r[0]: r for r in new})
        seen = index.version
        parts.append(len(index.parts))
    assert parts == [2, 3, 1, 2, 3, 1] and textindex.TextIndex(spark, path).version == seen
    evidence = spark.createDataFrame(list(now.values()), EVIDENCE)
    whole = textindex.create(evidence, f"file://{tmp_path}/whole")
    assert index.totals == whole.totals
    got = [sorted(map(tuple, x.entries(x.lists(), "short", "gram").collect())) for x in (index, whole)]
    assert got[0] == got[1]
    visible = evidence.select("evidence_seq")
    trimmed = search.cleaned_rows(asked)
    assert answers(spark, evidence, visible, trimmed, 10, index) == answers(spark, evidence, visible, trimmed, 10)
    early = textindex.TextIndex(spark, path, 1)
    assert early.totals[0] == 1_500, "versions are never changed"


def test_an_unfinished_version_is_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    index = textindex.create(spark.createDataFrame(rows(4, 50), EVIDENCE), path)
    os.makedirs(tmp_path / "i" / "manifest" / "00000002")
    assert textindex.TextIndex(spark, path).version == index.version == 1


def test_fallback_rows_stay_searchable(spark, tmp_path):
    """A visual row of a hidden segment is found by its words, and by nothing else."""
    segments = spark.createDataFrame([(1, 7, "a", 0, 9, True), (2, 7, "a", 0, 9, False), (3, 8, "b", 0, 9, False)], "segment_id long, asset_id long, path string, start_ms long, end_ms long, visible boolean")
    evidence = spark.createDataFrame([(1, 1, "ocr", "other words", 0, 1), (2, 2, "visual", "violet umbrella", 0, 1), (3, 2, "ocr", "violet", 0, 1), (4, 3, "visual", "violet", 0, 1)], EVIDENCE)
    vectors = spark.createDataFrame([(i, [1.0, 0.0]) for i in (1, 2, 3)], "segment_id long, vector array<double>")
    ask = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<double>")
    index = textindex.create(evidence, f"file://{tmp_path}/i")
    for options in ({}, {"index": index}):
        none = search.literal_search(evidence, segments, {0: "violet"}, **options).collect()
        one = search.literal_search(evidence, segments, {0: "violet"}, fallback=evidence.filter("evidence_seq = 2"), **options).collect()
        both = search.hybrid_search(evidence, segments, vectors, {0: "violet"}, ask, fallback=evidence.filter("evidence_seq = 2"), **options).collect()
        assert none == [] and [(r.segment_id, r.matched[0].evidence_seq) for r in one] == [(2, 2)]
        assert [(r.segment_id, r.semantic) for r in both] == [(2, None)]


def test_grid_equals_a_full_scan(spark):
    draw = np.random.default_rng(5)
    groups = draw.normal(size=(12, 16))
    v = np.concatenate([groups[draw.integers(0, 12, 3_000)] + 0.02 * draw.normal(size=(3_000, 16)), np.repeat(groups[:1], 700, axis=0)])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    table = [(i, x.tolist()) for i, x in enumerate(v)] + [(9_000, [3.0] * 16), (9_001, [1.0, 2.0]), (9_002, None), (9_003, [])]
    vectors = spark.createDataFrame(table, "id long, vector array<double>")
    asked = spark.createDataFrame([*table[::40], (77_777, [0.5, 0.5])], "id long, vector array<double>")
    want = {}
    for q, x in [*table[::40], (77_777, [0.5, 0.5])]:
        if x:
            pairs = [(-min(1.0, max(-1.0, float((np.array(y) * np.array(x)).sum()))), i) for i, y in table if y and len(y) == len(x)]
            want[q] = [(i, round(-s, 9)) for s, i in sorted(pairs)[:20]]
    for cells in ({}, {"cell_numbers": 16 * 600, "query_numbers": 16 * 30}):
        found = vectorgrid.grid(vectors, asked, 20, **cells)
        assert vectorgrid.skipped_share(found) > 0.3
        rank = vectorgrid.vector_rank(vectors.withColumnRenamed("id", "segment_id"), asked.withColumnRenamed("id", "query_id"), 20, **cells)
        got = {}
        for r in rank.orderBy("query_id", "place").collect():
            got.setdefault(r.query_id, []).append((r.segment_id, round(r.score, 9)))
        scores = lambda x: {q: [s for _, s in p] for q, p in x.items()}
        assert scores(got) == scores(want)
    assert vectorgrid.vector_rank(vectors.withColumnRenamed("id", "segment_id"), asked.limit(0).withColumnRenamed("id", "query_id"), 5).count() == 0


def test_clear_takes_away_what_was_written(spark, tmp_path):
    written = shared.materialise(spark.range(3), "some")
    assert written.count() == 3 and shared.exists(spark, shared.shared_dir(spark) + "/timelore")
