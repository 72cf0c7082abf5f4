"""Steps that have to grow no faster than their input: what is moved, and work for whole batches instead of single rows."""

import numpy as np
import pyarrow as pa

from timelore.operators import details, library, search, textindex, timeline


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_of_whole_rows_are_not_moved(spark):
    evidence = spark.createDataFrame([(i, "banana aaaa bandana " + "xyz" * (i % 5)) for i in range(60)], "evidence_seq long, text string").coalesce(2)
    asked = spark.createDataFrame([(0, "ana"), (100, "ANA"), (200, "aaa"), (300, "zxyz"), (400, "an"), (500, "nowhere")], "query_id long, query string")
    count = lambda text, term: sum(text.startswith(term, i) for i in range(len(text)))
    want = {(q, r.evidence_seq, n) for r in evidence.collect() for q, term in asked.collect() if len(term) > 2 and (n := count(r.text, term.lower()))}
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # a row's lists come in several batches
    try:
        found = search.indexed_matches(search.postings(evidence), asked, by_row=True)
        got = [tuple(r) for r in found.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(got) == len(want) and set(got) == want
    assert "Exchange hashpartitioning" not in plan(found) and "Generate" not in plan(found)
    assert {tuple(r) for r in search.indexed_matches(search.postings(evidence).repartition(5, "gram"), asked).collect()} == want
    assert search.indexed_matches(search.postings(evidence), asked.filter("query_id = 400"), by_row=True).count() == 0


def test_postings_are_made_for_slices_of_rows(spark):
    texts = ["", "ab", "Abcabc", "aaaa", "ÄÖÜ 東京タワー 😀😀😀"] + [f"row {i} " * (i % 7) for i in range(40)]
    batch = pa.RecordBatch.from_pydict({"evidence_seq": list(range(len(texts))), "text": texts})
    slices = list(search.text_slices(iter([batch])))
    assert len(slices) == 1 and slices[0][1] == texts
    evidence = spark.createDataFrame(list(enumerate(texts)), "evidence_seq long, text string").coalesce(1)
    want = {}
    for i, text in enumerate(texts):
        for p in range(len(text) - 2):
            want.setdefault((text[p : p + 3].lower(), i), []).append(p)
    rows = search.postings(evidence).collect()
    assert len(rows) == len(want) and {(r.gram, r.evidence_seq): r.positions for r in rows} == want


def test_ocr_is_merged_without_a_group_for_each_stretch(spark):
    schema = "segment_id long, time_ms long, seq long, text string, norm string, confidence double, x double, y double, w double, h double"
    rows = [(s, t * 1_000 + (t // 4) * 5_000, t, f"T{t}", "t" if t % 2 else "u", 0.1 * (t % 9), 0.0 if t % 3 else 5.0, 0.0, 1.0, 1.0) for s in (1, 2) for t in range(40)]
    raw = spark.createDataFrame(rows, schema)
    want = []
    for s in (1, 2):
        seen = []  # as the rule says it, over all observations
        for r in (r for r in rows if r[0] == s):
            fits = [o for o in seen if o["norm"] == r[4] and o["x"] == r[6] and r[1] - o["end"] <= 1_500]
            o = fits[-1] if fits else {"norm": r[4], "text": r[3], "x": r[6], "start": r[1], "confidence": r[5]}
            if not fits:
                seen.append(o)
            o["end"], o["confidence"] = r[1] + 1_000, max(o["confidence"], r[5])
        want += [(s, o["text"], o["confidence"], o["x"], o["start"], o["end"]) for o in seen]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)  # observations go on in the next batch
    try:
        merged = timeline.merge_ocr(raw)
        got = [(r.segment_id, r.text, r.confidence, r.x, r.start_ms, r.end_ms) for r in merged.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert sorted(got) == sorted(want)
    assert "FlatMapGroupsInArrow" not in plan(merged) and "Window" not in plan(merged)


def test_grams_are_ordered_by_their_characters():
    for texts in (["banana", "", "ab", "bandana"], ["日本語の本", "a日本", "😀😀😀é"], [chr(0x4E00 + i) * 3 + chr(i + 33) for i in range(400)]):
        points, text = textindex._points(texts)
        for size in (1, 2, 3):
            inside = text[: len(points) - size + 1] == text[size - 1 :]
            key = sum(points[t : t + len(inside)] << 21 * (size - 1 - t) for t in range(size))[inside]
            assert textindex._by_characters(points, inside, size).tolist() == np.argsort(key, kind="stable").tolist()


def test_dashboard_works_out_eligible_jobs_once(spark, monkeypatch):
    calls = []
    whole = library.eligible_jobs
    monkeypatch.setattr(library, "eligible_jobs", lambda *a: calls.append(1) or whole(*a))
    jobs = spark.createDataFrame(
        [("a", 1, "s1", 1, "index_segment", "failed", 5.0, None), ("b", 1, "s2", 2, "describe_segment", "succeeded", 6.0, None), ("c", 2, "s3", 1, "index_segment", "failed", 7.0, "m"), ("d", 2, None, 0, "segment_asset", "running", 8.0, None)],
        "job_id string, asset_id long, segment_id string, ordinal long, kind string, status string, updated_at double, message string",
    )
    segments = spark.createDataFrame([("s1", 1, 1, True, "r"), ("s2", 1, 2, True, "r"), ("s3", 2, 1, False, "old")], "segment_id string, asset_id long, ordinal long, is_active boolean, run_id string")
    assets = spark.createDataFrame([(1, "x/one.mp4", "ready", None, False), (2, "two.mp4", "missing", 1.0, False)], "asset_id long, relative_path string, status string, invalidated_at double, is_excluded boolean")
    runs = spark.createDataFrame([("r", "succeeded"), ("old", "running")], "run_id string, status string")
    parts = details.job_dashboard(assets, segments, jobs, runs, jobs)
    assert [(r.job_id, r.name, r.message) for r in parts["failures"].collect()] == [("c", "two.mp4", "m"), ("a", "one.mp4", library.UNKNOWN_ERROR)]
    assert sorted((r.kind, r.succeeded, r.failed, r.total) for r in parts["progress"].collect()) == [("describe_segment", 1, 0, 1), ("index_segment", 0, 1, 1)]
    assert len(calls) == 1
