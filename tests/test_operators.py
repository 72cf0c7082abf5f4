"""Golden values and properties of the operators."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timelore.functions import columns as C
from timelore.operators import changes, lineage, library, search, timeline
from timelore.plans.queries import QUERIES
from timelore.plans.views import view
from timelore.sources import ingest, mediafiles


def ends(duration, *boundaries):
    merged = timeline.merge_boundaries([b[0] for b in boundaries], [b[1] for b in boundaries], [b[2] for b in boundaries], duration)
    return [p[1] for p in timeline.plan_cover(duration, merged)]


def test_planner_golden_values():
    cut = [(t * 1000, "shotChange", 1.0) for t in range(1, 30)]
    assert ends(3_500, (1_000, "shotChange", 1.0)) == [3_500]
    assert ends(30_000, *cut) == [11_000, 22_000, 30_000]
    assert ends(62_000) == [30_000, 46_000, 62_000]
    assert ends(30_000, (9_000, "shotChange", 0.9), (24_000, "ocrChange", 0.9)) == [9_000, 24_000, 30_000]
    assert ends(34_000, (10_000, "sentenceEnd", 0.9), (21_000, "pause", 0.9)) == [10_000, 21_000, 34_000]
    assert ends(50_000, (26_000, "shotChange", 0.4), (28_500, "shotChange", 0.95)) == [28_500, 50_000]
    assert ends(35_000, (9_000, "shotChange", float("nan")), (10_000, "shotChange", 0.1), (12_000, "shotChange", -1.0)) == [17_500, 35_000]
    assert timeline.plan_cover(0, []) == []


@given(st.integers(1, 200_000), st.lists(st.tuples(st.integers(-5, 200_000), st.sampled_from(list(timeline.SOURCE_WEIGHTS)), st.floats(-1, 2)), max_size=60), st.randoms())
@settings(max_examples=100, deadline=None)
def test_plans_are_contiguous_bounded_and_free_of_order(duration, boundaries, rng):
    merged = timeline.merge_boundaries(*map(list, zip(*boundaries)), duration) if boundaries else []
    plan = timeline.plan_cover(duration, merged)
    assert [p[0] for p in plan] == [0] + [p[1] for p in plan[:-1]] and plan[-1][1] == duration
    assert all(b - a <= timeline.LONGEST_MS for a, b, _ in plan)
    assert duration < timeline.SHORTEST_MS or all(b - a >= timeline.SHORTEST_MS for a, b, _ in plan)
    mixed = boundaries[:]
    rng.shuffle(mixed)
    assert not boundaries or timeline.merge_boundaries(*map(list, zip(*mixed)), duration) == merged


def test_energy_windows_do_not_depend_on_packets(spark):
    rng = random.Random(1)
    samples = [rng.randint(-20_000, 20_000) for _ in range(3_500)]
    schema = "asset_id long, start_sample long, sample_rate double, samples array<smallint>"

    def windows(cuts):
        rows, at = [], 0
        for n in cuts:
            rows.append((1, at, 16_000.0, samples[at : at + n]))
            at += n
        rng.shuffle(rows)
        return sorted(map(tuple, timeline.energy_windows(spark.createDataFrame(rows, schema)).collect()))

    assert windows([3_500]) == windows([500, 700, 2_300])
    gap = spark.createDataFrame([(1, 0, 48_000.0, [0] * 2_400), (1, 4_800, 48_000.0, [0] * 4_800)], schema)
    assert [(r.start_ms, r.end_ms) for r in timeline.energy_windows(gap).orderBy("start_ms").collect()] == [(0, 50), (100, 200)]


def test_chunks_of_a_track_hand_on_what_the_next_needs(spark):
    """One asset's windows, packets and frames, in one chunk and in many."""
    rng = random.Random(12)
    at, windows = 0, []
    for _ in range(900):
        at += rng.choice([0, 0, 0, 0, 40])
        windows.append((rng.choice([1, 1, 1, 2]), at, at + 100, rng.choice([-60.0, -60.0, -60.0, -10.0])))
        at += rng.choice([100, 100, 50])
    table = spark.createDataFrame(windows + windows[::9], "asset_id long, start_ms long, end_ms long, level_db double")
    runs = lambda **c: sorted(map(tuple, timeline.silence_runs(table, least_ms=200, **c).collect()))
    assert runs() == runs(chunk_ms=130) == runs(chunk_ms=5_000) and len(runs()) > 20

    at, packets = 0, []
    for i in range(120):
        at += rng.choice([0, 0, 1, 2, 3, 500])
        size = rng.randint(1, 900)
        packets.append((1, at, rng.choice([16_000.0] * 9 + [8_000.0]), [rng.randint(-9_000, 9_000) for _ in range(size)]))
        at += size
    chunks = spark.createDataFrame(packets, "asset_id long, start_sample long, sample_rate double, samples array<smallint>")
    levels = lambda **c: sorted((*r[:5], round(r[5], 9)) for r in map(tuple, timeline.energy_windows(chunks, **c).collect()))
    assert levels() == levels(chunk_samples=700) == levels(chunk_samples=9_000) and len({r[1] for r in levels()}) == len(levels())

    frames = spark.createDataFrame([(rng.choice([1, 1, 2, 3]), rng.randrange(50_000), i) for i in range(200)] + [(9, 5, 1)], "segment_id long, time_ms long, ordinal int")
    some = lambda **c: sorted(map(tuple, timeline.representative_frames(frames, **c).collect()))
    assert some() == some(chunk_ms=700) and len(some()) == 25


def test_settings_are_bounded():
    usual = timeline.bounded_settings()
    assert usual["visual_change_threshold"] == 0.20 and usual["silence_threshold_dbfs"] == -42.0 and usual["visual_request_batch_size"] == 240
    odd = timeline.bounded_settings(visual_sample_interval_ms=1, visual_change_threshold=float("nan"), silence_threshold_dbfs=5.0, maximum_visual_sample_count=1, minimum_silence_duration_ms=0, analysis_width=9_999)
    assert odd == usual | {"visual_sample_interval_ms": 50, "silence_threshold_dbfs": 0.0, "maximum_visual_sample_count": 2, "visual_request_batch_size": 2, "minimum_silence_duration_ms": 1, "analysis_width": 256}
    with pytest.raises(ValueError, match="no such settings"):
        timeline.bounded_settings(speed=1)


def test_sampling_and_frames(spark):
    assets = spark.createDataFrame([(1, 3 * 3_600_000), (2, 0)], "asset_id long, duration_ms long")
    plan = timeline.sampling_plan(assets).collect()
    assert len(plan) == 7_200 and plan[1].time_ms == 1_500
    frames = spark.createDataFrame([(1, i * 10, i) for i in range(20)] + [(2, 5, 0)], "segment_id long, time_ms long, ordinal int")
    got = timeline.representative_frames(frames).collect()
    assert [r.ordinal for r in sorted(got) if r.segment_id == 1] == [0, 3, 5, 8, 11, 14, 16, 19] and len(got) == 9


def test_folds_compare_with_the_last_kept(spark):
    hashes = [0, 0b1, 0b11, 0b111, 0b11111, 0b111111111]
    frames = spark.createDataFrame([(1, i, h) for i, h in enumerate(hashes)], "segment_id long, time_ms long, hash long")
    assert [r.hash for r in timeline.distinct_frames(frames).orderBy("time_ms").collect()] == [0, 0b11111] + ([0b111111111] if (0b11111 ^ 0b111111111).bit_count() > 4 else [])
    changes_ = spark.createDataFrame([(1, 0, 0.5), (1, 600, 0.9), (1, 1_200, 0.6), (1, 1_700, 0.7)], "asset_id long, time_ms long, score double")
    assert [(r.time_ms, r.score) for r in timeline.coalesced_changes(changes_, 0.35, 1_000).orderBy("time_ms").collect()] == [(600, 0.9), (1_700, 0.7)]
    close = spark.createDataFrame([(1, 0, 0.2), (1, 499, 0.3), (1, 700, 0.25), (1, 999, 0.19), (1, 1_000, 0.21)], "asset_id long, time_ms long, score double")
    assert [(r.time_ms, r.score) for r in timeline.coalesced_changes(close).orderBy("time_ms").collect()] == [(499, 0.3), (1_000, 0.21)]


def test_sentences_take_their_tokens(spark):
    """Lengths without white space, one at least; a sentence lasts a millisecond; the last takes the rest; blocks bound the times."""
    said = [(1, "你好。出发！", 20_000, 40_000), (2, " quiet? 你好。出发！\n", 0, 500), (3, " \n ", 0, 500), (4, "a! bb! ccc", 0, 1_000), (5, "one", 100, 200)]
    blocks = spark.createDataFrame(said, "segment_id long, transcript string, block_start_ms long, block_end_ms long")
    given_ = [(1, 0, "你", 100, 300), (1, 1, "好。", 300, 600), (1, 2, "出", 900, 1_100), (1, 3, "发！", 1_100, 1_400), (3, 0, "x", 0, 1)]
    given_ += [(4, 0, "  ", 10, 20), (4, 1, "a", 30, 30), (4, 2, "bb", 50, 50), (4, 3, "b", 60, 70), (4, 4, "ccc", 80, 2_000), (4, 5, "c", 90, 1_900), (5, 0, "one", 500, 600)]
    tokens = spark.createDataFrame(given_, "segment_id long, seq long, text string, start_ms long, end_ms long")
    got = [tuple(r) for r in timeline.time_sentences(blocks, tokens).orderBy("segment_id", "ordinal").collect()]
    timed = "forced_alignment_sentence"
    assert got == [
        (1, 0, "你好。", 20_100, 20_600, timed), (1, 1, "出发！", 20_900, 21_400, timed), (2, 0, "quiet? 你好。出发！", 0, 500, "asr_block"),
        (4, 0, "a!", 10, 30, timed), (4, 1, "bb!", 50, 70, timed), (4, 2, "ccc", 80, 1_000, timed), (5, 0, "one", 600, 200, timed),
    ]


def test_merged_ocr_equals_a_plain_walk(spark):
    rng = random.Random(6)
    rows = [(s, rng.randrange(0, 30_000, 250), i, "T", rng.choice("ab"), rng.random(), rng.random(), 0.0, 1.0, 1.0) for i, s in enumerate(rng.choices(range(3), k=150))]
    want = []
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        for o in reversed(want):
            shared = max(0.0, 1 - abs(o["x"] - r[6]))
            if (o["key"], True) == ((r[0], r[4]), r[1] - o["end"] <= 1_500 and shared / (2 - shared) >= 0.3):
                o["end"], o["best"] = r[1] + 1_000, max(o["best"], r[5])
                break
        else:
            want.append({"key": (r[0], r[4]), "x": r[6], "start": r[1], "end": r[1] + 1_000, "best": r[5]})
    raw = spark.createDataFrame(rows, "segment_id long, time_ms long, seq long, text string, norm string, confidence double, x double, y double, w double, h double")
    got = sorted((r.segment_id, r.start_ms, r.end_ms, r.confidence, r.x) for r in timeline.merge_ocr(raw).collect())
    assert got == sorted((o["key"][0], o["start"], o["end"], o["best"], o["x"]) for o in want)


def test_ocr_needs_text_time_and_place(spark):
    rows = [(1, 0, 0, "Exit", "exit", 0.5, 0.0, 0.0, 1.0, 1.0), (1, 2_000, 1, "EXIT", "exit", 0.9, 0.1, 0.0, 1.0, 1.0), (1, 9_000, 2, "exit", "exit", 0.4, 0.0, 0.0, 1.0, 1.0), (1, 2_000, 3, "exit", "exit", 0.3, 5.0, 5.0, 1.0, 1.0)]
    raw = spark.createDataFrame(rows, "segment_id long, time_ms long, seq long, text string, norm string, confidence double, x double, y double, w double, h double")
    got = sorted((r.start_ms, r.end_ms, r.confidence) for r in timeline.merge_ocr(raw).collect())
    assert got == [(0, 3_000, 0.9), (2_000, 3_000, 0.3), (9_000, 10_000, 0.4)]


def test_silence_runs_close_at_gaps(spark):
    rows = [(1, a, a + 100, -60.0) for a in range(0, 600, 100)] + [(1, 600, 700, -10.0)] + [(1, a, a + 100, -60.0) for a in range(700, 1_000, 100)] + [(1, a, a + 100, -60.0) for a in range(1_200, 1_800, 100)]
    got = sorted((r.start_ms, r.end_ms) for r in timeline.silence_runs(spark.createDataFrame(rows, "asset_id long, start_ms long, end_ms long, level_db double")).collect())
    assert got == [(0, 600), (1_200, 1_800)]


def test_column_functions(spark):
    one = spark.range(1)
    v = lambda c: one.select(c.alias("x")).first().x
    bucket = {29_999: "under30s", 30_000: "under5m", 299_999: "under5m", 300_000: "under20m", 1_199_999: "under20m", 1_200_000: "over20m", -1: "over20m"}
    assert all(v(C.duration_bucket(F.lit(k))) == b for k, b in bucket.items())
    assert v(C.timecode(F.lit(3_723_000))) == "1:02:03" and v(C.timecode(F.lit(62_000))) == "01:02"
    assert v(C.snippet(F.lit("  a\nb" + "c" * 20), 4)) == "a bc…"
    assert v(C.occurrences(F.lit("aaaa"), "aa")) == 3
    assert v(C.literal_relevance(F.lit(0))) == 1.0 and v(C.literal_relevance(F.lit(None).cast("int"))) == 0.0
    assert v(C.combined_relevance(F.lit(0.0), F.lit(-0.5))) == 0.0
    assert v(C.natural_key(F.lit("a/IMG_2"))) < v(C.natural_key(F.lit("a/img_10")))
    assert v(C.json_set(F.lit('{"a":"1"}'), "b", F.lit(2))) == '{"a":"1","b":"2"}'
    assert v(C.aligner_language(F.lit("ZH"))) == "Chinese" and v(C.aligner_language(F.lit("xx"))) is None
    assert v(C.split_sentences(F.lit("One! Two.\nThree；"))) == ["One!", "Two.", "Three；"]
    assert v(C.clamped_dot(F.array(F.lit(0.6), F.lit(0.8)), F.array(F.lit(1.0), F.lit(0.0)))) == pytest.approx(0.6)
    assert v(C.hamming64(F.lit(-1), F.lit(0))) == 64
    assert v(C.l2_normalised(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8] and v(C.l2_normalised(F.array(F.lit(0.0)))) is None
    assert v(C.epoch_seconds(F.lit(0.0))) is None


def test_refresh_plan(spark):
    known = spark.createDataFrame([(1, "a.mp4", 10, 1.5, "i", "ready", None), (1, "d.mp4", 10, 1.5, None, "ready", None), (1, "m.mp4", 10, 1.5, None, "missing", 3.0)], "root_id long, relative_path string, file_size long, modification_time double, file_identifier string, status string, invalidated_at double")
    found = spark.createDataFrame([(1, "a.mp4", 10, 1.5, None), (1, "b.mp4", 1, 1.0, None), (1, "d.mp4", 10, 1.5000001, None), (1, "m.mp4", 10, 1.5, None)], "root_id long, relative_path string, file_size long, modification_time double, file_identifier string")
    assert {r.relative_path: r.plan for r in changes.plan_scan_refresh(known, found).collect()} == {"a.mp4": "unchanged", "b.mp4": "probe", "d.mp4": "probe", "m.mp4": "probe"}


def test_drift(spark):
    assets = spark.createDataFrame([(1, 45_001, "f"), (2, 45_001, "f"), (3, 45_001, "f")], "asset_id long, duration_ms long, fingerprint string")
    segments = spark.createDataFrame([(i, True, 45_001) for i in (1, 2, 3)], "asset_id long, is_active boolean, end_ms long")
    seen = spark.createDataFrame([(1, 45_600, "f"), (2, 48_000, "f"), (3, 14_000, "g")], "asset_id long, new_duration_ms long, new_fingerprint string")
    assert {r.asset_id: (r.duration_ms, r.candidate_duration_ms) for r in changes.drift_policy(assets, segments, seen).collect()} == {1: (45_600, None), 2: (45_001, 48_000), 3: (14_000, None)}


def evidence_fixture(spark):
    rows = [(i, i, "visual", "plain text", 0, 900) for i in range(10, 30)]
    rows += [(1, 1, "transcript", "我们在京都车站见", 100, 900), (2, 1, "transcript", "京都车站很大", 1_000, 1_900), (3, 1, "transcript", "去京都车站", 2_000, 2_900), (4, 2, "ocr", "京都车站", 3_000, 3_900), (5, 3, "transcript", "京都车站", 0, 10)]
    evidence = spark.createDataFrame(rows, "evidence_seq long, segment_id long, evidence_type string, text string, start_ms long, end_ms long")
    segments = spark.createDataFrame([(1, 7, "b 10.mp4", 0, 9_000, True), (2, 7, "b 10.mp4", 9_000, 18_000, True), (3, 8, "b 2.mp4", 0, 9_000, False)] + [(i, 9, "c.mp4", 0, 9_000, True) for i in range(10, 30)], "segment_id long, asset_id long, path string, start_ms long, end_ms long, visible boolean")
    return evidence, segments


def test_search_gives_one_explained_row_for_each_asset(spark):
    evidence, segments = evidence_fixture(spark)
    rows = search.literal_search(evidence, segments, {1: "京都车站", 2: "京都", 3: "  "}).collect()
    long_, short = (next(r for r in rows if r.query_id == q) for q in (1, 2))
    assert len(rows) == 2 and (long_.asset_id, long_.segments, long_.transcript_hits_all, long_.ocr_hits_all, long_.literal) == (7, 2, 3, 1, 1.0)
    assert long_.bm25 > 0 and short.bm25 is None and len(long_.matched) == 1


def test_fusion_ranks(spark):
    evidence, segments = evidence_fixture(spark)
    vectors = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (10, [0.6, 0.8]), (11, [1.0]), (3, [1.0, 0.0])], "segment_id long, vector array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
    scores = {r.segment_id: round(r.score, 6) for r in search.vector_rank(vectors, asked, 10).collect()}
    assert scores == {1: 0.0, 2: 1.0, 10: 0.6, 3: 1.0}
    assert [r.segment_id for r in search.vector_rank(vectors, asked, 2).orderBy("place").collect()] == [2, 3]
    got = {r.asset_id: r for r in search.hybrid_search(evidence, segments, vectors, {1: "京都车站"}, asked).collect()}
    assert set(got) == {7, 9} and got[7].semantic == 1.0 and got[9].literal == 0.0 and got[7].place == 1
    assert len(search.hybrid_search(evidence, segments, vectors, {1: "京都车站"}, None).collect()) == 1


def test_rows_of_queries_give_the_results_of_a_dict(spark):
    evidence, segments = evidence_fixture(spark)
    texts = {1: "京都车站", 2: "京都", 3: " \u3000 ", 4: " PLAIN ", 5: "in", 6: "no such"}
    asked = spark.createDataFrame(list(texts.items()), "query_id long, query string")
    assert sorted(map(str, search.literal_search(evidence, segments, asked).collect())) == sorted(map(str, search.literal_search(evidence, segments, texts).collect()))
    index = search.postings(evidence)
    assert sorted(map(str, search.literal_search(evidence, segments, asked, index=index).collect())) == sorted(map(str, search.literal_search(evidence, segments, texts).collect()))


def test_index_counts_overlapping_occurrences(spark, tmp_path):
    texts = ["aaaa AAA", "xaaax", "aa", "", None, "ab\U0001d54fabc\U0001d54fabc"]
    evidence = spark.createDataFrame(list(enumerate(texts)), "evidence_seq long, text string")
    asked = spark.createDataFrame([(1, "aaa"), (2, "b\U0001d54fa"), (3, "aa"), (4, "Aaaa")], "query_id long, query string")
    search.write_postings(search.postings(evidence), f"{tmp_path}/index", 2)
    want = {(k, i, n) for k, q in ((1, "aaa"), (2, "b\U0001d54fa"), (4, "aaaa")) for i, t in enumerate(texts) if (n := sum((t or "").lower().startswith(q, j) for j in range(len(t or ""))))}
    assert {tuple(r) for r in search.indexed_matches(spark.read.parquet(f"{tmp_path}/index"), asked).collect()} == want
    long_ = {(r.query_id, r.evidence_seq, r.f) for r in search.joined_matches(evidence, asked).filter("is_long").collect()}
    assert long_ == want


def test_vectors_in_several_blocks_and_lengths(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4 + i % 2)]) for i in range(60)] + [(60, None), (61, [])]
    vectors = spark.createDataFrame(rows, "segment_id long, vector array<double>").repartition(3)
    asked = spark.createDataFrame([(i, v) for i, v in rows if i % 7 == 0 or i > 59], "query_id long, vector array<double>")
    monkeypatch.setattr(search, "QUERY_BLOCK", 4)
    want = set()
    for k, q in rows:
        if k % 7 == 0 and q:
            near = sorted((-max(-1.0, min(1.0, sum(x * y for x, y in zip(q, v)))), i) for i, v in rows if v and len(v) == len(q))[:5]
            want |= {(k, i, n) for n, (_, i) in enumerate(near, 1)}
    assert {(r.query_id, r.segment_id, r.place) for r in search.vector_rank(vectors, asked, 5).collect()} == want


def test_every_hundredth_row_is_a_query(spark, tmp_path):
    n = 1_300
    spark.createDataFrame([(i, [float(i % 7), 1.0], i % 10) for i in range(n)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, f"word{i} and station", "en", "a", 9) for i in range(0, n - 50)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    every = set(range(0, n, 100))
    scores = QUERIES["vector_rank"](spark, str(tmp_path)).collect()
    assert len(scores) == 50 * 13 and {r.query_id for r in scores} == every
    assert all(r.score == max(-1.0, min(1.0, r.query_id % 7 * (r.segment_id % 7) + 1.0)) for r in scores)
    assert {r.query_id for r in QUERIES["hybrid_search"](spark, str(tmp_path)).collect()} == every
    assert {r.query_id for r in QUERIES["search_lines"](spark, str(tmp_path)).collect()} == every
    # each further text is the first word of its own document, whose segment is seen unless 19 divides it
    words = {r.query_id for r in QUERIES["literal_search"](spark, str(tmp_path)).collect()} - {0, 100, 200, 300, 400}
    assert words == {k for k in every if k >= 500 and k // 4 % 19}


def test_sampling_plan_covers_all_roots(spark, tmp_path):
    day = "timestamp '2020-01-01'"
    spark.range(60).selectExpr("id as o_orderkey", "id as o_custkey", "'O' as o_orderstatus", "1.0D as o_totalprice", f"{day} as o_orderdate", "'1' as o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    want = set()
    for k in range(60):
        duration = 1000 if k % 5 == 0 else k * 7919 % 1_500_000
        every = max(500, -(-duration // 7200))
        want |= {(k, i, ms) for i, ms in enumerate(range(0, duration, every))}
    got = timeline.sampling_plan(view(spark, str(tmp_path), "media_asset")).collect()
    assert len(got) == len(want) and {(r.asset_id, r.ordinal, r.time_ms) for r in got} == want
    digest = {(r.asset_id, r.samples, r.total_ms) for r in QUERIES["sampling_plan"](spark, str(tmp_path)).collect()}
    assert digest == {(k, len(x := [ms for a, _, ms in want if a == k]), sum(x)) for k in {a for a, _, _ in want}}


def test_descriptions_are_all_documents_and_whole_texts(spark, tmp_path):
    texts = {i: f"start {i} " + "word " * 60 + f"end {i}" for i in range(8)}
    spark.createDataFrame([(i, x, "en", "a", len(x)) for i, x in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, [1.0], 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = QUERIES["visual_texts"](spark, str(tmp_path)).collect()
    assert {r.segment_id: r.text for r in rows if r.n == 0} == texts
    assert {r.segment_id for r in QUERIES["latest_descriptions"](spark, str(tmp_path)).collect()} == set(texts)
    assert {r.segment_id for r in QUERIES["committed_descriptions"](spark, str(tmp_path)).collect()} == set(texts)


def test_descriptions_and_index(spark):
    rows = spark.createDataFrame([(1, '{"summary":"s","visible_details":["d"," "],"uncertainty":["u"]}'), (2, 'x {"summary":" t ","visible_details":[],"uncertainty":[]} y'), (3, "none"), (4, '{"summary":"only"}'), (5, None)], "segment_id long, body string")
    assert [tuple(r) for r in ingest.visual_texts(ingest.parse_descriptions(rows)).orderBy("segment_id", "n").collect()] == [(1, 0, "s"), (1, 1, "d"), (2, 0, "t")]


def test_vectors_and_fingerprints(spark, tmp_path):
    import numpy as np

    good = np.array([1.5, -2.0], "<f4").tobytes()
    rows = spark.createDataFrame([(1, good, 2), (2, good, 3), (3, good[:7], 2), (4, None, 2)], "segment_id long, blob binary, dimension int")
    kept, bad = ingest.decode_vectors(rows)
    assert [(r.segment_id, r.vector) for r in kept.collect()] == [(1, [1.5, -2.0])] and sorted(r.segment_id for r in bad.collect()) == [2, 3, 4]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.MP4").write_bytes(b"x" * 200_000)
    (tmp_path / "b.txt").write_text("no")
    (tmp_path / ".c.mp4").write_text("no")
    found = ingest.media_inventory(spark, str(tmp_path)).collect()
    assert [(r.relative_path, r.file_size, r.media_kind) for r in found] == [("sub/a.MP4", 200_000, "video")]
    import hashlib

    content = bytes(range(256)) * 1_000
    want = hashlib.sha256(b"256000|1.5" + content[:65_536] + content[-65_536:]).hexdigest()
    one = spark.createDataFrame([(content, 256_000, 1.5)], "c binary, s long, m double")
    assert one.select(ingest.fingerprint(F.col("s"), F.col("m"), F.col("c")).alias("f")).first().f == want


def test_files_of_a_library(spark, tmp_path, monkeypatch):
    """Links, packages, hidden and other files; a file of three gigabytes of which 128 KiB are read."""
    import hashlib
    import os

    root = tmp_path / "lib"
    for folder in ("a/b/c", "Photos.photoslibrary/inner", ".hidden", "z.app"):
        (root / folder).mkdir(parents=True)
    (root / "a/b/c/deep.MOV").write_bytes(b"q" * 70_000)
    (root / "a/still.heic").write_bytes(b"")
    (root / "a/notes.txt").write_text("no")
    (root / "Photos.photoslibrary/inner/x.jpg").write_text("inside a package")
    (root / ".hidden/y.mp4").write_text("hidden")
    os.symlink(root / "a/still.heic", root / "link.jpg")
    os.symlink(root / "a", root / "folder")
    with open(root / "big.mp4", "wb") as f:
        f.write(b"first")
        f.seek(3 << 30)
        f.write(b"last")
    os.utime(root / "big.mp4", (1_700_000_000, 1_700_000_000.25))
    rows = {r.relative_path: r for r in ingest.scanned_files(spark, str(root)).collect()}
    assert {k: (r.media_kind, r.skipped, r.error) for k, r in rows.items()} == {
        "a/b/c/deep.MOV": ("video", None, None), "a/still.heic": ("image", None, None), "a/notes.txt": (None, "other", None),
        "link.jpg": (None, "link", None), "folder": (None, "link", None), "big.mp4": ("video", None, None),
    }
    big, size = rows["big.mp4"], (3 << 30) + 4
    content = b"first" + bytes(65_531) + bytes(65_532) + b"last"
    assert (big.file_size, big.modified) == (size, 1_700_000_000.25)
    assert big.fingerprint == hashlib.sha256(f"{size}|1700000000.25".encode() + content).hexdigest()
    assert big.content_fingerprint == hashlib.sha256(f"{size}|".encode() + content).hexdigest()
    assert big.metadata_fingerprint == "metadata-" + hashlib.sha256(f"{size}|1700000000.25".encode()).hexdigest()
    assert tuple(ingest.inventory_counts(spark, str(root)).first()) == (3, 3, 0)
    with pytest.raises(Exception, match="not a folder"):
        ingest.media_inventory(spark, str(root / "nowhere")).count()

    scan = os.scandir
    monkeypatch.setattr(mediafiles.os, "scandir", lambda p: scan(p) if not str(p).endswith("/b") else (_ for _ in ()).throw(PermissionError(13, "Permission denied")))
    monkeypatch.setattr(mediafiles, "ENOUGH_FOLDERS", 2)
    reader = mediafiles.MediaReader(str(root))
    seen = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[-1] for r in seen if r[-1]] == [f"{root}/a/b: Permission denied"] and len(seen) == 6


def test_events_need_the_current_attempt(spark):
    jobs = spark.createDataFrame([("a", "running", 2, 1.0), ("b", "running", 2, 1.0), ("c", "pending", 0, 1.0)], "job_id string, status string, attempt int, updated_at double")
    events = spark.createDataFrame([(1, "a", 2, "failed", "x" * 3_000, 5.0), (2, "b", 1, "failed", "", 5.0), (3, "c", 0, "failed", "", 5.0), (4, "a", 2, "succeeded", "", 6.0)], "event_id long, job_id string, attempt int, new_status string, message string, at double")
    state, rejected = lineage.apply_events(jobs, events)
    assert {r.job_id: r.status for r in state.collect()} == {"a": "succeeded", "b": "running", "c": "pending"} and sorted(r.event_id for r in rejected.collect()) == [2, 3]


def test_generation_switch_waits_for_all_vectors(spark):
    segments = spark.createDataFrame([("o1", 1, "r1", 1, True), ("n1", 1, "r2", 2, False), ("n2", 1, "r2", 2, False), ("z", 1, "r0", 0, False)], "segment_id string, asset_id long, run_id string, segmentation_version long, is_active boolean")
    runs = spark.createDataFrame([("r2", 1, "running", 2.0, True)], "run_id string, asset_id long, status string, started_at double, matches boolean")
    for vectors, want in ((["n1"], {"o1": True, "n1": False, "n2": False, "z": False}), (["n1", "n2"], {"o1": False, "n1": True, "n2": True})):
        ready = lineage.generation_readiness(runs, segments, spark.createDataFrame([(v,) for v in vectors], "segment_id string"))
        assert {r.segment_id: r.is_active for r in lineage.activate_generations(segments, ready).collect()} == want


def test_sorting_keeps_images_last(spark):
    rows = [(1, "b.mp4", "video", 10, 5_000, 1.0, 1.0), (2, "a.jpg", "image", 10, 1_000, 2.0, 1.0), (3, "c.mp4", "video", 10, 100, 3.0, 1.0)]
    t = spark.createDataFrame(rows, "asset_id long, relative_path string, media_kind string, file_size long, duration_ms long, modification_time double, first_seen_at double")
    order = lambda by, d: [r.asset_id for r in t.orderBy(*library.sort_key(t, by, d)).collect()]
    assert order("duration", True) == [1, 3, 2] and order("duration", False) == [3, 1, 2] and order("size", True) == order("size", False) == [2, 1, 3] and order("name", True) == [3, 1, 2]
