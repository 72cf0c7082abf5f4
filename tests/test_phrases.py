"""All texts of a batch in one scan: against plain counting, in small windows, batches and buffers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from timelore.operators import phrases, search, textindex, vectorgrid
from timelore.plans.queries import QUERIES
from timelore.sources import shared

EVIDENCE = "evidence_seq long, segment_id long, evidence_type string, text string, start_ms long, end_ms long"
TERMS = ["station", "STA", "ta", "é", "Éta", "aaaa", "aa", "a", "the ", "zz top", "nothing", "İs", "😀a", "KK", "tat", "tatta", "K", "x\0"]


def rows(seed, n):
    rng = random.Random(seed)
    parts = ["station", "tatta", "aaaaa", "Éta", "the", "zz top", "İstanbul", "😀a", "ß", "x\0", "KKK", "STA", "nothing"]
    text = lambda: rng.choice(["", " ", "."]).join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 5, 30])))
    return [(i, i % 97, rng.choice(search.KINDS), None if rng.random() < 0.02 else text(), i, i + 5) for i in range(n)]


@pytest.fixture
def small_batches(spark):
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_trie_counts_overlapping_texts_in_any_window(monkeypatch):
    rng = random.Random(1)
    for _ in range(60):
        signs = rng.choice(["ab", "abcé", "aàb\0😀"])
        word = lambda most: "".join(rng.choice(signs) for _ in range(most)).encode()
        terms = sorted({word(rng.choice([1, 1, 2, 3, 4, 9])) for _ in range(rng.randint(1, 12))})
        texts = [word(rng.choice([0, 0, 1, 2, 5, 40, 200])) for _ in range(rng.randint(1, 30))]
        monkeypatch.setattr(phrases, "WINDOW", rng.choice([1, 7, 50, 1 << 18]))
        monkeypatch.setattr(phrases, "TABLE", rng.choice([0, 1 << 22]))
        hits = list(phrases.Trie(terms).counted(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])))
        got = [(r, t, n) for h in hits for r, t, n in zip(*(x.tolist() for x in h))]
        count = lambda text, term: sum(text.startswith(term, i) for i in range(len(text)))
        assert sorted(got) == [(r, t, n) for r, x in enumerate(texts) for t, y in enumerate(terms) if (n := count(x, y))]


def test_scanned_searches_are_those_of_the_index(spark, tmp_path, small_batches):
    evidence = spark.createDataFrame(rows(7, 1_500), EVIDENCE).repartition(3)
    segments = spark.createDataFrame([(i, i % 11, f"Clip {i % 11}", 0, 9, i % 5 != 1) for i in range(97)], "segment_id long, asset_id long, path string, start_ms long, end_ms long, visible boolean")
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(TERMS + TERMS[:4])] + [(99, "  ")], "query_id long, query string")
    old = evidence.filter("segment_id % 10 = 1 and evidence_type = 'visual'")
    index = textindex.create(evidence, f"file://{tmp_path}/i")
    for options in ({}, {"fallback": old}):
        scanned, indexed = (sorted(map(str, search.literal_search(evidence, segments, asked, 5, index=x, **options).collect())) for x in (None, index))
        assert scanned == indexed and len(scanned) > 50
    assert search.literal_search(evidence, segments, asked.limit(0)).count() == search.literal_search(evidence.limit(0), segments, asked).count() == 0


def test_a_task_hands_on_the_best_rows_alone(spark, small_batches):
    data = rows(8, 900)
    evidence = spark.createDataFrame(data, EVIDENCE).coalesce(1).withColumn("shown", F.col("evidence_seq") % 4 != 2)
    terms, _ = phrases.asked_terms(search.cleaned_rows(spark.createDataFrame(list(enumerate(TERMS)), "query_id long, query string")))
    block = next(phrases.blocks(terms))
    every = phrases.every(evidence.withColumn("chars", F.length("text")), block, ["evidence_seq", "chars", "shown"]).collect()
    for held, most_rows in ((1 << 20, 6 * len(block)), (64, 900 * len(block))):
        found = phrases.best(evidence, block, ["evidence_seq"], 5, 40.0, held).collect()
        counts = {r.lead: r.n for r in found if r.f is None}
        assert counts == {t[0]: n for t in block if (n := sum(r.lead == t[0] for r in every))}
        assert sum(r.f is not None for r in found) <= most_rows
        for lead, is_long, _ in block:
            order = lambda r, long_=is_long: (-phrases.weight(r.f, max(0, r.chars - 2), 40.0), r.evidence_seq) if long_ else -r.evidence_seq
            cut = lambda x, k=lead: [r.evidence_seq for r in sorted((r for r in x if r.lead == k and r.f is not None), key=order)[:5]]
            assert cut(found) == cut([r for r in every if r.shown])


def test_texts_in_several_blocks_and_plans_without_nested_loops(spark, monkeypatch):
    evidence = spark.createDataFrame(rows(9, 60), EVIDENCE)
    asked = search.cleaned_rows(spark.createDataFrame(list(enumerate(TERMS)), "query_id long, query string"))
    one = search.joined_matches(evidence, asked)
    assert "NestedLoop" not in one._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(phrases, "TERM_BLOCK", 4)
    assert sorted(map(str, search.joined_matches(evidence, asked).collect())) == sorted(map(str, one.collect()))


@pytest.mark.parametrize("name", ["search_json", "fallback_search", "literal_search", "hybrid_search", "search_lines"])
def test_a_batch_of_searches_writes_no_index(spark, tmp_path, monkeypatch, name):
    """What it writes are ids; the index was several times the texts."""
    monkeypatch.setattr(shared, "shared_dir", lambda _: f"file://{tmp_path}")
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert not list(tmp_path.glob("timelore/textindex-*"))


def test_blocks_of_small_cells_are_worth_a_step():
    draw = np.random.default_rng(3)
    v = draw.normal(size=(1_280, 8))
    count = lambda x, *sizes: len(vectorgrid._blocks(np.arange(len(x)), vectorgrid.nearest_pivots(x, v, vectorgrid.pivots(len(x), *sizes)), x, 1_024))
    steps = count(v[:100], vectorgrid.WORTH_QUERIES, vectorgrid.LEAST_QUERIES, vectorgrid.FEW_QUERIES) * count(v, vectorgrid.WORTH_VECTORS, vectorgrid.LEAST_VECTORS, vectorgrid.FEW_VECTORS)
    assert steps <= 8 * 32
    score = np.array([[0.1, 0.9, 0.5, 0.5], [2.0, 3.0, -5.0, 1.0]])
    assert [x.tolist() for x in vectorgrid.reaching(score, np.array([-np.inf, 0.95]), 2)] == [[0, 0, 0, 1, 1, 1], [1, 2, 3, 0, 1, 3]]
    assert [x.tolist() for x in vectorgrid.reaching(score, np.array([0.4, -1.0]), 4)] == [[0, 0, 0, 1, 1, 1, 1], [1, 2, 3, 0, 1, 2, 3]]


def test_phrases_are_counted_in_one_pass_of_the_texts(spark):
    found = QUERIES["indexed_phrases"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange hashpartitioning" not in plan
    evidence = spark.createDataFrame(rows(11, 200), EVIDENCE)
    asked = search.cleaned_rows(spark.createDataFrame(list(enumerate(TERMS + TERMS[:4])), "query_id long, query string"))
    got, want = (sorted(map(tuple, x.collect())) for x in (search.phrase_counts(evidence, asked), search.indexed_matches(search.postings(evidence), asked, by_row=True)))
    assert got == want and len({q for q, _, _ in got}) > 9
