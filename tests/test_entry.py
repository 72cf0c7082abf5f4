"""The registry, a sample of queries against DuckDB, and streams against their batch twins."""

import datetime as dt
import os
import random
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from timelore.operators import timeline
from timelore.plans.queries import ORACLE_SQL, QUERIES
from timelore.streaming import streams
from timelore.streaming.run import drained

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.5f}" if isinstance(v, (int, float)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert sorted(names) == cols and got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLE_SQL) <= set(__spark_entry__.queries())


def test_entry_without_the_training_data_part(tmp_path):
    for part in os.listdir(REPO):
        if part not in ("corpus_pipeline.py", ".git", "timelore"):
            os.symlink(f"{REPO}/{part}", tmp_path / part)
    os.makedirs(tmp_path / "timelore")
    for part in os.listdir(f"{REPO}/timelore"):
        if part != "llm":
            os.symlink(f"{REPO}/timelore/{part}", tmp_path / "timelore" / part)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.stdout.split()[-3:] == [str(len(QUERIES)), "False", "False"], out.stderr


# ---------------------------------------------------------------- streams


def run_stream(spark, rows, schema, build, tmp_path, mode="append"):
    """All rows of a streaming query over a Parquet folder."""
    source, name = str(tmp_path / "in"), f"s{abs(hash(str(tmp_path)))}"
    spark.createDataFrame(rows, schema).write.parquet(source)
    stream = build(spark.readStream.schema(schema).parquet(source))
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    if mode == "append":  # one more batch, so that what the watermark has passed is given out
        spark.createDataFrame(rows[-1:], schema).write.mode("append").parquet(source)
        q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def at(ms):
    return dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)


def test_silence_stream_equals_batch(spark, tmp_path):
    rows = [(at(i * 100), 1, -60.0 if i % 17 not in (7, 8, 9) else -10.0) for i in range(80)] + [(at(600_000), 1, -10.0), (at(600_100), 2, -60.0)]
    got = run_stream(spark, rows, "ts timestamp, asset_id long, level_db double", lambda s: streams.silence_sessions(s, gap_ms=150), tmp_path)
    zero = at(0).timestamp()
    windows = spark.createDataFrame([(a, int((t - at(0)).total_seconds() * 1000), int((t - at(0)).total_seconds() * 1000) + 100, v) for t, a, v in rows], "asset_id long, start_ms long, end_ms long, level_db double")
    want = {(r.asset_id, r.start_ms) for r in timeline.silence_runs(windows).collect()}
    assert {(r.asset_id, round((r.start.timestamp() - zero) * 1000)) for r in got} == want


def test_energy_and_lane_streams(spark, tmp_path):
    rows = [(at(i * 10), 1, 0.5) for i in range(100)] + [(at(900_000), 1, 0.0)]
    got = run_stream(spark, rows, "ts timestamp, asset_id long, value double", streams.energy, tmp_path)
    assert len(got) == 10 and all(round(r.level_db, 3) == -6.021 for r in got)
    events = [(at(i * 60_000), "index_segment", ("pending", "running")[i % 2]) for i in range(90)]
    (tmp_path / "b").mkdir()
    counts = run_stream(spark, events, "ts timestamp, kind string, status string", streams.lane_counts, tmp_path / "b", "update")
    assert sum(r.n for r in counts) == 90 and len(counts) == 4


def test_job_state_stream(spark, tmp_path):
    events = [(at(0), 1, "j", 1, "running"), (at(1_000), 2, "j", 1, "succeeded"), (at(2_000), 3, "j", 1, "failed"), (at(3_000), 4, "j", 2, "running"), (at(4_000), 5, "j", 1, "failed"), (at(5_000), 6, "k", 1, "failed")]
    got = run_stream(spark, events, "ts timestamp, event_id long, job_id string, attempt int, new_status string", streams.job_states, tmp_path)
    assert {r.event_id: r.accepted for r in got} == {1: True, 2: True, 3: False, 4: True, 5: False, 6: False}


def test_ocr_sessions_dedup_and_visible(spark, tmp_path):
    rows = [(at(t), 1, "exit", 0.1 * k) for k, t in enumerate((0, 1_000, 2_000, 9_000))] + [(at(900_000), 9, "end", 0.0)]
    got = run_stream(spark, rows, "ts timestamp, segment_id long, text string, confidence double", streams.ocr_sessions, tmp_path)
    assert sorted(r.n for r in got if r.segment_id == 1) == [1, 3]
    (tmp_path / "d").mkdir()
    twice = [(at(0), 1, "r", "ocr", 0), (at(10), 1, "r", "ocr", 0), (at(20), 1, "r", "ocr", 1)]
    assert len(run_stream(spark, twice, "ts timestamp, segment_id long, run_id string, evidence_type string, n long", streams.deduplicated, tmp_path / "d")) == 2
    assets = spark.createDataFrame([(1, "ready", None, False), (2, "ready", None, True)], "asset_id long, status string, invalidated_at double, is_excluded boolean")
    (tmp_path / "v").mkdir()
    assert [r.asset_id for r in run_stream(spark, [(at(0), 1), (at(1), 2)], "ts timestamp, asset_id long", lambda s: streams.visible_evidence(s, assets), tmp_path / "v")] == [1]


def test_snapshots_count_every_epoch_once(spark, tmp_path):
    state = spark.createDataFrame([(1, "ocr", 0, "old", 0, 1, "x")], "segment_id long, evidence_type string, n long, text string, start_ms long, end_ms long, evidence_id string")
    current = spark.createDataFrame([(1, "f"), (2, "g")], "segment_id long, fingerprint string")
    schema = "segment_id long, evidence_type string, n long, text string, start_ms long, end_ms long, fingerprint string"
    first = spark.createDataFrame([(1, "ocr", 0, "new", 0, 5, "f"), (1, "ocr", 1, "empty", 5, 5, "f"), (2, "ocr", 0, "stale", 0, 5, "f")], schema)
    second = spark.createDataFrame([(2, "ocr", 0, "two", 0, 5, "g")], schema)
    sink = streams.EvidenceSnapshots(f"file://{tmp_path}/s", state, current)
    sink(first, 0)
    sink(second, 0)  # the epoch is known: nothing changes
    texts = lambda d: sorted((r.text, r.evidence_id) for r in d.collect())
    assert texts(sink.snapshot()) == [("new", "1:ocr:0")] and [r.text for r in sink.rejects(0).collect()] == ["stale"]
    second.write.parquet(f"file://{tmp_path}/s/state/1")  # a write of epoch 1 that failed before its manifest
    again = streams.EvidenceSnapshots(f"file://{tmp_path}/s", state, current)
    assert again.epochs() == [-1, 0] and texts(again.snapshot()) == [("new", "1:ocr:0")]
    again(second, 1)
    again(second, 1)
    assert texts(again.snapshot()) == [("new", "1:ocr:0"), ("two", "2:ocr:0")] and texts(again.snapshot(0)) == [("new", "1:ocr:0")]


def test_job_states_over_small_arrow_batches(spark, tmp_path):
    """Events of one job are taken in the order of time, however they come in."""
    rng, status = random.Random(2), ["running", "succeeded"] * 20
    events = [(at(i * 1_000), i, "j", i // 2, s) for i, s in enumerate(status)]
    rng.shuffle(events)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = run_stream(spark, events, "ts timestamp, event_id long, job_id string, attempt int, new_status string", streams.job_states, tmp_path)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(r.event_id for r in got if r.accepted) == list(range(40))


def test_drained_stream_replaces_a_replayed_epoch(spark, tmp_path):
    spark.createDataFrame([(i,) for i in range(10)], "n long").write.parquet(f"{tmp_path}/in")
    out = drained(spark.readStream.schema("n long").parquet(f"{tmp_path}/in"), "append")
    assert sorted(r.n for r in out.collect()) == list(range(10)) and out.columns == ["n"]


def test_evidence_sink_replaces_segments(spark):
    state = [spark.createDataFrame([(1, "ocr", 0, "old", 0, 1, "x")], "segment_id long, evidence_type string, n long, text string, start_ms long, end_ms long, evidence_id string")]
    rejected = []
    current = spark.createDataFrame([(1, "f"), (2, "g")], "segment_id long, fingerprint string")
    sink = streams.evidence_sink(lambda: state[-1], lambda new, bad, epoch: (state.append(new), rejected.append(bad)), current)
    batch = spark.createDataFrame([(1, "ocr", 0, "new", 0, 5, "f"), (1, "ocr", 1, "empty", 5, 5, "f"), (2, "ocr", 0, "stale", 0, 5, "f")], "segment_id long, evidence_type string, n long, text string, start_ms long, end_ms long, fingerprint string")
    sink(batch, 0)
    assert [(r.text, r.evidence_id) for r in state[-1].collect()] == [("new", "1:ocr:0")] and [r.text for r in rejected[0].collect()] == ["stale"]
