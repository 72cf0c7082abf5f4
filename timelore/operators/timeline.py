"""Timelines: sampling plans, visual change, energy, silence, boundaries and segment plans.

Rules that compare with the last kept element are folds in `applyInArrow` over rows sorted by time. Where a gap
in time makes what follows independent, a track is cut there first (`stretches`), so that a group is a stretch
and not a whole asset. Numbers that run along a track are windows over chunks of it, to which the chunks before hand on
what they need (`with_carry`), so that a long track is many tasks' work. The rest are higher-order functions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from timelore.functions.columns import iou, luma_histogram, split_sentences, visual_difference

#: Sources in order of priority, with their weights.
SOURCE_WEIGHTS = {"shotChange": 1.0, "sentenceEnd": 0.9, "pause": 0.75, "ocrChange": 0.65}
CLUSTER_MS = 300
#: How well a segment's length in ms suits, linear between these points.
LENGTH_KNOTS = ((4_000, 0.0), (8_000, 0.7), (11_500, 1.0), (15_000, 0.7), (30_000, 0.0))
SHORTEST_MS, SHORT_TAIL_MS, SETTLED_MS, LONGEST_MS = 4_000, 8_000, 15_000, 30_000
LENGTH_WEIGHT, MIN_STRENGTH = 0.35, 0.2
FLOOR = 1e-9
FULL_SCALE = 32_767.0
#: Long tracks are worked on in chunks of so much time, or so many samples.
CHUNK_MS, CHUNK_SAMPLES = 6 * 3_600_000, 1 << 26


#: Of each setting of the extraction its least, its most, and what stands for one that isn't a number.
BOUNDS = {
    "visual_sample_interval_ms": (50, 60_000, 500), "visual_change_threshold": (0.0, 1.0, 0.20), "minimum_visual_candidate_spacing_ms": (0, 600_000, 500), "analysis_width": (2, 256, 32), "analysis_height": (2, 256, 18),
    "audio_analysis_window_ms": (10, 1_000, 100), "silence_threshold_dbfs": (-180.0, 0.0, -42.0), "minimum_silence_duration_ms": (1, 600_000, 500), "maximum_visual_sample_count": (2, 100_000, 7_200), "visual_request_batch_size": (1, 1_024, 240),
}


def bounded_settings(**settings: float) -> dict[str, float]:
    """All settings of the extraction within their bounds, as they are kept with what was made by them; a batch is no larger than all samples."""
    unknown = set(settings) - set(BOUNDS)
    if unknown:
        raise ValueError(f"no such settings: {sorted(unknown)}")
    out = {}
    for name, (least, most, usual) in BOUNDS.items():
        value = settings.get(name, usual)
        out[name] = min(most, max(least, value if math.isfinite(value) else usual))
    out["visual_request_batch_size"] = min(out["visual_request_batch_size"], out["maximum_visual_sample_count"])
    return out


def sampling_plan(assets: DataFrame, interval_ms: int = 500, most: int = 7_200) -> DataFrame:
    """(asset_id, ordinal, time_ms): a sample every interval, widened so that an asset has at most `most`."""
    every = F.greatest(F.lit(interval_ms).cast("long"), F.ceil(F.col("duration_ms") / most))
    times = F.sequence(F.lit(0).cast("long"), F.col("duration_ms") - 1, every)
    return assets.filter(F.col("duration_ms") > 0).select("asset_id", F.posexplode(times).alias("ordinal", "time_ms"))


def segment_sampling(segments: DataFrame, every: int = 1_000) -> DataFrame:
    """One frame a second from min(500, half the length) on; the middle of a segment too short for any."""
    span = F.col("end_ms") - F.col("start_ms")
    first = F.col("start_ms") + F.least(F.lit(500).cast("long"), F.floor(span / 2))
    times = F.when(first < F.col("end_ms"), F.sequence(first, F.col("end_ms") - 1, F.lit(every).cast("long"))).otherwise(F.array(F.floor((F.col("start_ms") + F.col("end_ms")) / 2)))
    return segments.filter(span > 0).select("segment_id", F.posexplode(times).alias("ordinal", "time_ms"))


def visual_changes(samples: DataFrame, with_previous: bool = False) -> DataFrame:
    """(asset_id, time_ms, score, and previous_ms on request) of each sample against the one before it. samples: asset_id, time_ms, luma.

    Of several samples at one time the one with the smallest pixels (in order) counts.
    """
    rows = samples.groupBy("asset_id", "time_ms").agg(F.min("luma").alias("luma")).withColumn("hist", luma_histogram(F.col("luma")))
    w = Window.partitionBy("asset_id").orderBy("time_ms")
    rows = rows.withColumns({"p_luma": F.lag("luma").over(w), "p_hist": F.lag("hist").over(w), "previous_ms": F.lag("time_ms").over(w)}).filter("p_luma is not null")
    return rows.select("asset_id", "time_ms", *["previous_ms"] * with_previous, visual_difference(F.col("p_luma"), F.col("luma"), F.col("p_hist"), F.col("hist")).alias("score"))


def with_carry(rows: DataFrame, track: list[str], summary: dict[str, Column], carry: Callable[[WindowSpec, WindowSpec], dict[str, Column]]) -> DataFrame:
    """`rows`, which have a `chunk` of their track, with what the chunks before hand on: a scan of a row for each chunk.

    `carry` gives columns over the summaries of a track, from (all chunks before, the chunks in order).
    """
    per = rows.groupBy(*track, "chunk").agg(*[c.alias(n) for n, c in summary.items()])
    order = Window.partitionBy(*track).orderBy("chunk")
    found = carry(order.rowsBetween(Window.unboundedPreceding, -1), order)
    return rows.join(per.withColumns(found).select(*track, "chunk", *found), [*track, "chunk"])


def representative_frames(frames: DataFrame, most: int = 8, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """At most `most` frames of each segment, spread evenly from the first to the last. Frames are numbered by chunks of time."""
    rows = frames.withColumn("chunk", F.floor(F.col("time_ms") / chunk_ms))
    rows = with_carry(rows, ["segment_id"], {"here": F.count("*")}, lambda before, order: {"earlier": F.coalesce(F.sum("here").over(before), F.lit(0)), "n": F.sum("here").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    rows = rows.withColumn("i", F.col("earlier") + F.row_number().over(Window.partitionBy("segment_id", "chunk").orderBy("time_ms", "ordinal")) - 1)
    step = (F.col("n") - 1) / (most - 1)
    chosen = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.floor(k * step + 0.5))
    return rows.filter((F.col("n") <= most) | F.array_contains(chosen, F.col("i"))).select(*frames.columns)


def stretches(rows: DataFrame, keys: list[str], gap_ms: int) -> DataFrame:
    """`rows` with `stretch`: a new one begins where a row of the key is `gap_ms` or more after the one before it."""
    w = Window.partitionBy(*keys).orderBy("time_ms")
    apart = F.coalesce(F.col("time_ms") - F.lag("time_ms").over(w) >= gap_ms, F.lit(False))
    return rows.withColumn("_apart", apart.cast("long")).withColumn("stretch", F.sum("_apart").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_apart")


def _fold(rows: DataFrame, keys: list[str], schema: str, fold) -> DataFrame:
    """applyInArrow of `fold(table)` to columns of `schema`."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(table: pa.Table) -> pa.Table:
        out = fold(table)
        return pa.table({n: out[n] for n in names})

    return rows.groupBy(*keys).applyInArrow(run, schema)


def distinct_frames(frames: DataFrame, most_bits: int = 4) -> DataFrame:
    """Frames whose hash differs in more than `most_bits` bits from the last kept one. frames: segment_id, time_ms, hash.

    A segment has a frame a second and is at most half a minute long, so a group is small.
    """

    def fold(t: pa.Table) -> dict:
        t = t.sort_by([("time_ms", "ascending"), ("hash", "ascending")])
        hashes = t["hash"].to_numpy()
        kept = [0]
        for i in range(1, len(hashes)):
            if np.bitwise_count((hashes[i] ^ hashes[kept[-1]]).view(np.uint64)) > most_bits:
                kept.append(i)
        return t.take(pa.array(kept, pa.int64())).to_pydict()

    return _fold(frames.select("segment_id", "time_ms", "hash"), ["segment_id"], "segment_id long, time_ms long, hash long", fold)


def coalesced_changes(changes: DataFrame, threshold: float = 0.20, spacing_ms: int = 500) -> DataFrame:
    """Scores from the threshold on; one too near the last kept replaces it only if it is stronger, and moves the anchor."""

    def fold(t: pa.Table) -> dict:
        t = t.sort_by([("time_ms", "ascending"), ("score", "descending")])
        time, score = t["time_ms"].to_numpy(), t["score"].to_numpy()
        kept = [0]
        for i in range(1, len(time)):
            if time[i] - time[kept[-1]] >= spacing_ms:
                kept.append(i)
            elif score[i] > score[kept[-1]]:
                kept[-1] = i
        return t.take(pa.array(kept, pa.int64())).to_pydict()

    rows = stretches(changes.filter(F.col("score") >= threshold).select("asset_id", "time_ms", "score"), ["asset_id"], spacing_ms)
    return _fold(rows, ["asset_id", "stretch"], "asset_id long, time_ms long, score double", fold)


def energy_windows(chunks: DataFrame, window_ms: int = 100, chunk_samples: int = CHUNK_SAMPLES) -> DataFrame:
    """Level of fixed windows of PCM, whatever the packets: (asset_id, start_sample, n, start_ms, end_ms, level_db).

    chunks: asset_id, start_sample, sample_rate, samples (16 bit). A gap of more than two samples, or a new
    rate, closes a window early and starts the count anew. A track is worked on in chunks of `chunk_samples`; where a run began, and
    how long it is so far, is handed on from chunk to chunk. Each packet gives the sum of squares of its part of
    each window; only these meet.
    """
    track = ["asset_id"]
    rate = F.col("sample_rate")
    rows = chunks.withColumns({"size": F.size("samples").cast("long"), "chunk": F.floor(F.col("start_sample") / chunk_samples)}).filter("size > 0")
    ends = {"last": F.max(F.struct("start_sample", (F.col("start_sample") + F.col("size")).alias("end"), "sample_rate"))}
    rows = with_carry(rows, track, ends, lambda before, order: {"before": F.lag("last").over(order)})
    here = Window.partitionBy("asset_id", "chunk").orderBy("start_sample")
    prior = F.coalesce(F.lag(F.struct("start_sample", (F.col("start_sample") + F.col("size")).alias("end"), "sample_rate")).over(here), F.col("before"))
    rows = rows.withColumn("prior", prior)
    broken = F.coalesce((F.abs(F.col("start_sample") - F.col("prior.end")) > 2) | (rate != F.col("prior.sample_rate")), F.lit(True))
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("broken", broken)
    rows = rows.withColumns({"sum": F.sum("size").over(upto) - F.col("size"), "own_start": F.last(F.when(F.col("broken"), F.col("start_sample")), ignorenulls=True).over(upto)})
    rows = rows.withColumn("own_sum", F.last(F.when(F.col("broken"), F.col("sum")), ignorenulls=True).over(upto))
    # a chunk hands on its last run's start, and the samples before it; those of all chunks place it on the track
    summary = {"total": F.sum("size"), "run": F.max(F.when(F.col("broken"), F.struct("start_sample", F.col("sum").alias("at"))))}
    rows = with_carry(rows.drop("prior", "before"), track, summary, lambda before, order: {
        "earlier": F.coalesce(F.sum("total").over(before), F.lit(0)), "run_before": F.last("run", ignorenulls=True).over(before),
        "run_at": F.last(F.when(F.col("run").isNotNull(), F.coalesce(F.sum("total").over(before), F.lit(0)) + F.col("run.at")), ignorenulls=True).over(before),
    })
    offset = F.when(F.col("own_sum").isNotNull(), F.col("sum") - F.col("own_sum")).otherwise(F.col("earlier") + F.col("sum") - F.col("run_at"))
    rows = rows.withColumns({"offset": offset, "run_start": F.coalesce("own_start", "run_before.start_sample"), "width": F.greatest(F.lit(1), F.round(rate * window_ms / 1000)).cast("long")})
    window = F.explode(F.sequence(F.floor(F.col("offset") / F.col("width")), F.floor((F.col("offset") + F.col("size") - 1) / F.col("width"))))
    parts = rows.withColumn("window", window).withColumn("skip", F.greatest(F.lit(0), F.col("window") * F.col("width") - F.col("offset")))
    take = F.least(F.col("size"), (F.col("window") + 1) * F.col("width") - F.col("offset")) - F.col("skip")
    part = F.slice("samples", (F.col("skip") + 1).cast("int"), take.cast("int"))
    squares = F.aggregate(part, F.lit(0.0), lambda s, x: s + (x / FULL_SCALE) * (x / FULL_SCALE))
    parts = parts.select("asset_id", "run_start", "sample_rate", "width", "window", take.alias("n"), squares.alias("squares"))
    whole = parts.groupBy("asset_id", "run_start", "sample_rate", "width", "window").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares"))
    first = F.col("run_start") + F.col("window") * F.col("width")
    ms = lambda at: F.floor(at * 1000 / rate + 0.5)
    level = 20 * F.log10(F.greatest(F.sqrt(F.col("squares") / F.col("n")), F.lit(FLOOR)))
    return whole.select("asset_id", first.alias("start_sample"), F.col("n").cast("int").alias("n"), ms(first).alias("start_ms"), ms(first + F.col("n")).alias("end_ms"), level.alias("level_db"))


def silence_runs(windows: DataFrame, threshold_db: float = -42.0, least_ms: int = 500, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """(asset_id, start_ms, end_ms) of stretches of quiet windows without a gap. windows: asset_id, start_ms, end_ms, level_db.

    A track is worked on in chunks of time, which hand on where the last window ended and how many breaks there were.
    """
    loud = F.col("level_db") > threshold_db
    rows = windows.withColumn("chunk", F.floor(F.col("start_ms") / chunk_ms))
    rows = with_carry(rows, ["asset_id"], {"last": F.max(F.struct("start_ms", "end_ms"))}, lambda before, order: {"before": F.lag("last.end_ms").over(order)})
    here = Window.partitionBy("asset_id", "chunk").orderBy("start_ms", "end_ms")
    gap = F.col("start_ms") > F.coalesce(F.lag("end_ms").over(here), F.col("before"))
    rows = rows.withColumn("breaks", (loud | F.coalesce(gap, F.lit(False))).cast("int"))
    rows = with_carry(rows, ["asset_id"], {"here": F.sum("breaks")}, lambda before, order: {"earlier": F.coalesce(F.sum("here").over(before), F.lit(0))})
    rows = rows.withColumn("island", F.col("earlier") + F.sum("breaks").over(here))
    runs = rows.filter(~loud).groupBy("asset_id", "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return runs.filter(F.col("end_ms") - F.col("start_ms") >= least_ms).select("asset_id", "start_ms", "end_ms")


def boundary_scores(runs: DataFrame) -> DataFrame:
    """A silence as a boundary at its end: score by its length, at least 0.35, with the details as JSON."""
    span = F.col("end_ms") - F.col("start_ms")
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.35), span / 1500))
    return runs.select("asset_id", F.col("end_ms").alias("time_ms"), F.lit("pause").alias("source"), score.alias("score"), F.to_json(F.struct(span.alias("duration_ms"), F.col("start_ms").alias("start_time_ms"))).alias("details"))


def visual_boundaries(kept: DataFrame, changes: DataFrame) -> DataFrame:
    """Kept changes (asset_id, time_ms, score) as boundaries, in the columns of `boundary_scores`. changes: as of visual_changes, with previous_ms."""
    rows = kept.join(changes.select("asset_id", "time_ms", "previous_ms"), ["asset_id", "time_ms"])
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score")))
    return rows.select("asset_id", "time_ms", F.lit("shotChange").alias("source"), score.alias("score"), F.to_json(F.struct(F.col("previous_ms").alias("previous_sample_time_ms"))).alias("details"))


def merge_boundaries(times: list[int], sources: list[str], scores: list[float], duration: int) -> list[tuple[int, list[str], float]]:
    """(time, sources by priority, strength) of clusters anchored at their first time."""
    place = {s: i for i, s in enumerate(SOURCE_WEIGHTS)}
    rows = sorted((t, place[s], -min(1.0, max(0.0, x)), s) for t, s, x in zip(times, sources, scores, strict=True) if 0 < t < duration and x is not None and math.isfinite(x) and s in place)
    out, at = [], 0
    while at < len(rows):
        stop = at
        best: dict[str, tuple[float, int]] = {}
        while stop < len(rows) and rows[stop][0] - rows[at][0] <= CLUSTER_MS:
            t, _, minus, s = rows[stop]
            best[s] = min(best.get(s, (1.0, 0)), (minus, t)) if s in best else (minus, t)
            stop += 1
        weight = {s: -minus * SOURCE_WEIGHTS[s] for s, (minus, _) in best.items()}
        lead = max(best, key=lambda s: (weight[s], -place[s]))
        out.append((best[lead][1], sorted(best, key=place.get), sum(weight.values())))
        at = stop
    return sorted(out, key=lambda b: b[0])


def next_cut(start: int, duration: int, time: np.ndarray, strength: np.ndarray) -> tuple[int, bool]:
    """(where the segment from `start` ends, with more than SETTLED_MS left; whether at a boundary): the strong one that suits best."""
    rest = duration - start
    reach = slice(*np.searchsorted(time, [start + SHORTEST_MS, min(start + LONGEST_MS, duration - SHORTEST_MS) + 1]))
    at, force = time[reach], strength[reach]
    at, force = at[force >= MIN_STRENGTH], force[force >= MIN_STRENGTH]
    if len(at):
        suits = force + LENGTH_WEIGHT * np.interp(at - start, *zip(*LENGTH_KNOTS))
        return int(at[np.lexsort((at, -force, -suits))[0]]), True
    if rest <= LONGEST_MS:
        return duration, False
    return start + (LONGEST_MS if rest - LONGEST_MS >= SHORT_TAIL_MS else rest // 2), False


def plan_cover(duration: int, boundaries: list[tuple[int, list[str], float]]) -> list[tuple[int, int, list[str]]]:
    """(start, end, sources of the end) of a greedy cover of [0, duration)."""
    time = np.array([b[0] for b in boundaries], np.int64)
    strength = np.array([b[2] for b in boundaries], float)
    why = {b[0]: b[1] for b in boundaries}
    plan: list[tuple[int, int, list[str]]] = []
    start = 0
    while start < duration:
        end, chosen = (duration, False) if duration - start <= SETTLED_MS else next_cut(start, duration, time, strength)
        plan.append((start, end, why[end] if chosen else []))
        start = end
    return plan


def plan_segments(candidates: DataFrame) -> DataFrame:
    """(asset_id, ordinal, start_ms, end_ms, sources). candidates: asset_id, duration_ms, time_ms, source, score; one row with null time for an asset without any."""
    schema = "asset_id long, ordinal int, start_ms long, end_ms long, sources array<string>"

    def fold(t: pa.Table) -> dict:
        duration = t["duration_ms"][0].as_py()
        rows = [r for r in zip(t["time_ms"].to_pylist(), t["source"].to_pylist(), t["score"].to_pylist(), strict=True) if r[0] is not None and r[1] is not None and r[2] is not None]
        plan = plan_cover(duration, merge_boundaries([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], duration))
        return {"asset_id": [t["asset_id"][0].as_py()] * len(plan), "ordinal": pa.array(range(len(plan)), pa.int32()), "start_ms": [p[0] for p in plan], "end_ms": [p[1] for p in plan], "sources": pa.array([p[2] for p in plan], pa.list_(pa.string()))}

    return _fold(candidates.select("asset_id", "duration_ms", "time_ms", "source", "score"), ["asset_id"], schema, fold)


def merged_boundaries(candidates: DataFrame) -> DataFrame:
    """(asset_id, time_ms, sources, strength) of the clusters; inputs as for plan_segments."""
    schema = "asset_id long, time_ms long, sources array<string>, strength double"

    def fold(t: pa.Table) -> dict:
        rows = [r for r in zip(t["time_ms"].to_pylist(), t["source"].to_pylist(), t["score"].to_pylist(), strict=True) if None not in r]
        out = merge_boundaries([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], t["duration_ms"][0].as_py())
        return {"asset_id": [t["asset_id"][0].as_py()] * len(out), "time_ms": [o[0] for o in out], "sources": pa.array([o[1] for o in out], pa.list_(pa.string())), "strength": pa.array([o[2] for o in out], pa.float64())}

    return _fold(candidates.select("asset_id", "duration_ms", "time_ms", "source", "score"), ["asset_id"], schema, fold)


def coverage_faults(segments: DataFrame, assets: DataFrame) -> DataFrame:
    """(asset_id, fault) of segmentations that don't cover [0, duration) without gap or overlap."""
    w = Window.partitionBy("asset_id").orderBy("ordinal")
    bad = (F.col("end_ms") <= F.col("start_ms")) | (F.col("start_ms") != F.coalesce(F.lag("end_ms").over(w), F.lit(0)))
    per = segments.withColumn("bad", bad).groupBy("asset_id").agg(F.count_if("bad").alias("n_bad"), F.max("end_ms").alias("cover"))
    rows = per.join(assets.select("asset_id", "duration_ms"), "asset_id")
    fault = F.when(F.col("n_bad") > 0, "broken").when(F.col("cover") != F.col("duration_ms"), "short or long")
    return rows.select("asset_id", fault.alias("fault"), "cover", "duration_ms").filter("fault is not null")


def duration_check(rows: DataFrame, tolerance: int = 1_000) -> DataFrame:
    """What to do with a parked duration: confirm it, dismiss it, or use the decoded one. rows: asset_id, stored_ms, candidate_ms, decoded_ms."""
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= tolerance
    action = F.when(F.col("candidate_ms").isNull(), "none").when(near("candidate_ms", "decoded_ms"), "confirm").when(near("stored_ms", "decoded_ms"), "dismiss").otherwise("use_decoded")
    return rows.withColumn("action", action)


def clip_observations(observations: DataFrame, segments: DataFrame) -> DataFrame:
    """Observations cut to their segment; empty ones go."""
    rows = observations.join(segments.select("segment_id", F.col("start_ms").alias("s0"), F.col("end_ms").alias("s1")), "segment_id")
    rows = rows.withColumns({"start_ms": F.greatest("start_ms", "s0"), "end_ms": F.least("end_ms", "s1")})
    return rows.filter(F.col("end_ms") > F.col("start_ms")).drop("s0", "s1")


def merge_ocr(raw: DataFrame, gap_ms: int = 1_500, hold_ms: int = 1_000, least_iou: float = 0.3) -> DataFrame:
    """Detections joined over time. raw: segment_id, time_ms, seq, text, norm, confidence, x, y, w, h.

    A detection joins the latest earlier observation of equal normalised text whose end is at most `gap_ms`
    before and whose first box overlaps enough; the end moves to time + `hold_ms`, confidence is the largest.
    Texts of a segment follow one another in a partition; only observations that may still be joined are held.
    """
    names = ["segment_id", "text", "confidence", "x", "y", "w", "h", "start_ms", "end_ms"]
    schema = pa.schema([(k, {"segment_id": pa.int64(), "text": pa.string(), "start_ms": pa.int64(), "end_ms": pa.int64()}.get(k, pa.float64())) for k in names])

    def overlap(a: list, b: tuple) -> float:
        (ax, ay, aw, ah), (bx, by, bw, bh) = a[3:7], b
        both = max(0.0, min(ax + aw, bx + bw) - max(ax, bx)) * max(0.0, min(ay + ah, by + bh) - max(ay, by))
        whole = aw * ah + bw * bh - both
        return both / whole if whole > 0 else 0.0

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, live, over = None, [], []  # observations of the key that may go on, and those that are over

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*over, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for segment, norm, time, text, confidence, *box in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (segment, norm) != key:
                    over += live
                    key, live = (segment, norm), []
                ended = [o for o in live if time - o[8] > gap_ms]
                if ended:
                    over += ended
                    live = [o for o in live if time - o[8] <= gap_ms]
                o = next((o for o in reversed(live) if overlap(o, box) >= least_iou), None)
                if o is None:
                    live.append([segment, text, confidence, *box, time, time + hold_ms])
                else:
                    o[8] = time + hold_ms
                    o[2] = max(o[2], confidence)
            if over:
                yield out()
                over = []
        over = live
        if over:
            yield out()

    rows = raw.select("segment_id", "norm", "time_ms", "text", "confidence", "x", "y", "w", "h", "seq")
    dealt = rows.repartition("segment_id", "norm").sortWithinPartitions("segment_id", "norm", "time_ms", "seq").drop("seq")
    return dealt.mapInArrow(fold, "segment_id long, text string, confidence double, x double, y double, w double, h double, start_ms long, end_ms long")


def sentence_tokens(lengths: list[int], tokens: list[int]) -> Iterator[tuple[int, int, int]]:
    """(sentence, first token, last token): a sentence takes tokens until they are as long as it is; the last takes the rest."""
    at = 0
    for i, want in enumerate(lengths):
        first, took = at, 0
        while at < len(tokens) and (took < want or i == len(lengths) - 1):
            took += tokens[at]
            at += 1
        if at > first:
            yield i, first, at - 1


def time_sentences(blocks: DataFrame, tokens: DataFrame) -> DataFrame:
    """Timed sentences of blocks of speech: segment_id, ordinal, text, start_ms, end_ms, timing_source.

    blocks: segment_id (one block each), transcript, block_start_ms, block_end_ms; tokens: segment_id, seq, text,
    start_ms, end_ms within the block. Lengths are characters that aren't white space, one at least. A
    sentence lasts a millisecond at least, within the block. Without tokens the trimmed transcript is one row over
    the block; a blank transcript gives none. A block's tokens meet its row once.
    """
    length = lambda c: F.greatest(F.lit(1), F.length(F.regexp_replace(c, r"(?U)\s", "")))
    told = tokens.select("segment_id", F.struct("seq", "start_ms", "end_ms", length(F.col("text")).alias("length")).alias("token"))
    told = told.groupBy("segment_id").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    said = blocks.select("segment_id", "transcript", "block_start_ms", "block_end_ms", split_sentences(F.col("transcript")).alias("sentences")).filter(F.size("sentences") > 0)
    rows = said.join(told, "segment_id", "left")
    whole = rows.filter("tokens is null").select("segment_id", F.lit(0).alias("ordinal"), F.regexp_replace("transcript", r"(?U)^\s+|\s+$", "").alias("text"), F.col("block_start_ms").alias("start_ms"), F.col("block_end_ms").alias("end_ms"), F.lit("asr_block").alias("timing_source"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(s, i, a, b) for s, lengths, sizes in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) for i, a, b in sentence_tokens(lengths, sizes)]
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), *[pa.int32()] * 3), strict=True)], ["segment_id", "ordinal", "first", "last"])

    aligned = rows.filter("tokens is not null")
    sizes = aligned.select("segment_id", F.transform("sentences", length).alias("lengths"), F.transform("tokens", lambda t: t["length"]).alias("tokens"))
    spans = sizes.mapInArrow(assign, "segment_id long, ordinal int, first int, last int")
    base, end = F.col("block_start_ms"), F.col("block_end_ms")
    a = base + F.get("tokens", F.col("first"))["start_ms"]
    b = base + F.get("tokens", F.col("last"))["end_ms"]
    timed = aligned.join(spans, "segment_id").select(
        "segment_id", "ordinal", F.get("sentences", F.col("ordinal")).alias("text"), F.greatest(base, a).alias("start_ms"), F.least(end, F.greatest(a + 1, b)).alias("end_ms"), F.lit("forced_alignment_sentence").alias("timing_source"),
    )
    return timed.unionByName(whole)


def box_overlap(rows: DataFrame) -> DataFrame:
    """`iou` of boxes (ax, ay, aw, ah) and (bx, by, bw, bh)."""
    box = lambda p: tuple(F.col(p + c) for c in "xywh")
    return rows.withColumn("iou", iou(box("a"), box("b")))
