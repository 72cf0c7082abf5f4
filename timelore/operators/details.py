"""What a user asks for about the library: context of segments, details of videos, statistics and snapshots.

Everything is a join of whole tables or of a set of asked paths; one asset and a batch run the same plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelore.functions.columns import ascii_lower, snippet, timecode, visible_ready
from timelore.operators import library
from timelore.sources import shared

KINDS = ("visual", "transcript", "ocr")
SUMMARY_CHARS, DETAIL_CHARS, MOST_DETAILS, MOST_TRANSCRIPTS = 200, 160, 2, 3


def search_context(candidates: DataFrame, segments: DataFrame, assets: DataFrame, evidence: DataFrame) -> DataFrame:
    """Segment, asset and all evidence (ordered by start, kind, row) of each candidate segment.

    candidates: segment_id (others are carried); segments: segment_id, asset_id, seg_start, seg_end; assets:
    asset_id, relative_path, media_kind. Evidence without times takes the segment's. A segment is at most half a
    minute long, which bounds its evidence.
    """
    rows = candidates.join(segments.select("segment_id", "asset_id", "seg_start", "seg_end"), "segment_id").join(assets.select("asset_id", "relative_path", "media_kind"), "asset_id")
    told = evidence.join(rows.select("segment_id", "seg_start", "seg_end").distinct(), "segment_id")
    one = F.struct(F.coalesce("start_ms", "seg_start").alias("start_ms"), "evidence_type", "evidence_seq", F.coalesce("end_ms", "seg_end").alias("end_ms"), "text")
    return rows.join(told.groupBy("segment_id").agg(F.array_sort(F.collect_list(one)).alias("evidence")), "segment_id", "left")


def evidence_context(index: DataFrame, transcripts: DataFrame, ocr: DataFrame, segments: DataFrame) -> DataFrame:
    """Each row of the index with its segment and asset, and the times of its kind: of its sentence, of its observation, else of the segment.

    index: segment_id, evidence_type, evidence_seq (others are carried); transcripts, ocr: evidence_seq, start_ms,
    end_ms; segments: segment_id, asset_id, path, start_ms, end_ms. Both kinds meet the index in one join; a row
    whose source is gone has no times. Rows of unknown segments are left out.
    """
    timed = [t.select("evidence_seq", F.lit(kind).alias("evidence_type"), F.col("start_ms").alias("_own_start"), F.col("end_ms").alias("_own_end")) for kind, t in (("transcript", transcripts), ("ocr", ocr))]
    rows = index.join(segments.select("segment_id", "asset_id", "path", F.col("start_ms").alias("_start"), F.col("end_ms").alias("_end")), "segment_id")
    rows = rows.join(timed[0].unionByName(timed[1]), ["evidence_seq", "evidence_type"], "left")
    own = F.col("evidence_type").isin("transcript", "ocr")
    times = {c: F.when(own, F.col(f"_own_{n}")).otherwise(F.col(f"_{n}")) for c, n in (("start_ms", "start"), ("end_ms", "end"))}
    return rows.withColumns(times).drop("_start", "_end", "_own_start", "_own_end")


def asset_detail_counts(segments: DataFrame, embedded: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per active segment: whether it is indexed, its transcripts in time order, how many OCR rows and frames it has.

    evidence: segment_id, evidence_type (transcript, ocr, frame), evidence_seq, start_ms, text.
    """
    kind = F.col("evidence_type")
    spoken = F.array_sort(F.collect_list(F.when(kind == "transcript", F.struct("start_ms", "evidence_seq", "text"))))
    per = evidence.groupBy("segment_id").agg(spoken.alias("spoken"), F.count_if(kind == "ocr").alias("ocr_count"), F.count_if(kind == "frame").alias("frame_count"))
    has = embedded.select("segment_id").distinct().withColumn("is_indexed", F.lit(True))
    rows = segments.filter("is_active").join(has, "segment_id", "left").join(per, "segment_id", "left")
    return rows.select(
        "segment_id", "asset_id", "ordinal", "start_ms", "end_ms", F.coalesce("is_indexed", F.lit(False)).alias("is_indexed"), F.coalesce(F.transform("spoken", lambda x: x["text"]), F.array().cast("array<string>")).alias("transcripts"),
        F.coalesce("ocr_count", F.lit(0)).alias("ocr_count"), F.coalesce("frame_count", F.lit(0)).alias("frame_count"),
    )


def resolve_paths(asked: DataFrame, assets: DataFrame) -> DataFrame:
    """(path, asset_id): the asset at exactly that path (earliest seen), else the first in path order that equals it without case or ends with `/` and it.

    Paths and asked ones meet by their last part, so each is moved once.
    """
    exact = asked.join(assets, asked["path"] == assets["relative_path"]).select("path", "asset_id", F.lit(0).alias("tier"), F.struct("first_seen_at", "asset_id").alias("a"), F.lit("").alias("folded"))
    last = lambda path: F.element_at(F.split(path, "/"), -1)
    rows = assets.select("asset_id", ascii_lower(F.col("relative_path")).alias("folded"), F.lower("relative_path").alias("low")).withColumn("name", last(F.col("low")))
    wanted = asked.select("path", F.lower("path").alias("tail")).withColumn("name", last(F.col("tail")))
    met = rows.join(wanted, "name").filter(F.concat(F.lit("/"), "low").endswith(F.concat(F.lit("/"), "tail")))  # all that end alike have one last part
    loose = met.select("path", "asset_id", F.lit(1).alias("tier"), F.struct(F.lit(0.0).alias("first_seen_at"), "asset_id").alias("a"), "folded")
    best = exact.unionByName(loose).groupBy("path").agg(F.min_by("asset_id", F.struct("tier", "a.first_seen_at", "folded", "asset_id")).alias("asset_id"))
    return best


def video_details(asked: DataFrame, assets: DataFrame, details: DataFrame, descriptions: DataFrame, include_transcripts: bool = False) -> DataFrame:
    """Lines about each asked path: (path, n, line, body); n 0 is the header, then the active segments by ordinal.

    details: as of asset_detail_counts; descriptions: segment_id, summary, visible_details (the latest of each
    segment). `body` is the segment as JSON. Segments are shown with a summary, at most two details, and at most
    three transcripts on request; a path that is not in the library has one line that says so.
    """
    found = asked.join(resolve_paths(asked, assets), "path", "left").join(assets.select("asset_id", "relative_path", "media_kind", "duration_ms"), "asset_id", "left")
    timed = F.col("media_kind") != "image"
    rows = found.filter("asset_id is not null").join(details, "asset_id").join(descriptions.select("segment_id", "summary", "visible_details"), "segment_id", "left")
    place = F.row_number().over(Window.partitionBy("path").orderBy("ordinal", "segment_id"))
    extra = lambda column, size, lead, most: F.transform(F.slice(F.coalesce(column, F.array().cast("array<string>")), 1, most), lambda x: F.concat(F.lit("      " + lead), snippet(x, size)))
    head = F.concat(
        F.lit("  "), F.col("n").cast("string"), F.when(F.col("timed"), F.concat(F.lit(" "), timecode(F.col("start_ms")), F.lit("–"), timecode(F.col("end_ms")))).otherwise(""),
        F.when(~F.col("is_indexed"), " · not indexed").otherwise(""), F.when(F.col("ocr_count") > 0, F.concat(F.lit(" · OCR×"), F.col("ocr_count").cast("string"))).otherwise(""),
    )
    lines = [F.array(head), F.when(F.col("summary").isNotNull(), F.array(F.concat(F.lit("      "), snippet(F.col("summary"), SUMMARY_CHARS)))).otherwise(F.array().cast("array<string>")), extra(F.col("visible_details"), DETAIL_CHARS, "", MOST_DETAILS)]
    if include_transcripts:
        lines.append(extra(F.col("transcripts"), DETAIL_CHARS, "said: ", MOST_TRANSCRIPTS))
    times = {c: F.when(F.col("end_ms") > F.col("start_ms"), F.col(c)) for c in ("start_ms", "end_ms")}
    told = F.when(F.col("summary").isNotNull(), F.struct("summary", F.col("visible_details").alias("visibleDetails")))
    body = F.to_json(F.struct(F.col("segment_id").alias("segmentID"), "ordinal", F.col("is_indexed").alias("isIndexed"), times["start_ms"].alias("startMS"), times["end_ms"].alias("endMS"), told.alias("description"), "transcripts", F.col("ocr_count").alias("ocrCount")))
    rows = rows.withColumns({"n": place, "timed": timed})
    each = rows.select("path", "n", F.array_join(F.concat(*lines), "\n").alias("line"), body.alias("body"))
    counts = details.groupBy("asset_id").agg(F.count("*").alias("segments"), F.count_if("is_indexed").alias("indexed"))
    kind = F.when(timed, F.concat(F.lit("video · "), timecode(F.col("duration_ms")))).otherwise("image")
    text = F.concat(F.col("relative_path"), F.lit(" · "), kind, F.format_string(" · %d segments (%d indexed)", F.coalesce("segments", F.lit(0)), F.coalesce("indexed", F.lit(0))))
    header = found.join(counts, "asset_id", "left").select("path", F.lit(0).alias("n"), F.when(F.col("relative_path").isNull(), F.concat(F.lit("not in the library: "), "path")).otherwise(text).alias("line"), F.lit(None).cast("string").alias("body"))
    return header.unionByName(each)


def library_stats(roots: DataFrame, assets: DataFrame, segments: DataFrame, jobs: DataFrame, embedded: DataFrame) -> DataFrame:
    """The statistics (n 0), then the queue of roots with a note each: (n, name, note, pending_jobs, is_processed)."""
    one = library.library_statistics(assets, segments, embedded)
    text = F.format_string("%d assets · %d active segments · %d vectors", "assets", "segments", "embeddings")
    top = one.select(F.lit(0).alias("n"), F.lit("library").alias("name"), text.alias("note"), F.lit(None).cast("long").alias("pending_jobs"), F.lit(None).cast("boolean").alias("is_processed"))
    queue = library.order_roots(library.root_queue_states(roots, assets, jobs))
    waiting = F.when(F.col("last_scan_at").isNull(), "waiting for its first scan").otherwise(F.concat(F.lit("open jobs: "), F.col("open_jobs").cast("string")))
    done = F.when(F.col("last_activity").isNotNull(), F.concat(F.lit("done at "), F.col("last_activity").cast("long").cast("string"))).otherwise("done")
    note = F.when(F.col("is_processed"), done).otherwise(waiting)
    return top.unionByName(queue.select(F.col("place").alias("n"), F.col("path").alias("name"), note.alias("note"), F.col("open_jobs").cast("long").alias("pending_jobs"), "is_processed"))


def library_snapshot(roots: DataFrame, assets: DataFrame, segments: DataFrame, jobs: DataFrame, embedded: DataFrame) -> dict[str, DataFrame]:
    """Roots in order, live assets and their summaries over one set of immutable tables."""
    live = library.list_assets(assets)
    return {
        "roots": library.order_roots(library.root_queue_states(roots, assets, jobs)), "assets": live,
        "summaries": library.processing_summaries(assets, segments, jobs, embedded).join(live.select("asset_id"), "asset_id", "left_semi"),
    }


def job_dashboard(assets: DataFrame, segments: DataFrame, jobs: DataFrame, runs: DataFrame, stale: DataFrame) -> dict[str, DataFrame]:
    """Failures, progress of both lanes and of segmentation, the number of stale descriptions, over one set of immutable tables.

    Which jobs are eligible is worked out once, and written for the failures and the lanes.
    """
    eligible = library.eligible_jobs(jobs, segments, runs).select("job_id", "asset_id", "segment_ordinal", "kind", "status", "message", "updated_at")
    eligible = shared.materialise(eligible, "eligible")
    seen = eligible.join(assets.filter(visible_ready()).select("asset_id"), "asset_id", "left_semi")
    return {
        "failures": library.latest_failures(eligible, assets), "progress": library.lane_counts(seen), "segmentation": library.segmentation_progress(assets, jobs),
        "stale": stale.agg(F.count("*").alias("stale_descriptions")),
    }


def digest(tables: dict[str, DataFrame]) -> DataFrame:
    """(part, n): how many rows each table of a snapshot has."""
    parts = [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n") for k, d in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
