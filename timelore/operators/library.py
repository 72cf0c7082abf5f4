"""The library: asset listings, processing summaries, facets, roll-ups, queues.

Tables: roots (root_id, path, processing_rank, created_at, last_scan_at), assets, segments, jobs. Every
function maps DataFrames to a DataFrame; state is never changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelore.functions.columns import ascii_lower, basename, duration_bucket, progress_bucket, visible_ready

SEGMENT_JOB, INDEX_JOB, DESCRIBE_JOB = "segment_asset", "index_segment", "describe_segment"


#: Fixed value: what a failed job without a message says.
UNKNOWN_ERROR = "未知错误"


def eligible_jobs(jobs: DataFrame, segments: DataFrame, runs: DataFrame) -> DataFrame:
    """Jobs whose segment is active or of a running segmentation, with its `segment_ordinal`; asset jobs (segment_asset) as they are.

    Waiting jobs of legacy segments (no run) of assets that have a segmentation job don't count. runs: run_id, status.
    """
    running = runs.filter(F.col("status") == "running").select("run_id").distinct().withColumn("_running", F.lit(True))
    owned = jobs.filter(F.col("kind") == SEGMENT_JOB).select("asset_id").distinct().withColumn("_owned", F.lit(True))
    known = segments.join(running, "run_id", "left").join(owned, "asset_id", "left").select(
        "segment_id", F.col("ordinal").alias("segment_ordinal"), (F.col("is_active") | F.coalesce("_running", F.lit(False))).alias("_live"), (F.col("run_id").isNull() & F.coalesce("_owned", F.lit(False))).alias("_legacy"),
    )
    ok = (F.col("kind") == SEGMENT_JOB) | (F.coalesce("_live", F.lit(False)) & ((F.col("status") == "running") | ~F.coalesce("_legacy", F.lit(False))))
    return jobs.join(known, "segment_id", "left").filter(ok).drop("_live", "_legacy")


def list_assets(assets: DataFrame, root_id: int | None = None) -> DataFrame:
    """Assets that are neither invalidated nor excluded, in path order (A-Z folded), with their place."""
    live = assets.filter(F.col("invalidated_at").isNull() & ~F.col("is_excluded"))
    if root_id is not None:
        live = live.filter(F.col("root_id") == root_id)
    return live.orderBy(ascii_lower(F.col("relative_path")), "asset_id")


def active_segments(segments: DataFrame) -> DataFrame:
    return segments.filter("is_active").orderBy("asset_id", "ordinal")


def library_filter(assets: DataFrame, kind: str | None = None, progress: str | None = None, duration: str | None = None, path: str | None = None) -> DataFrame:
    """The conjunction of the facets that are given; a blank path is none. Images are in no duration bucket.

    The path test ignores case and accents. `progress` needs a column `bucket`.
    """
    if kind:
        assets = assets.filter(F.col("media_kind") == kind)
    if progress:
        assets = assets.filter(F.col("bucket") == progress)
    if duration:
        assets = assets.filter((F.col("media_kind") != "image") & (duration_bucket(F.col("duration_ms")) == duration))
    if path and path.strip(" \t"):
        assets = assets.filter(F.collate("relative_path", "UNICODE_CI_AI").contains(path.strip(" \t")))
    return assets


def resolve_asset(assets: DataFrame, query: str) -> DataFrame:
    """One asset: the exact path (earliest seen), else the first in path order that equals or ends with it."""
    path, folded = F.col("relative_path"), ascii_lower(F.col("relative_path"))
    q = query.lower()
    tier = F.when(path == query, 0).when((folded == q) | folded.endswith("/" + q), 1)
    order = [F.col("tier"), F.when(F.col("tier") == 0, F.col("first_seen_at")), folded, F.col("asset_id")]
    return assets.withColumn("tier", tier).filter("tier is not null").orderBy(*order).limit(1).drop("tier")


def numbered_page(listing: DataFrame, order: list[Column], size: int, page: int = 0) -> DataFrame:
    """A page of a listing with row numbers; only the rows up to the page are sorted to one place."""
    first = listing.orderBy(*order).limit(size * (page + 1))
    return first.withColumn("row", F.row_number().over(Window.orderBy(*order))).filter(F.col("row") > size * page)


def root_queue_states(roots: DataFrame, assets: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per root: open jobs on visible assets (0 without any) and the last job activity."""
    visible = assets.filter(visible_ready()).select("root_id", "asset_id")
    open_ = F.col("status").isin("pending", "running")
    per_asset = jobs.groupBy("asset_id").agg(F.count_if(open_).alias("open"), F.max("updated_at").alias("last"))
    per_root = visible.join(per_asset, "asset_id").groupBy("root_id").agg(F.sum("open").alias("open_jobs"), F.max("last").alias("last_activity"))
    return roots.join(per_root, "root_id", "left").select("root_id", "path", "processing_rank", "created_at", "last_scan_at", F.coalesce("open_jobs", F.lit(0)).alias("open_jobs"), "last_activity")


def order_roots(states: DataFrame) -> DataFrame:
    """Unfinished roots by rank and path, then finished ones by last activity, newest first."""
    done = F.col("last_scan_at").isNotNull() & (F.col("open_jobs") == 0)
    out = states.withColumn("is_processed", done)
    keys = [F.col("is_processed"), F.when(~done, F.col("processing_rank")), F.when(~done, F.col("path")), F.when(done, F.col("last_activity")).desc_nulls_last(), F.col("created_at"), F.col("root_id")]
    return out.withColumn("place", F.row_number().over(Window.orderBy(*keys)))  # one row for each root


def processing_summaries(assets: DataFrame, segments: DataFrame, jobs: DataFrame, embedded: DataFrame) -> DataFrame:
    """Per visible asset: segmentation state, active and embedded segments, both job lanes, the running step."""
    visible = assets.filter(visible_ready()).select("asset_id")
    active = segments.filter("is_active").select("asset_id", "segment_id", "ordinal")
    counts = active.join(embedded.select("segment_id").distinct().withColumn("has", F.lit(1)), "segment_id", "left").groupBy("asset_id").agg(F.count("*").alias("total_segments"), F.count("has").alias("indexed_segments"))
    kind, status = F.col("kind"), F.col("status")

    def lane(name: str, k: str) -> list[Column]:
        here = kind == k
        return [
            F.count_if(here & (status == "succeeded")).alias(f"{name}_succeeded"),
            F.count_if(here & (status == "pending")).alias(f"{name}_pending"),
            (F.count_if(here & (status == "running")) > 0).alias(f"{name}_running"),
            F.count_if(here & status.isin("failed", "cancelled")).alias(f"{name}_failed"),
        ]

    step = F.struct("updated_at", "ordinal", "stage")
    lanes = jobs.groupBy("asset_id").agg(
        F.max(F.when(kind == SEGMENT_JOB, F.struct("updated_at", "ordinal", "status"))).alias("seg"),
        *lane("evidence", INDEX_JOB),
        *lane("describe", DESCRIBE_JOB),
        F.max(F.when((kind == INDEX_JOB) & (status == "running"), step)).alias("step"),
    )
    out = visible.join(counts.join(lanes, "asset_id", "full_outer"), "asset_id")
    filled = {c: F.coalesce(c, F.lit(0)) for c in ("total_segments", "indexed_segments", *[f"{n}_{s}" for n in ("evidence", "describe") for s in ("succeeded", "pending", "failed")])}
    filled |= {f"{n}_running": F.coalesce(f"{n}_running", F.lit(False)) for n in ("evidence", "describe")}
    return out.withColumns(filled).withColumns({"segmentation_status": F.col("seg.status"), "current_stage": F.col("step.stage"), "current_ordinal": F.col("step.ordinal")}).drop("seg", "step")


def lane_progress(assets: DataFrame, jobs: DataFrame, segments: DataFrame, runs: DataFrame) -> DataFrame:
    """Per lane (job kinds of segments) on visible assets and eligible segments: counts by status, failed with cancelled, and the finished fraction."""
    lanes = jobs.filter(F.col("kind") != SEGMENT_JOB).join(assets.filter(visible_ready()).select("asset_id"), "asset_id", "left_semi")
    return lane_counts(eligible_jobs(lanes.unionByName(jobs.filter(F.col("kind") == SEGMENT_JOB)), segments, runs))


def lane_counts(eligible: DataFrame) -> DataFrame:
    here = eligible.filter(F.col("kind") != SEGMENT_JOB)
    status = F.col("status")
    out = here.groupBy("kind").agg(
        F.count_if(status == "pending").alias("pending"), F.count_if(status == "running").alias("running"),
        F.count_if(status == "succeeded").alias("succeeded"), F.count_if(status.isin("failed", "cancelled")).alias("failed"), F.count("*").alias("total"),
    )
    return out.withColumn("fraction", F.when(F.col("total") == 0, 0.0).otherwise((F.col("succeeded") + F.col("failed")) / F.col("total")))


def segmentation_progress(assets: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: segmentation jobs of visible assets by status, failed with cancelled, and all of them."""
    status = F.col("status")
    return jobs.filter(F.col("kind") == SEGMENT_JOB).join(assets.filter(visible_ready()).select("asset_id"), "asset_id", "left_semi").agg(
        F.count_if(status == "pending").alias("pending"), F.count_if(status == "running").alias("running"), F.count_if(status == "succeeded").alias("succeeded"),
        F.count_if(status.isin("failed", "cancelled")).alias("failed"), F.count("*").alias("total"),
    )


def library_statistics(assets: DataFrame, segments: DataFrame, embedded: DataFrame) -> DataFrame:
    """Visible assets; active segments of any asset; embedded active segments of visible assets."""
    visible = assets.filter(visible_ready())
    a = visible.agg(F.count("*").alias("assets"))
    s = segments.filter("is_active").agg(F.count("*").alias("segments"))
    e = segments.filter("is_active").join(visible.select("asset_id"), "asset_id", "left_semi").join(embedded.select("segment_id"), "segment_id", "left_semi").agg(F.count("*").alias("embeddings"))
    return a.crossJoin(s).crossJoin(e)  # one row each


def with_buckets(assets: DataFrame, summaries: DataFrame) -> DataFrame:
    joined = assets.join(summaries, "asset_id", "left")
    return joined.withColumn("bucket", progress_bucket())


def facet_counts(bucketed: DataFrame) -> DataFrame:
    """(facet, value, n) over the scope: all, kind, progress bucket, duration bucket (videos)."""
    pairs = F.array(
        F.struct(F.lit("all").alias("facet"), F.lit("all").alias("value")),
        F.struct(F.lit("kind").alias("facet"), F.col("media_kind").alias("value")),
        F.struct(F.lit("progress").alias("facet"), F.col("bucket").alias("value")),
        F.struct(F.lit("duration").alias("facet"), F.when(F.col("media_kind") == "video", duration_bucket(F.col("duration_ms"))).alias("value")),
    )
    return bucketed.select(F.explode(pairs).alias("p")).select("p.facet", "p.value").filter("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))


def pipeline_progress(assets: DataFrame, summaries: DataFrame) -> DataFrame:
    """(stage, done, active, failed, total_assets); later stages are done only on settled segmentations."""
    rows = assets.select("asset_id").join(summaries, "asset_id", "left")
    seg = F.coalesce(F.col("segmentation_status"), F.lit("none"))
    known, total = F.col("total_segments").isNotNull(), F.col("total_segments")
    settled = known & ~seg.isin("pending", "running", "failed", "cancelled") & (total > 0)

    def stage(name: str, done: Column, active: Column, failed: Column) -> Column:
        return F.struct(F.lit(name).alias("stage"), F.count_if(done).alias("done"), F.count_if(active).alias("active"), F.count_if(failed).alias("failed"))

    one = rows.agg(
        F.count("*").alias("total_assets"),
        stage("segmentation", settled, seg == "running", seg.isin("failed", "cancelled")).alias("s"),
        stage("indexing", settled & (F.col("evidence_succeeded") >= total), F.col("evidence_running"), F.col("evidence_failed") > 0).alias("i"),
        stage("description", settled & (F.col("describe_succeeded") >= total), F.col("describe_running"), F.col("describe_failed") > 0).alias("d"),
    )
    return one.select("total_assets", F.explode(F.array("s", "i", "d")).alias("x")).select("x.*", "total_assets")


def library_rollup(bucketed: DataFrame) -> DataFrame:
    """Per root and overall (root_id null): kinds, total video time and bytes, progress buckets."""
    video = F.col("media_kind") == "video"
    counts = [F.count_if(F.coalesce(F.col("bucket") == b, F.lit(False))).alias(b) for b in ("notStarted", "waiting", "inProgress", "completed", "failed")]
    return bucketed.rollup("root_id").agg(
        F.grouping("root_id").cast("int").alias("is_total"), F.count_if(video).alias("videos"), F.count_if(~video).alias("images"),
        F.sum(F.when(video, F.col("duration_ms")).otherwise(0)).alias("video_ms"), F.sum("file_size").alias("bytes"), *counts, F.count("*").alias("assets"),
    )


def sort_key(listing: DataFrame, by: str, descending: bool = False) -> list[Column]:
    """Order of a listing by name, modified, size, duration or first_seen; ties keep path order, images come after videos for duration."""
    name = [ascii_lower(F.col("relative_path")), F.col("asset_id")]
    if by == "name":
        return [c.desc() if descending else c.asc() for c in name]
    key = {"modified": F.col("modification_time"), "size": F.col("file_size"), "duration": F.col("duration_ms"), "first_seen": F.col("first_seen_at")}[by]
    lead = [F.col("media_kind") == "image"] if by == "duration" else []
    return [*lead, key.desc() if descending else key.asc(), *name]


def failed_jobs(jobs: DataFrame, assets: DataFrame, segments: DataFrame, runs: DataFrame, limit: int = 100) -> DataFrame:
    """The most recent failed or cancelled eligible jobs with the name of their asset, their segment's ordinal and message."""
    return latest_failures(eligible_jobs(jobs, segments, runs), assets, limit)


def latest_failures(eligible: DataFrame, assets: DataFrame, limit: int = 100) -> DataFrame:
    bad = eligible.filter(F.col("status").isin("failed", "cancelled"))
    named = bad.join(assets.select("asset_id", basename(F.col("relative_path")).alias("name")), "asset_id")
    last = named.orderBy(F.desc("updated_at"), "job_id").limit(max(1, limit))
    return last.select("job_id", "asset_id", "name", "segment_ordinal", "kind", "status", F.coalesce("message", F.lit(UNKNOWN_ERROR)).alias("message"), "updated_at")


def work_order(jobs: DataFrame, assets: DataFrame, roots: DataFrame, segments: DataFrame, kind: str = INDEX_JOB) -> DataFrame:
    """Pending jobs of one kind in the order of work: assets with a running job first, then root rank, path, asset, ordinal.

    `place` counts over all jobs: within a root by a window, and before it by the sizes of the roots before.
    """
    ready = assets.filter(visible_ready()).select("asset_id", "root_id", "relative_path")
    busy = jobs.filter(F.col("status") == "running").select("asset_id").distinct().withColumn("busy", F.lit(True))
    rows = jobs.filter((F.col("status") == "pending") & (F.col("kind") == kind)).join(ready, "asset_id").join(busy, "asset_id", "left").join(roots.select("root_id", "processing_rank"), "root_id")
    rows = rows.withColumn("busy", F.coalesce("busy", F.lit(False)))
    groups = Window.orderBy(F.desc("busy"), "processing_rank", "root_id").rowsBetween(Window.unboundedPreceding, -1)  # two rows for each root
    sizes = rows.groupBy("busy", "processing_rank", "root_id").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(groups), F.lit(0)))
    order = Window.partitionBy("busy", "root_id").orderBy(ascii_lower(F.col("relative_path")), "asset_id", "ordinal", "job_id")
    placed = rows.withColumn("within", F.row_number().over(order)).join(F.broadcast(sizes.select("busy", "root_id", "before")), ["busy", "root_id"])
    return placed.select("job_id", "asset_id", "root_id", "processing_rank", "busy", (F.col("before") + F.col("within")).alias("place"))


def segment_details(segments: DataFrame, jobs: DataFrame, embedded: DataFrame, evidence_counts: DataFrame) -> DataFrame:
    """Active segments with their describe job, whether they have a vector, and how much evidence they have."""
    describe = jobs.filter(F.col("kind") == DESCRIBE_JOB).groupBy("segment_id").agg(F.max(F.struct("updated_at", "status")).alias("j"))
    has = embedded.select("segment_id").distinct().withColumn("has_vector", F.lit(True))
    out = segments.filter("is_active").join(describe, "segment_id", "left").join(has, "segment_id", "left").join(evidence_counts, "segment_id", "left")
    return out.select("segment_id", "asset_id", "ordinal", F.col("j.status").alias("describe_status"), F.coalesce("has_vector", F.lit(False)).alias("has_vector"), F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"))


def incomplete_assets(segments: DataFrame, jobs: DataFrame) -> DataFrame:
    """Assets with active work: a segment whose evidence is missing or open, or done without a finished description."""
    def lane(kind: str, name: str) -> DataFrame:
        return jobs.filter(F.col("kind") == kind).groupBy("segment_id").agg(F.max(F.struct("updated_at", "status")).alias("x")).select("segment_id", F.col("x.status").alias(name))

    rows = segments.filter("is_active").join(lane(INDEX_JOB, "evidence"), "segment_id", "left").join(lane(DESCRIBE_JOB, "describe"), "segment_id", "left")
    open_ = F.col("evidence").isNull() | F.col("evidence").isin("pending", "running") | ((F.col("evidence") == "succeeded") & (F.coalesce("describe", F.lit("")) != "succeeded"))
    return rows.groupBy("asset_id").agg(F.count_if(open_).alias("open_segments"), F.count("*").alias("segments")).withColumn("is_active_work", F.col("open_segments") > 0)
