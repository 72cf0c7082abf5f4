"""Scan differences, upserts and tombstones as transitions from one snapshot to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelore.functions.columns import visible_ready

WINDOW_MS = 20_000
DRIFT_MS = 1_000
KEY = ["root_id", "relative_path"]


def plan_scan_refresh(known: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates as unchanged or to probe: unchanged needs a ready known row of the path, the same size and exact time, and equal file ids or one missing."""
    old = known.select(*KEY, F.lit(True).alias("known"), F.col("file_size").alias("k_size"), F.col("modification_time").alias("k_time"), F.col("file_identifier").alias("k_id"), ((F.col("status") == "ready") & F.col("invalidated_at").isNull()).alias("k_ready"))
    same_id = F.col("file_identifier").isNull() | F.col("k_id").isNull() | (F.col("file_identifier") == F.col("k_id"))
    same = F.col("known") & F.col("k_ready") & (F.col("file_size") == F.col("k_size")) & (F.col("modification_time") == F.col("k_time")) & same_id
    out = candidates.join(old, KEY, "left")
    return out.withColumn("plan", F.when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("probe")).select(*candidates.columns, "plan")


def apply_scan(state: DataFrame, scan: DataFrame, authoritative: bool, now: float) -> DataFrame:
    """The next asset state: observed rows are live with the scan's facts; others become missing if the scan was complete."""
    facts = ["file_size", "modification_time", "file_identifier"]
    seen = scan.select(*KEY, *[F.col(c).alias(f"new_{c}") for c in facts], F.lit(True).alias("seen"))
    out = state.join(seen, KEY, "full_outer")
    lost = F.lit(authoritative) & F.col("seen").isNull() & F.col("invalidated_at").isNull()
    observed = F.coalesce("seen", F.lit(False))
    columns = {c: F.when(observed, F.col(f"new_{c}")).otherwise(F.col(c)) for c in facts}
    columns["status"] = F.when(observed, "ready").when(lost, "missing").otherwise(F.col("status"))
    columns["invalidated_at"] = F.when(observed, F.lit(None).cast("double")).when(lost, F.lit(now)).otherwise(F.col("invalidated_at"))
    columns["is_new"] = F.col("asset_id").isNull()
    columns["is_excluded"] = F.coalesce("is_excluded", F.lit(False))
    return out.withColumns(columns).select("asset_id", *KEY, *facts, "status", "invalidated_at", "is_excluded", "is_new")


def apply_scan_refresh(state: DataFrame, unchanged: DataFrame, probed: DataFrame, authoritative: bool, now: float) -> DataFrame:
    """As apply_scan with two inputs: paths known to be unchanged keep their facts, probed rows bring theirs; probed wins."""
    facts = ["file_size", "modification_time", "file_identifier"]
    same = state.join(unchanged.select(*KEY).distinct(), KEY, "left_semi").join(probed.select(*KEY), KEY, "left_anti")
    return apply_scan(state, probed.select(*KEY, *facts).unionByName(same.select(*KEY, *facts)), authoritative, now)


def resolve_identity(scan: DataFrame, known: DataFrame) -> DataFrame:
    """The asset of each observed file: by file id within the root, else by path, else a new id from root and path."""
    ids = known.filter("file_identifier is not null").groupBy("root_id", "file_identifier").agg(F.min("asset_id").alias("by_id"))
    paths = known.groupBy(*KEY).agg(F.min("asset_id").alias("by_path"))
    out = scan.join(ids, ["root_id", "file_identifier"], "left").join(paths, KEY, "left")
    found = F.coalesce(F.col("by_id").cast("string"), F.col("by_path").cast("string"))
    how = F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_path").isNotNull(), "path").otherwise("new")
    fresh = F.sha2(F.concat_ws("|", F.col("root_id").cast("string"), "relative_path"), 256)
    return out.select(*KEY, F.coalesce(found, fresh).alias("asset_key"), how.alias("matched_by"))


def drift_policy(assets: DataFrame, segments: DataFrame, observed: DataFrame) -> DataFrame:
    """New durations against the cover of the active segments: taken within a second of it (or without cover), else parked.

    `observed`: asset_id, new_duration_ms, new_fingerprint. Changed content drops the old segments and takes the new duration.
    """
    cover = segments.filter("is_active").groupBy("asset_id").agg(F.max("end_ms").alias("cover_ms"))
    rows = observed.join(assets.select("asset_id", "duration_ms", "fingerprint"), "asset_id", "left").join(cover, "asset_id", "left")
    c = F.coalesce("cover_ms", F.lit(0))
    changed = F.col("fingerprint").isNull() | (F.col("fingerprint") != F.col("new_fingerprint"))
    take = changed | (F.col("new_duration_ms") == F.col("duration_ms")) | (c == 0) | (F.abs(F.col("new_duration_ms") - c) <= DRIFT_MS)
    return rows.select(
        "asset_id", changed.alias("content_changed"), F.when(take, F.col("new_duration_ms")).otherwise(F.col("duration_ms")).alias("duration_ms"), F.when(~take, F.col("new_duration_ms")).alias("candidate_duration_ms")
    )


def upsert_assets(assets: DataFrame, segments: DataFrame, observed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assets, segments) after observed durations and fingerprints: changed content drops the asset's segments, drift is taken or parked."""
    drift = drift_policy(assets, segments, observed)
    facts = drift.join(observed.select("asset_id", "new_fingerprint"), "asset_id").select("asset_id", "content_changed", F.col("duration_ms").alias("_d"), "candidate_duration_ms", "new_fingerprint")
    seen = F.col("new_fingerprint").isNotNull()
    out = assets.join(facts, "asset_id", "full_outer").withColumns({"duration_ms": F.when(seen, F.col("_d")).otherwise(F.col("duration_ms")), "fingerprint": F.coalesce("new_fingerprint", "fingerprint")})
    return out.select("asset_id", "duration_ms", "fingerprint", "candidate_duration_ms"), segments.join(drift.filter("content_changed").select("asset_id"), "asset_id", "left_anti")


def fixed_windows(assets: DataFrame, width: int = WINDOW_MS) -> DataFrame:
    """Fallback generation 1 of ready videos: windows of `width`, the last cut to the duration."""
    videos = assets.filter(visible_ready() & (F.col("media_kind") == "video") & (F.col("duration_ms") > 0))
    rows = videos.select("asset_id", "duration_ms", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("duration_ms") - 1, F.lit(width).cast("long"))).alias("ordinal", "start_ms"))
    return rows.select(F.concat_ws(":", F.col("asset_id").cast("string"), F.lit("v1"), F.col("ordinal").cast("string")).alias("segment_id"), "asset_id", "ordinal", "start_ms", F.least(F.col("start_ms") + width, F.col("duration_ms")).alias("end_ms"))


def remove_assets(state: DataFrame, removed: DataFrame) -> DataFrame:
    """Tombstones: the named assets become excluded and stay so through scans."""
    return state.join(removed.select("asset_id").distinct().withColumn("_gone", F.lit(True)), "asset_id", "left").withColumn("is_excluded", F.col("is_excluded") | F.coalesce("_gone", F.lit(False))).drop("_gone")


def remove_derived(removed: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """Segments, jobs and other tables with an asset_id, without those of the removed assets."""
    gone = removed.select("asset_id").distinct()
    return [t.join(gone, "asset_id", "left_anti") for t in tables]


def restore_assets(state: DataFrame, restored: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state with the named assets back, fallback segments for those without active ones)."""
    names = restored.select("asset_id").distinct()
    back = state.join(names.withColumn("_back", F.lit(True)), "asset_id", "left").withColumn("is_excluded", F.col("is_excluded") & ~F.coalesce("_back", F.lit(False))).drop("_back")
    bare = back.join(names, "asset_id", "left_semi").join(segments.filter("is_active").select("asset_id"), "asset_id", "left_anti")
    return back, fixed_windows(bare)


def remove_roots(tables: dict[str, DataFrame], removed: DataFrame) -> dict[str, DataFrame]:
    """Roots and all below them: assets by root, segments and jobs by asset, evidence by segment."""
    out = dict(tables)
    out["roots"] = tables["roots"].join(removed, "root_id", "left_anti")
    gone_assets = tables["assets"].join(removed, "root_id", "left_semi").select("asset_id")
    out["assets"] = tables["assets"].join(removed, "root_id", "left_anti")
    for name in ("segments", "jobs"):
        if name in tables:
            out[name] = tables[name].join(gone_assets, "asset_id", "left_anti")
    if "evidence" in tables:
        gone = tables["segments"].join(gone_assets, "asset_id", "left_semi").select("segment_id")
        out["evidence"] = tables["evidence"].join(gone, "segment_id", "left_anti")
    return out


def add_roots(roots: DataFrame, paths: DataFrame) -> DataFrame:
    """Known paths keep their row; new ones get the next ranks in path order."""
    new = paths.select("path").distinct().join(roots.select("path"), "path", "left_anti")
    most = roots.agg(F.coalesce(F.max("processing_rank"), F.lit(-1)).alias("most"), F.coalesce(F.max("root_id"), F.lit(-1)).alias("last"))
    n = F.row_number().over(Window.orderBy("path"))
    added = new.withColumn("n", n).crossJoin(F.broadcast(most)).select((F.col("last") + F.col("n")).alias("root_id"), "path", (F.col("most") + F.col("n")).alias("processing_rank"))
    return roots.select("root_id", "path", "processing_rank").unionByName(added)


def move_to_front(roots: DataFrame, root_id: int) -> DataFrame:
    least = roots.agg(F.min("processing_rank").alias("least"))
    return roots.crossJoin(F.broadcast(least)).withColumn("processing_rank", F.when(F.col("root_id") == root_id, F.col("least") - 1).otherwise(F.col("processing_rank"))).drop("least")


def rank_backfill(roots: DataFrame) -> DataFrame:
    """Rank = number of roots that are earlier by (created_at, path); one row for each root, so one window will do."""
    return roots.withColumn("initial_rank", F.row_number().over(Window.orderBy("created_at", "path")) - 1)


def next_generation(segments: DataFrame) -> DataFrame:
    """The number of the next segmentation of each asset, at least 2."""
    return segments.groupBy("asset_id").agg(F.greatest(F.lit(2), F.coalesce(F.max("segmentation_version"), F.lit(1)) + 1).alias("next_version"))


def orphan_paths(inventory: DataFrame, referenced: DataFrame, column: str = "path") -> DataFrame:
    """Paths on disk that no row refers to; a report, nothing is deleted."""
    return inventory.select(column).distinct().join(referenced.select(column), column, "left_anti")

