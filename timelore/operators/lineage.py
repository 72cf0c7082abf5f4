"""Incremental recompute: which derived rows are missing, stale or superseded, as joins over snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelore.functions.columns import json_set, recipe_hash, visible_ready
from timelore.operators.library import DESCRIBE_JOB, INDEX_JOB, SEGMENT_JOB


def servable_segments(segments: DataFrame, runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Active segments, or those of a running run; not legacy ones (no run) of assets that have a segmentation job.

    runs: run_id, status. `can_select` also needs that no segmentation of the asset is open.
    """
    running = runs.filter(F.col("status") == "running").select("run_id").distinct().withColumn("running", F.lit(True))
    per_asset = jobs.filter(F.col("kind") == SEGMENT_JOB).groupBy("asset_id").agg((F.count_if(F.col("status").isin("pending", "running")) > 0).alias("is_open"), F.lit(True).alias("owned"))
    rows = segments.join(running, "run_id", "left").join(per_asset, "asset_id", "left")
    ok = (F.col("is_active") | F.coalesce("running", F.lit(False))) & ~(F.col("run_id").isNull() & F.coalesce("owned", F.lit(False)))
    return rows.filter(ok).withColumn("can_select", ~F.coalesce("is_open", F.lit(False))).drop("running", "owned", "is_open")


def fallback_visual_rows(segments: DataFrame, visual: DataFrame, described: DataFrame) -> DataFrame:
    """Visual rows of the newest inactive generation that has any, while an active segment lacks a description.

    visual: segment_id, ...; described: segment_id.
    """
    old = segments.filter(~F.col("is_active"))
    newest = old.join(visual.select("segment_id").distinct(), "segment_id", "left_semi").groupBy("asset_id").agg(F.max("segmentation_version").alias("segmentation_version"))
    waiting = segments.filter("is_active").join(described.select("segment_id"), "segment_id", "left_anti").select("asset_id").distinct()
    keep = old.join(newest, ["asset_id", "segmentation_version"], "left_semi").join(waiting, "asset_id", "left_semi")
    return visual.join(keep.select("segment_id", "asset_id"), "segment_id")


def latest_descriptions(descriptions: DataFrame, vectors: DataFrame) -> DataFrame:
    """The newest description of each segment, and whether it was made from the current evidence.

    descriptions: segment_id, description_id, created_at, input_revision, run_id; vectors: segment_id, run_id.
    Without an input revision the description's run counts.
    """
    w = Window.partitionBy("segment_id").orderBy(F.desc("created_at"), F.desc("description_id"))
    last = descriptions.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    now = vectors.groupBy("segment_id").agg(F.max("run_id").alias("evidence_run"))
    current = F.coalesce(F.col("input_revision"), F.col("run_id")) == F.col("evidence_run")
    return last.join(now, "segment_id", "left").withColumn("is_evidence_current", F.coalesce(current, F.lit(False)))


def active_boundaries(boundaries: DataFrame, segments: DataFrame) -> DataFrame:
    """Boundary rows of runs that own an active segment, each once."""
    return boundaries.join(segments.filter("is_active").select("run_id"), "run_id", "left_semi")


def index_revision(vectors: DataFrame) -> DataFrame:
    """One row: count, newest time and an order-free sum over the ids, to tell whether an index is stale."""
    return vectors.agg(F.count("*").alias("n"), F.max("created_at").alias("newest"), F.sum(F.conv(F.substring(F.md5(F.col("segment_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long")).alias("checksum"))


def stale_descriptions(descriptions: DataFrame, assets_of: DataFrame, prompts: dict[str, str], model_id: str) -> DataFrame:
    """Descriptions whose prompt isn't that of their media kind, or whose model is another. assets_of: segment_id, media_kind."""
    table = F.create_map(*[F.lit(x) for kv in prompts.items() for x in kv])
    rows = descriptions.join(assets_of, "segment_id")
    return rows.filter((F.col("prompt_version") != F.try_element_at(table, F.col("media_kind"))) | (F.col("model_id") != model_id))


def generation_readiness(runs: DataFrame, segments: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per asset its newest running run (fingerprint equal to the asset's): segments, vectors, ready if equal and positive.

    runs: run_id, asset_id, status, started_at, matches.
    """
    w = Window.partitionBy("asset_id").orderBy(F.desc("started_at"), F.desc("run_id"))
    newest = runs.filter((F.col("status") == "running") & F.col("matches")).withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("asset_id", "run_id")
    has = vectors.select("segment_id").distinct().withColumn("has", F.lit(1))
    counts = segments.join(newest, ["asset_id", "run_id"]).join(has, "segment_id", "left").groupBy("asset_id", "run_id").agg(F.count("*").alias("n_segments"), F.count("has").alias("n_vectors"))
    return counts.withColumn("is_ready", (F.col("n_segments") == F.col("n_vectors")) & (F.col("n_segments") > 0))


def activate_generations(segments: DataFrame, ready: DataFrame) -> DataFrame:
    """Segments after the switch: those of a ready run become active, the former active version stays inactive, older inactive ones go."""
    switch = ready.filter("is_ready").select("asset_id", F.col("run_id").alias("new_run"))
    before = segments.filter("is_active").groupBy("asset_id").agg(F.max("segmentation_version").alias("previous"))
    rows = segments.join(switch, "asset_id", "left").join(before, "asset_id", "left")
    switching = F.col("new_run").isNotNull()
    is_new = switching & (F.col("run_id") == F.col("new_run"))
    keep = ~switching | is_new | F.coalesce(F.col("segmentation_version") == F.col("previous"), F.lit(False))
    return rows.filter(keep).withColumn("is_active", F.when(switching, is_new).otherwise(F.col("is_active"))).select(*segments.columns)


def stage_generation(segments: DataFrame, planned: DataFrame, boundaries: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments with the planned generation beside the active one, boundary rows cut to the duration).

    planned: asset_id, run_id, ordinal, start_ms, end_ms. Inactive segments of older staged runs of these
    assets go; the new ones are inactive, with the run in their id and the next version.
    """
    from timelore.operators.changes import next_generation

    touched = planned.select("asset_id").distinct()
    version = segments.groupBy("asset_id").agg(F.max(F.when(F.col("is_active"), F.col("segmentation_version"))).alias("live"))
    kept = segments.join(touched.withColumn("_t", F.lit(True)), "asset_id", "left").join(version, "asset_id", "left")
    kept = kept.filter(F.col("_t").isNull() | F.col("is_active") | F.coalesce(F.col("segmentation_version") < F.col("live"), F.lit(False))).select(*segments.columns)
    new = planned.join(next_generation(segments), "asset_id", "left").select(
        F.concat_ws(":", F.col("asset_id").cast("string"), "run_id", F.col("ordinal").cast("string")).alias("segment_id"), "asset_id", F.col("ordinal").cast("long").alias("ordinal"), "start_ms", "end_ms",
        F.coalesce("next_version", F.lit(2)).cast("long").alias("segmentation_version"), F.lit(False).alias("is_active"), "run_id",
    )
    cut = boundaries.join(assets.select("asset_id", "duration_ms"), "asset_id").filter((F.col("time_ms") >= 0) & (F.col("time_ms") <= F.col("duration_ms"))).drop("duration_ms")
    return kept.unionByName(new), cut


def commit_segmentation(segments: DataFrame, planned: DataFrame, boundaries: DataFrame, assets: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments, run rows, boundary rows) after a new segmentation: staged beside the active one, or active at once where no active segment has a vector."""
    staged, cut = stage_generation(segments, planned, boundaries, assets)
    new_runs = planned.select("asset_id", "run_id").distinct()
    indexed = segments.filter("is_active").join(vectors.select("segment_id"), "segment_id", "left_semi").select("asset_id").distinct().withColumn("indexed", F.lit(True))
    new_runs = new_runs.join(indexed, "asset_id", "left").withColumn("is_ready", F.col("indexed").isNull()).drop("indexed")
    return activate_generations(staged, new_runs), new_runs.select("run_id", "asset_id", F.when(F.col("is_ready"), "succeeded").otherwise("running").alias("status")), cut


def finish_activation(runs: DataFrame, assets: DataFrame, ready: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, assets) after the switch: the runs that became active have succeeded, and their assets take the parked duration.

    assets: asset_id, duration_ms, candidate_duration_ms.
    """
    switch = ready.filter("is_ready").select("asset_id", "run_id").withColumn("_now", F.lit(True))
    done = runs.join(switch, ["asset_id", "run_id"], "left").withColumn("status", F.when(F.col("_now"), "succeeded").otherwise(F.col("status"))).select(*runs.columns)
    moved = assets.join(switch.select("asset_id", "_now"), "asset_id", "left")
    columns = {"duration_ms": F.when(F.col("_now"), F.coalesce("candidate_duration_ms", "duration_ms")).otherwise(F.col("duration_ms")), "candidate_duration_ms": F.when(F.col("_now").isNull(), F.col("candidate_duration_ms"))}
    return done, moved.withColumns(columns).select(*assets.columns)


def stale_vectors(vectors: DataFrame, recipes: dict[str, tuple[str, str]]) -> DataFrame:
    """Vectors whose model or input version isn't that of their media kind. vectors: segment_id, media_kind, model_id, input_version."""
    models = F.create_map(*[F.lit(x) for k, (m, _) in recipes.items() for x in (k, m)])
    versions = F.create_map(*[F.lit(x) for k, (_, v) in recipes.items() for x in (k, v)])
    kind = F.col("media_kind")
    return vectors.filter((F.col("model_id") != F.try_element_at(models, kind)) | (F.col("input_version") != F.try_element_at(versions, kind)))


def missing_vectors(segments: DataFrame, assets: DataFrame, vectors: DataFrame, jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """New index jobs for servable segments (active, or of a running segmentation) of visible assets that have neither a vector nor a job."""
    rows = servable_segments(segments, runs, jobs).join(assets.filter(visible_ready()).select("asset_id"), "asset_id", "left_semi")
    rows = rows.join(vectors.select("segment_id"), "segment_id", "left_anti").join(jobs.filter(F.col("kind") == INDEX_JOB).select("segment_id"), "segment_id", "left_anti")
    return rows.select(F.sha2(F.concat_ws("|", F.lit(INDEX_JOB), "segment_id"), 256).alias("job_id"), "segment_id", "asset_id", F.lit(INDEX_JOB).alias("kind"), F.lit("pending").alias("status"))


def description_actions(rows: DataFrame) -> DataFrame:
    """What each segment's description needs, in this order: adopt, restore, requeue, enqueue, none.

    rows: segment_id, has_description, description_revision (null for legacy), evidence_revision,
    same_fingerprint, description_at, evidence_at, job_status (null without a job).
    """
    has, revision, now = F.col("has_description"), F.col("description_revision"), F.col("evidence_revision")
    adopt = has & revision.isNull() & F.col("same_fingerprint") & (F.col("description_at") >= F.col("evidence_at"))
    effective = F.when(adopt, now).otherwise(revision)
    current = F.coalesce(effective == now, F.lit(False)) & has
    job = F.col("job_status")
    action = (
        F.when(adopt & (job == "succeeded"), "adopt").when(current & job.isNotNull() & (job != "succeeded") & (job != "running"), "restore")
        .when(~current & job.isin("succeeded", "failed", "cancelled"), "requeue").when(~current & job.isNull(), "enqueue").otherwise("none")
    )
    return rows.withColumn("action", action)


def segmentation_actions(assets: DataFrame, runs: DataFrame, jobs: DataFrame, algorithm: str) -> DataFrame:
    """Per visible asset: keep, reset or enqueue its segmentation job.

    An asset needs work if it has a parked duration or no running or succeeded run of this algorithm and
    its fingerprint. Succeeded and cancelled jobs are reset; failed and pending ones only if algorithm or
    fingerprint changed. runs: asset_id, algorithm, fingerprint, status; jobs: asset_id, kind, status,
    algorithm, fingerprint; assets also: candidate_duration_ms.
    """
    good = runs.filter((F.col("algorithm") == algorithm) & F.col("status").isin("running", "succeeded")).select("asset_id", "fingerprint").distinct().withColumn("has_run", F.lit(True))
    job = jobs.filter(F.col("kind") == SEGMENT_JOB).groupBy("asset_id").agg(F.max(F.struct("updated_at", "status", "algorithm", "fingerprint")).alias("j"))
    rows = assets.filter(visible_ready()).join(good, ["asset_id", "fingerprint"], "left").join(job, "asset_id", "left")
    needs = F.col("candidate_duration_ms").isNotNull() | F.col("has_run").isNull()
    status = F.col("j.status")
    changed = (F.col("j.algorithm") != algorithm) | (F.col("j.fingerprint") != F.col("fingerprint"))
    action = F.when(~needs, "keep").when(status.isNull(), "enqueue").when(status.isin("succeeded", "cancelled"), "reset").when(status.isin("failed", "pending") & changed, "reset").otherwise("keep")
    return rows.select("asset_id", status.alias("job_status"), needs.alias("needs_work"), action.alias("action"))


def requeue(jobs: DataFrame, scope: DataFrame, kind: str, on: str = "asset_id") -> DataFrame:
    """Finished jobs of a kind within the scope become pending."""
    hit = scope.select(on).distinct().withColumn("_hit", F.lit(True))
    finished = F.col("status").isin("succeeded", "failed", "cancelled") & (F.col("kind") == kind) & F.coalesce("_hit", F.lit(False))
    return jobs.join(hit, on, "left").withColumn("status", F.when(finished, "pending").otherwise(F.col("status"))).select(*jobs.columns)


def retry_failed(jobs: DataFrame, kind: str) -> DataFrame:
    return jobs.withColumn("status", F.when((F.col("kind") == kind) & F.col("status").isin("failed", "cancelled"), "pending").otherwise(F.col("status")))


def recover_interrupted(jobs: DataFrame, kind: str) -> DataFrame:
    return jobs.withColumn("status", F.when((F.col("kind") == kind) & (F.col("status") == "running"), "pending").otherwise(F.col("status")))


def apply_events(jobs: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs after the latest valid event, rejected events). An event is valid if its job runs with the same attempt.

    events: event_id, job_id, attempt, new_status, message (cut to 2000), at.
    """
    target = jobs.select("job_id", F.col("status").alias("now"), F.col("attempt").alias("now_attempt"))
    rows = events.join(target, "job_id", "left").withColumn("valid", F.coalesce((F.col("now") == "running") & (F.col("attempt") == F.col("now_attempt")), F.lit(False)))
    last = rows.filter("valid").groupBy("job_id").agg(F.max_by(F.struct(F.col("new_status"), F.substring("message", 1, 2000).alias("message"), F.col("at")), F.struct("at", "event_id")).alias("e"))
    out = jobs.join(last, "job_id", "left").withColumns({"status": F.coalesce("e.new_status", "status"), "updated_at": F.coalesce("e.at", "updated_at"), "message": F.col("e.message")}).drop("e")
    return out, rows.filter(~F.col("valid")).select(*events.columns)


def null_safe_cohort(runs: DataFrame) -> DataFrame:
    """(run_id, sibling_id): runs of one asset and fingerprint that started and ended together; missing ends match.

    A cohort's rows meet through its smallest run, not pairwise.
    """
    keys = ["asset_id", "fingerprint", "started_at", "completed_at"]
    lead = runs.groupBy(*keys).agg(F.min("run_id").alias("lead"), F.count("*").alias("cohort")).filter("cohort > 1")
    on = [runs[k].eqNullSafe(lead[k]) for k in keys]
    return runs.join(lead, on).select(runs["run_id"], "lead", "cohort")


def relabel_models(rows: DataFrame, old: str, new: str, revision: Column) -> DataFrame:
    """Rows made with the old model and revision get the new label; parameters keep a note of the old one."""
    hit = (F.col("model_id") == old) & revision
    return rows.withColumns({"parameters": F.when(hit, json_set(F.col("parameters"), "relabelled_from", F.lit(old))).otherwise(F.col("parameters")), "model_id": F.when(hit, F.lit(new)).otherwise(F.col("model_id"))})


def relabel_inputs(rows: DataFrame, old: str, new: str, parts: list[Column]) -> DataFrame:
    """Rows whose `input_hash` is exactly that of the old model and `parts` get the new model and the hash made with it."""
    hit = (F.col("model_id") == old) & (F.col("input_hash") == recipe_hash(F.lit(old), *parts))
    return rows.withColumns({"input_hash": F.when(hit, recipe_hash(F.lit(new), *parts)).otherwise(F.col("input_hash")), "model_id": F.when(hit, F.lit(new)).otherwise(F.col("model_id"))})


def commit_descriptions(state: DataFrame, batch: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next descriptions, rejected rows): one per segment; a row whose fingerprint or evidence revision is no longer current is rejected.

    batch: segment_id, fingerprint, input_revision, ...; evidence: segment_id, fingerprint, revision.
    """
    now = evidence.select("segment_id", F.col("fingerprint").alias("_f"), F.col("revision").alias("_r"))
    rows = batch.join(now, "segment_id", "left").withColumn("_ok", F.coalesce((F.col("fingerprint") == F.col("_f")) & (F.col("input_revision") == F.col("_r")), F.lit(False)))
    good = rows.filter("_ok").select(*batch.columns)
    return state.join(good.select("segment_id"), "segment_id", "left_anti").unionByName(good), rows.filter(~F.col("_ok")).select(*batch.columns)


def requeue_descriptions(jobs: DataFrame, descriptions: DataFrame, scope: DataFrame, on: str = "segment_id") -> tuple[DataFrame, DataFrame]:
    """(jobs, descriptions): finished description jobs of the scope become pending, and its cached descriptions go."""
    return requeue(jobs, scope, DESCRIBE_JOB, on), descriptions.join(scope.select(on).distinct(), on, "left_anti")
