"""Domain tables as views over the given tables: one set of expressions, rendered for Spark and for DuckDB.

`days(x)` is the number of days since 1970 of a timestamp, `millis(x)` the milliseconds since 1970.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Each engine's spelling of the functions that differ.
DIALECT = {
    "spark": {"days": r"unix_date(cast(\1 as date))", "millis": r"(unix_micros(cast(\1 as timestamp)) div 1000)"},
    "duckdb": {"days": r"date_diff('day', date '1970-01-01', cast(\1 as date))", "millis": r"(epoch_us(\1) // 1000)"},
}


def rendered(text: str, engine: str) -> str:
    for name, form in DIALECT[engine].items():
        text = re.sub(rf"\b{name}\((\w+)\)", form, text)
    return text


@dataclass(frozen=True)
class View:
    source: str
    columns: dict[str, str]
    where: str | None = None
    group: tuple[str, ...] = ()

    def sql(self) -> str:
        picks = ", ".join(f"{rendered(e, 'duckdb')} as {n}" for n, e in self.columns.items())
        return f"select {picks} from {self.source}" + (f" where {self.where}" if self.where else "") + (f" group by {', '.join(self.group)}" if self.group else "")

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{self.source}.parquet")
        if self.where:
            rows = rows.where(self.where)
        picks = [F.expr(rendered(e, "spark")).alias(n) for n, e in self.columns.items()]
        return rows.groupBy(*self.group).agg(*picks).select(*self.columns) if self.group else rows.select(*picks)


_IMAGE = "o_orderkey % 5 = 0"
_READY = "case when o_orderstatus = 'P' and o_orderkey % 3 = 0 then 'missing' else 'ready' end"
_DURATION = "case when o_orderkey % 5 = 0 then cast(1000 as bigint) else (o_orderkey * 7919) % 1500000 end"

VIEWS: dict[str, View] = {
    "library_root": View(
        "nation",
        {
            "root_id": "cast(n_nationkey as bigint)", "path": "n_name", "processing_rank": "cast((n_nationkey * 7) % 25 as bigint)", "created_at": "cast((n_nationkey * 13) % 10 as double)",
            "last_scan_at": "case when n_nationkey % 6 = 5 then null else cast(n_nationkey as double) * 1000 end",
        },
    ),
    "media_asset": View(
        "orders",
        {
            "asset_id": "o_orderkey", "root_id": "o_custkey % 25", "relative_path": "concat(o_orderpriority, '/IMG_', cast(o_orderkey as string), '.mp4')",
            "file_identifier": "case when o_orderkey % 17 = 0 then null else concat('f', cast(o_orderkey as string)) end", "file_size": "cast(floor(o_totalprice) as bigint)",
            "modification_time": "cast(days(o_orderdate) as double) * 86400", "media_kind": f"case when {_IMAGE} then 'image' else 'video' end", "duration_ms": _DURATION, "status": _READY,
            "is_excluded": "o_orderkey % 37 = 0", "invalidated_at": f"case when {_READY} = 'missing' then cast(days(o_orderdate) as double) else null end",
            "first_seen_at": "cast((o_orderkey * 31) % 1000 as double)", "fingerprint": "concat('fp', cast(o_orderkey % 9973 as string))",
        },
    ),
    "segment": View(
        "lineitem",
        {
            "segment_id": "concat(cast(l_orderkey as string), ':', cast(l_linenumber as string))", "asset_id": "l_orderkey", "ordinal": "cast(l_linenumber as bigint)",
            "start_ms": "cast(l_linenumber - 1 as bigint) * 20000", "end_ms": "cast(l_linenumber as bigint) * 20000",
            "segmentation_version": "case when max(l_linestatus) = 'O' then cast(2 as bigint) else cast(1 as bigint) end", "is_active": "max(l_linestatus) = 'O'",
            "run_id": "concat(cast(l_orderkey as string), '@', max(l_linestatus))",
        },
        group=("l_orderkey", "l_linenumber"),
    ),
    "job": View(
        "lineitem",
        {
            "job_id": "concat(cast(l_orderkey as string), ':', cast(l_linenumber as string), ':', min(l_returnflag))", "asset_id": "l_orderkey",
            "segment_id": "concat(cast(l_orderkey as string), ':', cast(l_linenumber as string))", "ordinal": "cast(l_linenumber as bigint)",
            "kind": "case min(l_returnflag) when 'A' then 'segment_asset' when 'N' then 'index_segment' else 'describe_segment' end",
            "status": "case min(l_suppkey) % 5 when 0 then 'pending' when 1 then 'running' when 2 then 'succeeded' when 3 then 'failed' else 'cancelled' end",
            "attempt": "min(l_suppkey) % 4", "updated_at": "cast(max(days(l_shipdate)) as double)", "stage": "case min(l_partkey) % 3 when 0 then 'extract' when 1 then 'embed' else 'commit' end",
            "fingerprint": "concat('fp', cast(l_orderkey % 9973 as string))",
        },
        group=("l_orderkey", "l_linenumber"),
    ),
    "evidence": View(
        "documents",
        {
            "evidence_seq": "doc_id", "segment_id": "cast(floor(doc_id / 4) as bigint)", "evidence_type": "case doc_id % 3 when 0 then 'visual' when 1 then 'transcript' else 'ocr' end", "text": "text",
            "start_ms": "(doc_id % 40) * 1000", "end_ms": "(doc_id % 40) * 1000 + 900",
        },
    ),
    "search_segment": View(
        "embeddings",
        {
            "segment_id": "vec_id", "asset_id": "cast(vec_id % 60 as bigint)", "path": "concat('Clip ', cast(vec_id % 60 as string), '.mp4')", "start_ms": "vec_id * 1000", "end_ms": "vec_id * 1000 + 20000",
            "model_id": "concat('m', cast(label % 2 as string))", "input_version": "concat('v', cast(vec_id % 3 as string))", "visible": "vec_id % 19 <> 0",
        },
    ),
    "description": View(
        "documents",
        {
            "segment_id": "doc_id % 250", "description_id": "doc_id", "run_id": "doc_id % 7", "created_at": "cast(doc_id as double)", "summary": "text", "lang": "lang", "source": "source",
            "model_id": "concat('d', cast(doc_id % 3 as string))", "prompt_version": "concat('p', cast(doc_id % 4 as string))",
        },
    ),
    "boundary": View(
        "events",
        {
            "boundary_id": "event_id", "asset_id": "user_id", "time_ms": "millis(ts) - 1704067200000", "kind": "event_type", "score": "value / 500",
        },
    ),
    "turn": View("conversations", {"segment_id": "conv_id", "ordinal": "turn", "role": "role", "text": "text"}),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return VIEWS[name].frame(spark, sf_dir)


def with_views(body: str) -> str:
    """`body` with a common table expression for each view that it names."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", body)]
    if not used:
        return body
    heads = ", ".join(f"{n} as ({VIEWS[n].sql()})" for n in used)
    body = body.strip()
    if body[:15].lower() == "with recursive ":
        return f"with recursive {heads}, {body[15:]}"
    if body[:5].lower() == "with ":
        return f"with {heads}, {body[5:]}"
    return f"with {heads} {body}"
