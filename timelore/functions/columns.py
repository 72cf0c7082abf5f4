"""Column expressions of the domain: buckets, timecodes, snippets, scores, hashes. All stay in the JVM."""

from __future__ import annotations

import hashlib
import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The extensions that count as media.
VIDEO_EXTENSIONS = ("3gp", "avi", "m2ts", "m4v", "mkv", "mov", "mp4", "mts", "webm")
IMAGE_EXTENSIONS = ("avif", "heic", "heif", "jpeg", "jpg", "png", "tif", "tiff", "webp")
NOMINAL_IMAGE_MS = 1_000

_MARKED = [chr(c) for c in range(0xC0, 0x250) if (d := unicodedata.normalize("NFD", chr(c))) != chr(c) and chr(c).islower()]
_ACCENTED, _BASE = "".join(_MARKED), "".join(unicodedata.normalize("NFD", c)[0] for c in _MARKED)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z alone."""
    return F.translate(text, _UPPER, _LOWER)


def visible_ready() -> Column:
    """An asset that can be served."""
    return (F.col("status") == "ready") & F.col("invalidated_at").isNull() & ~F.col("is_excluded")


def media_kind(extension: Column) -> Column:
    e = F.lower(extension)
    return F.when(e.isin(*VIDEO_EXTENSIONS), "video").when(e.isin(*IMAGE_EXTENSIONS), "image")


def duration_bucket(ms: Column) -> Column:
    """[0, 30 s), [30 s, 5 min), [5 min, 20 min), and all else."""
    return F.when((ms >= 0) & (ms < 30_000), "under30s").when((ms >= 30_000) & (ms < 300_000), "under5m").when((ms >= 300_000) & (ms < 1_200_000), "under20m").otherwise("over20m")


def progress_bucket() -> Column:
    """Of a row of processing summaries: work in progress, then failures, then waiting work, then completeness."""
    seg = F.coalesce(F.col("segmentation_status"), F.lit(""))
    running = (seg == "running") | F.col("evidence_running") | F.col("describe_running")
    failed = seg.isin("failed", "cancelled") | (F.col("evidence_failed") > 0) | (F.col("describe_failed") > 0)
    waiting = (seg == "pending") | (F.col("evidence_pending") > 0) | (F.col("describe_pending") > 0)
    total = F.col("total_segments")
    complete = (F.col("evidence_succeeded") >= total) & (F.col("describe_succeeded") >= total)
    return F.when(total.isNull(), "notStarted").when(running, "inProgress").when(failed, "failed").when(waiting, "waiting").when(total == 0, "notStarted").when(complete, "completed").otherwise("waiting")


def timecode(ms: Column) -> Column:
    """h:mm:ss, or mm:ss below an hour."""
    s = F.floor(ms / 1000)
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def snippet(text: Column, most: int) -> Column:
    flat = F.trim(F.regexp_replace(text, r"[\r\n]", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def natural_key(path: Column) -> Column:
    """Lower case with runs of digits padded to 12, so that 2 sorts before 10."""
    runs = F.regexp_extract_all(F.lower(path), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 12, "0")).otherwise(x)), "")


def recipe_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def derivation_id(model: Column, transport: Column, url: Column) -> Column:
    return F.concat(model, F.lit("@"), F.substring(F.sha2(F.concat_ws("\n", transport, url, model), 256), 1, 16))


def literal_relevance(rank: Column) -> Column:
    """9 / (9 + rank) for a rank from 0; 0 without one."""
    return F.when(rank.isNull(), 0.0).otherwise(9.0 / (rank + 9.0))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def combined_relevance(literal: Column, semantic: Column) -> Column:
    return 0.65 * clamp01(literal) + 0.35 * clamp01(F.coalesce(semantic, F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double, in index order."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def clamped_dot(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))


def l2_normalised(v: Column) -> Column:
    """The vector at length 1; left as it is within a thousandth, null if not finite or zero."""
    norm = F.sqrt(dot(v, v))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (norm > 0)
    return F.when(sound, F.when(F.abs(norm - 1) > 1e-3, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(v.cast("array<double>")))


def occurrences(text: Column, term: str) -> Column:
    """Overlapping occurrences of a lower-case term in a lower-case text, in one pass."""
    quoted = "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.regexp_count(text, F.lit(f"(?={quoted})"))


def hamming64(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def average_hash(luma: Column) -> Column:
    """Bit i is set if pixel i is at least the integer mean, of 64 pixels."""
    mean = F.floor(F.aggregate(luma, F.lit(0).cast("long"), lambda s, x: s + x) / 64)
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.get(luma, i) >= mean, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def luma_histogram(luma: Column) -> Column:
    """Shares of 16 bins of 16 levels."""
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda b: F.size(F.filter(luma, lambda p: F.floor(p / 16) == b)) / F.size(luma))


def visual_difference(a: Column, b: Column, ha: Column, hb: Column) -> Column:
    """min(1, 0.65 mean |pixel change| / 255 + 0.35 half the histogram change)."""
    def total(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.abs(p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, d: s + d)

    return F.least(F.lit(1.0), 0.65 * total(a, b) / F.size(a) / 255 + 0.35 * 0.5 * total(ha, hb))


def normalised_text(text: Column) -> Column:
    """Without case, accents and white space, for equality of read texts: base letters by decomposition, marks dropped."""
    flat = F.lower(F.regexp_replace(text, r"(?U)\s", ""))
    return F.translate(flat, _ACCENTED, _BASE)


def algorithm_version(family: str, parameters: dict) -> str:
    """`family-` and 12 hex digits of the SHA-256 over the parameters as JSON with sorted keys."""
    canonical = json.dumps(parameters, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return f"{family}-{hashlib.sha256(canonical.encode()).hexdigest()[:12]}"


def json_valid(text: Column) -> Column:
    """Whether the text is JSON; false for null."""
    return F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False))


def iou(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Intersection over union of (x, y, width, height) boxes."""
    w = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    shared = F.when((w > 0) & (h > 0), w * h).otherwise(0.0)
    whole = a[2] * a[3] + b[2] * b[3] - shared
    return F.when(whole > 0, shared / whole).otherwise(0.0)


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def split_sentences(text: Column) -> Column:
    """Trimmed sentences; a mark of 。！？!?；; or a line end closes one, a full stop doesn't."""
    return F.filter(F.transform(F.split(text, r"(?<=[。！？!?；;\n])"), trimmed), lambda x: x != "")


#: The languages of the aligner and their codes; a name in lower case means itself.
ALIGNER_LANGUAGES = {
    "zh": "Chinese", "yue": "Cantonese", "en": "English", "fr": "French", "de": "German", "it": "Italian", "ja": "Japanese", "ko": "Korean", "pt": "Portuguese", "ru": "Russian", "es": "Spanish",
}


def aligner_language(code: Column) -> Column:
    names = ALIGNER_LANGUAGES | {n.lower(): n for n in ALIGNER_LANGUAGES.values()} | {"mandarin": "Chinese"}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.try_element_at(table, F.lower(code))


def json_set(text: Column, key: str, value: Column) -> Column:
    """A flat JSON object of strings with one key set."""
    old = F.coalesce(F.from_json(text, "map<string,string>"), F.expr("map()").cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, _: k != key)
    return F.to_json(F.map_concat(kept, F.create_map(F.lit(key), value.cast("string"))))


def epoch_seconds(x: Column) -> Column:
    """A timestamp of REAL epoch seconds; 0 and null are absent."""
    return F.timestamp_micros(F.round(F.nullif(x, F.lit(0.0)) * 1_000_000).cast("long"))
