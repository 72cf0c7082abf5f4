"""Content-addressed WARC archive.

Every row becomes a WARC/1.1 record of its own. Payload bytes are stored once, under their SHA-256: the record
with the largest id of a payload is a `response` that carries the bytes, the others are `revisit` records that
refer to it. The exact header block of every record is kept in a table of its own, next to the digest, so
the full record of any row is rebuilt by one join of headers and payloads on the digest.

Layout of an archive folder: `rows/` numbers the rows (page_id, url, digests, length, uid), `headers/` is a
Parquet table (page_id, payload_sha256, record_type, header), `warc/` holds the WARC files: each record is a
gzip member of its own, followed by an empty member (EMPTY_MEMBER), which is how Spark's text writer, whose
line separator it is, can write them; readers of gzip skip it. A file ends after FILE_BYTES; reading unpacks one
record at a time and checks the digest of every payload.

Defined cases: a null payload is the empty payload; a null id is never preferred over a number; of several rows
with the largest id of a payload one is the response and the others revisit it, and so are rows of a payload
that only null ids have (with no id to refer to); a null url is written as `urn:page:<id>`; payloads below
`min_bytes` are always responses with bytes of their own; a long payload is one record and makes a file longer
by itself; an empty table gives an empty archive; further columns are ignored. Damaged files are errors that
name the place: a member cut short, a record without header end, Content-Length or record end.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timelore.llm.common import fresh_path

CRLF = "\r\n"
END = "\r\n\r\n"
FILE_BYTES = 1 << 24
READ_BYTES = 1 << 14
#: Fixed value: the gzip member of no bytes.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000002ff03000000000000000000")
#: Fixed value: WARC/1.1 names this profile for a revisit with an identical payload.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed value: base32


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a 40-digit hexadecimal SHA-1: five digits are 20 bits, so four letters."""
    def letters(i: Column) -> Column:
        v = F.conv(F.substring(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substring(F.lit(LETTERS), (F.shiftright(v, 15 - 5 * k).bitwiseAND(31)) + 1, F.lit(1)) for k in range(4)])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), letters), "")


def described(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, sha256, sha1, n of each row."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    return rows.withColumns({"sha256": F.sha2("payload", 256), "sha1": F.sha1(F.col("payload").cast("binary")), "n": F.octet_length("payload").cast("long")})


def header_block(kind: Column) -> Column:
    """The exact header of a row of page_id, uid, url, sha256, sha1, n, first_id, first_uid."""
    def name(page: str, uid: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("null")), F.lit(":"), F.col(uid).cast("string"), F.lit(">"))

    plain = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), name("page_id", "uid")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", plain), "[\\r\\n]", "")),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_of_hex(F.col("sha1"))),
        F.concat(F.lit("X-Payload-SHA256: "), F.col("sha256")),
        F.when(kind == "revisit", F.concat(F.lit("WARC-Refers-To: "), name("first_id", "first_uid"), F.lit(f"{CRLF}WARC-Profile: {REVISIT_PROFILE}"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(kind == "response", F.col("n")).otherwise(0)),
    ]
    return F.concat_ws(CRLF, *lines)


def records(rows: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One row for each record, without payload: page_id, payload_sha256, record_type, header. rows: described ones with uid."""
    firsts = rows.filter(F.col("n") >= min_bytes).groupBy("sha256").agg(F.max(F.struct("page_id", "uid")).alias("first"))
    firsts = firsts.select("sha256", F.col("first.page_id").alias("first_id"), F.col("first.uid").alias("first_uid"))
    own = (F.col("n") < min_bytes) | (F.col("uid") == F.col("first_uid"))
    kind = F.when(own, "response").otherwise("revisit")
    joined = rows.join(firsts.hint("merge"), "sha256", "left")
    return joined.select("page_id", F.col("sha256").alias("payload_sha256"), kind.alias("record_type"), header_block(kind).alias("header"))


def packed(records_: DataFrame) -> DataFrame:
    """(file, value) of (header, payload): the gzip member of each record, files of a task numbered by FILE_BYTES."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = size = 0
        for batch in batches:
            files, values = [], []
            for header, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = zlib.compressobj(6, zlib.DEFLATED, 31)
                values.append(c.compress(b"".join((header, END.encode(), payload or b"", END.encode()))) + c.flush())
                files.append(file)
                size += len(values[-1])
                if size >= FILE_BYTES:
                    file, size = file + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.int32()), pa.array(values, pa.binary())], ["file", "value"])

    return records_.mapInArrow(pack, "file int, value binary")


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> str:
    """Numbered rows, headers of all records, and the WARC files."""
    spark = pages.sparkSession
    described(pages).drop("payload").withColumn("uid", F.monotonically_increasing_id()).write.parquet(f"{path}/rows")
    records(spark.read.parquet(f"{path}/rows"), min_bytes).write.option("compression", "zstd").parquet(f"{path}/headers")
    headers = spark.read.parquet(f"{path}/headers").withColumn("header", F.col("header").cast("binary"))
    one = described(pages).groupBy("sha256").agg(F.first("payload").alias("payload")).toDF("payload_sha256", "payload")  # copies are combined before the shuffle
    responses = headers.filter("record_type = 'response'").join(one, "payload_sha256").select("header", F.col("payload").cast("binary").alias("payload"))
    revisits = headers.filter("record_type = 'revisit'").select("header", F.lit(b"").alias("payload"))
    body = packed(responses.unionByName(revisits)).withColumn("value", F.col("value").cast("string"))
    body.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).partitionBy("file").text(f"{path}/warc")
    return path


def members(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of each gzip member that isn't empty, one at a time."""
    at, view = 0, memoryview(content)
    while at < len(content):
        unpack, parts, start = zlib.decompressobj(31), [], at
        while not unpack.eof:
            if at >= len(content):
                raise ValueError(f"gzip member at byte {start} is cut short")
            piece = view[at : at + READ_BYTES]
            parts.append(unpack.decompress(piece))
            at += len(piece) - len(unpack.unused_data)
        if out := b"".join(parts):
            yield start, out


def parse_record(record: bytes, where: str) -> tuple[str, bytes]:
    """(header block, payload), by the record's Content-Length."""
    cut = record.find(b"\r\n\r\n")
    if cut < 0:
        raise ValueError(f"{where}: the header has no end")
    header = record[:cut].decode("utf-8")
    stated = [x.split(":", 1)[1].strip() for x in header.split(CRLF) if x.lower().startswith("content-length:")]
    if len(stated) != 1 or not stated[0].isdigit():
        raise ValueError(f"{where}: the record states no Content-Length")
    payload = record[cut + 4 : cut + 4 + int(stated[0])]
    if record[cut + 4 + int(stated[0]) :] != END.encode():
        raise ValueError(f"{where}: the record doesn't end after {stated[0]} bytes")
    return header, payload


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files: header, payload, and length and digests of the bytes as they were read."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows: list[tuple] = []
                for at, record in members(content.as_buffer()):
                    header, payload = parse_record(record, f"{name.as_py()}, byte {at}")
                    rows.append((header, payload, len(payload), hashlib.sha256(payload).hexdigest(), hashlib.sha1(payload).hexdigest()))
                    if len(rows) == 200:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(f"{path}/warc").select("path", "content")
    return files.mapInArrow(parse, "header string, payload binary, payload_bytes long, payload_sha256 string, payload_sha1 string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["header", "payload", "payload_bytes", "payload_sha256", "payload_sha1"])


def field(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """The distinct payloads, each verified: the digest of the bytes read is the one the record states."""
    stored = read_warc(spark, path).filter(field(F.col("header"), "WARC-Type") == "response")
    stated = field(F.col("header"), "X-Payload-SHA256")
    checked = F.when(stated == F.col("payload_sha256"), F.col("payload_sha256")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest: "), stated)))
    return stored.select(checked.alias("payload_sha256"), "payload_sha1", "payload_bytes", "payload")


def reconstruct(spark: SparkSession, path: str, with_record: bool = True) -> DataFrame:
    """Every record again: its header from the headers table, its full payload by the digest."""
    headers = spark.read.parquet(f"{path}/headers")
    stored = payloads(spark, path)
    one = stored if with_record else stored.drop("payload")
    one = one.dropDuplicates(["payload_sha256"])  # payloads below min_bytes are stored by each of their records
    full = headers.join(one.hint("merge"), "payload_sha256")
    head = F.col("header")
    refers = F.regexp_extract(F.coalesce(field(head, "WARC-Refers-To"), F.lit("")), "<urn:page:(-?\\d+):", 1)
    columns = {
        "page_id": F.col("page_id"),
        "payload_bytes": F.col("payload_bytes"),
        "payload_digest": base32_of_hex(F.col("payload_sha1")),
        "record_type": field(head, "WARC-Type"),
        "refers_to": F.when(refers != "", refers.cast("long")),
        "payload_sha256": F.col("payload_sha256"),
    }
    if with_record:
        columns["record"] = F.concat(head.cast("binary"), F.lit(END).cast("binary"), F.col("payload"), F.lit(END).cast("binary"))
    return full.select(*[c.alias(k) for k, c in columns.items()])


def archive_and_read(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write the archive of `pages`, read it back, and describe every reconstructed record."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_archive(pages, path, min_bytes)
    return reconstruct(spark, path, with_record=False)
