"""Token ids as directly addressable codes (DAC).

An id is cut into 8-bit chunks, lowest first. Level 0 holds one chunk for every token; a bit of the
level's continuation bitmap says whether the token goes on in level 1, and the rank of that bit (the
number of set bits before it) is its place there. A rank directory keeps the rank at every 512th bit,
so `Block.access(i)` reaches any token by at most one chunk, one directory entry and one 64-byte count
per level; nothing else is decoded.

File format: a Parquet folder, uncompressed, so that a code stands in the file as it is. One row for each
block of whole documents, in ascending doc_id order: `part` (file order), `seq` (block in the part),
`local_start` (tokens before the block in its part), `n_tokens`, `doc_ids`, `doc_tokens` (ids of each
document), and `levels`, `bitmaps`, `ranks` (one binary for each level). `tokens_at` finds the block of any
token number by an equi-join on ranges of numbers, and reads the token there by `access`.

Defined cases: a null text is the empty text; an empty text gives the end id alone; a null doc_id sorts
first; rows with one doc_id keep one order (by hash of the text) and are encoded each; a very long text is
encoded whole and makes a block of its own size; further columns are ignored; an empty table gives an empty
archive. `tokens_at`: null numbers and those outside the archive give no row, repeated ones a row each.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelore.llm.common import fresh_path, shuffle_partitions

RANK_EVERY = 512
BLOCK_TOKENS = 1 << 18
BATCH_BYTES = 1 << 21
#: How much text of runs an encoder remembers, with so much counted for each run besides.
KNOWN_BYTES, RUN_OVERHEAD = 1 << 26, 150

BLOCK_SCHEMA = (
    "part int, seq int, local_start long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, "
    "levels array<binary>, bitmaps array<binary>, ranks array<binary>"
)


# ---------------------------------------------------------------- codes


class Block:
    """Directly addressable codes of one array of ids."""

    def __init__(self, n: int, levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes]):
        self.n, self.levels, self.bitmaps, self.ranks = n, levels, bitmaps, ranks

    @classmethod
    def encode(cls, ids: np.ndarray) -> Block:
        rest = np.ascontiguousarray(ids, dtype=np.uint32)
        levels, bitmaps, ranks = [], [], []
        while True:
            levels.append((rest & 0xFF).astype(np.uint8).tobytes())
            rest = rest >> 8
            more = rest > 0
            packed = np.packbits(more, bitorder="little")
            per = np.add.reduceat(more.astype(np.uint32), np.arange(0, len(more), RANK_EVERY)) if len(more) else np.zeros(0, np.uint32)
            bitmaps.append(packed.tobytes())
            ranks.append((np.cumsum(per) - per).astype("<u4").tobytes())
            rest = rest[more]
            if not len(rest):
                return cls(len(ids), levels, bitmaps, ranks)

    def access(self, i: int) -> int:
        """The id at place i, without decoding its neighbours."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, level in enumerate(self.levels):
            value |= level[i] << (8 * k)
            bits = self.bitmaps[k]
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            base = i // RANK_EVERY
            rank = int.from_bytes(self.ranks[k][4 * base : 4 * base + 4], "little")
            lead = bits[base * RANK_EVERY // 8 : i >> 3]
            rank += int.from_bytes(lead, "little").bit_count()
            i = rank + (bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
        return value

    def decode(self) -> np.ndarray:
        out = np.frombuffer(self.levels[0], np.uint8).astype("<u4")
        at = None
        for k in range(1, len(self.levels)):
            here = len(self.levels[k - 1])
            on = np.flatnonzero(np.unpackbits(np.frombuffer(self.bitmaps[k - 1], np.uint8), count=here, bitorder="little"))
            at = on if at is None else at[on]
            out[at] |= np.frombuffer(self.levels[k], np.uint8).astype(np.uint32) << np.uint32(8 * k)
        return out


# ---------------------------------------------------------------- tokens

#: A run that NFC and lower-casing leave as it is, without the "<" of special tokens: ASCII without A-Z, and U+00DF to U+00FF.
PLAIN = re.compile(rb"(?:[!-;=-@\[-~]|\xc3[\x9f-\xbf])*")


class TextEncoder:
    """ids of whole texts, as `Tokenizer.encode(text, add_special_tokens=False)` gives them.

    All ids come from the library. For a vocabulary that drops white space (`by_run`), the ids of a text are
    those of its runs between ASCII blanks one after another: nothing in the library's pipeline reaches across
    a blank. So each distinct run is encoded once and remembered. The new runs of a batch are encoded in one
    call, as one text in which a token of its own stands between them; the library cuts a text at such tokens
    before anything else. As the vocabulary's normaliser writes lower case, A-Z are lowered first wherever that
    can't change what the normaliser does, and runs of plain lower-case letters (PLAIN) skip it, as it leaves
    them as they are. All texts of other vocabularies are encoded one by one.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import AddedToken, Tokenizer

        self.tokenizer_json = tokenizer_json
        spec = json.loads(tokenizer_json)
        kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        drops_blanks = [x.get("type") for x in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and steps[0]["pattern"]["Regex"].endswith("[^\\s\\p{L}\\p{N}]+")
        self.by_run = kinds == ["NFC", "Replace", "Lowercase"] and drops_blanks
        if self.by_run:
            self.cutter = Tokenizer.from_str(tokenizer_json)
            self.plain_cutter = Tokenizer.from_str(json.dumps(spec | {"normalizer": None}))
            for t in (self.cutter, self.plain_cutter):
                t.add_tokens([AddedToken("\n", normalized=False)])
        self.forget()

    @cached_property
    def tokenizer(self):
        """The library's tokenizer as it is."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.tokenizer_json)

    def forget(self) -> None:
        """Lets go of what is remembered."""
        self.known: dict[bytes, bytes] = {}
        self.known_bytes = 0

    def _learn(self, runs: set[bytes]) -> None:
        self.known_bytes += sum(map(len, runs)) + RUN_OVERHEAD * len(runs)
        plain = list(filter(PLAIN.fullmatch, runs))
        for cutter, some in ((self.plain_cutter, plain), (self.cutter, list(runs.difference(plain)))):
            if some:
                ids = np.array(cutter.encode_batch_fast([b"\n".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
                stops = 4 * np.append(np.flatnonzero(ids == cutter.token_to_id("\n")), len(ids))
                code = ids.tobytes()
                self.known.update(zip(some, [code[a:b] for a, b in zip([0, *(stops[:-1] + 4).tolist()], stops.tolist(), strict=True)], strict=True))

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        """ids of each text (UTF-8), as little-endian unsigned 32-bit numbers."""
        if not self.by_run:
            return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)]
        runs = [lowered(x).split() for x in texts]
        if self.known_bytes > KNOWN_BYTES:
            self.forget()
        if new := set().union(*runs).difference(self.known):
            self._learn(new)
        ids_of = self.known.__getitem__
        return [b"".join(map(ids_of, x)) for x in runs]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_many([text.encode()])[0], "<u4")


def lowered(text: bytes) -> bytes:
    """The text with a-z for A-Z, or as it is where that could change a special token or what NFC composes."""
    if b"<" in text:
        return text
    low = text.lower()
    if text.isascii() or unicodedata.is_normalized("NFC", text.decode()) and unicodedata.is_normalized("NFC", low.decode()):
        return low
    return text


_ENCODERS: dict[int, TextEncoder] = {}


def encoder(tokenizer_json: str) -> TextEncoder:
    """One encoder for each worker process and vocabulary."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = TextEncoder(tokenizer_json)
    return _ENCODERS[key]


# ---------------------------------------------------------------- Spark


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[bytes]]]:
    """The rows of a batch, about BATCH_BYTES of text at a time."""
    sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(sizes // BATCH_BYTES)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            part = batch.slice(a, b - a)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()


def encode_blocks(docs: DataFrame, tokenizer_path: str, end_id: int = 1, text_col: str = "text", id_col: str = "doc_id", forget: bool = False) -> DataFrame:
    """Blocks of BLOCK_SCHEMA, documents in ascending order of id over parts and blocks.

    `forget`: a worker lets go of the encoder's memory after each task, for jobs whose other stages use the same
    workers; the ids are the same.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())  # a fixed file of a few MB
    tail = int(end_id).to_bytes(4, "little")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary.value)
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        ids: list[int] = []
        counts: list[int] = []
        held: list[bytes] = []

        def out() -> pa.RecordBatch:
            nonlocal seq, before, ids, counts, held
            block = Block.encode(np.frombuffer(b"".join(held), "<u4"))
            row = [[part], [seq], [before], [block.n], [ids], [counts], [block.levels], [block.bitmaps], [block.ranks]]
            seq, before = seq + 1, before + block.n
            ids, counts, held = [], [], []
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _ARROW, strict=True)], schema=_ARROW)

        size = 0
        for batch in batches:
            for docs_, texts in chunks(batch):
                for doc, code in zip(docs_, coder.encode_many(texts), strict=True):
                    ids.append(doc)
                    counts.append(len(code) // 4 + 1)
                    held += [code, tail]
                    size += counts[-1]
                    if size >= BLOCK_TOKENS:
                        size = 0
                        yield out()
        if ids:
            yield out()
        if forget:
            coder.forget()

    n = shuffle_partitions(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    tie = F.xxhash64("text")
    return texts.repartitionByRange(n, F.col("doc"), tie).sortWithinPartitions("doc", tie).mapInArrow(blocks, BLOCK_SCHEMA)


_ARROW = pa.schema(
    [
        ("part", pa.int32()), ("seq", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())),
        ("levels", pa.list_(pa.binary())), ("bitmaps", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary())),
    ]
)


def write_archive(docs: DataFrame, path: str, tokenizer_path: str, **options) -> str:
    encode_blocks(docs, tokenizer_path, **options).write.option("compression", "none").parquet(path)
    return path


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with `start`, the number of tokens before the block in the whole archive.

    The only total order needed is over parts, of which there is one for each task that wrote; their totals
    are small enough to go to every task, so the blocks themselves aren't shuffled again.
    """
    blocks = spark.read.parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    firsts = parts.select("part", F.expr("coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0)").alias("part_start"))
    return blocks.join(F.broadcast(firsts), "part").withColumn("start", F.col("part_start") + F.col("local_start"))


def documents_of(archive: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row for each document, decoded from its block: doc_id, start, n_tokens, ids_crc32 (and ids).

    The first and the middle id of every document are also read by direct access and must be the decoded ones.
    """
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids
    schema = pa.schema(fields)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row["n_tokens"], row["levels"], row["bitmaps"], row["ranks"])
                ids = block.decode()
                ends = np.cumsum(row["doc_tokens"])
                starts = ends - row["doc_tokens"]
                spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
                for i in (i for a, b in spans for i in (a, (a + b) // 2)):
                    if block.access(i) != ids[i]:
                        raise ValueError(f"token {row['start'] + i}: direct access and decoding differ")
                columns = [row["doc_ids"], row["start"] + starts, row["doc_tokens"], [zlib.crc32(ids[a:b]) for a, b in spans]]
                if with_ids:
                    columns.append([ids[a:b] for a, b in spans])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    kept = archive.select("start", "n_tokens", "doc_ids", "doc_tokens", "levels", "bitmaps", "ranks")
    return kept.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def tokens_at(archive: DataFrame, numbers: DataFrame, column: str = "token") -> DataFrame:
    """(token, id) of token numbers in the whole archive, by direct access; no block is decoded.

    A block covers few ranges of BLOCK_TOKENS numbers, so numbers and blocks meet in an equi-join on the range;
    only then the codes of the blocks that are asked for are read, once each.
    """
    width = F.lit(BLOCK_TOKENS)
    asked = numbers.select(F.col(column).cast("long").alias("token")).filter("token >= 0").withColumn("range", F.floor(F.col("token") / width))
    last = F.col("start") + F.col("n_tokens") - 1
    directory = archive.filter("n_tokens > 0").select("part", "seq", "start", last.alias("last"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(last / width))).alias("range"))
    found = asked.join(directory, "range").filter(F.col("token").between(F.col("start"), F.col("last")))
    wanted = found.groupBy("part", "seq", "start").agg(F.collect_list("token").alias("tokens"))
    rows = archive.join(wanted.drop("start"), ["part", "seq"]).select("start", "n_tokens", "levels", "bitmaps", "ranks", "tokens")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row["n_tokens"], row["levels"], row["bitmaps"], row["ranks"])
                yield pa.RecordBatch.from_arrays([pa.array(row["tokens"], pa.int64()), pa.array([block.access(t - row["start"]) for t in row["tokens"]], pa.int64())], ["token", "id"])

    return rows.mapInArrow(pick, "token long, id long")


def encode_and_read(docs: DataFrame, tokenizer_path: str, path: str | None = None, **options) -> DataFrame:
    """Write the archive and read every document back from its files."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    write_archive(docs, path, tokenizer_path, **options)
    return documents_of(read_archive(spark, path))
