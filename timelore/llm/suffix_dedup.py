"""Exact removal of repeated byte strings by column-wise multi-document suffix construction.

Every byte covered by a string of `length` bytes that also starts earlier (in a document with a smaller id,
or earlier in the same one) is removed. Strings are judged on the input.

The collection. A text is cut into pieces: maximal runs of string starts whose smallest 32-byte hash (the
piece's fingerprint) is the same, cut after RUN starts; a piece covers all its strings, at most
RUN + length - 1 bytes. Equal strings have equal fingerprints, so they only meet within a fingerprint.
Equal pieces (by 192 bits: the fingerprint and two hashes of all grams) are combined first, within a batch before
the shuffle, then within the fingerprint: all but the earliest are removed whole. A fingerprint with one piece, whose fingerprint occurs once in it, has no
repeated string. The remaining distinct pieces are the documents of the construction.

The construction (`collection_bwt`). All pieces of a block stand right-aligned; in each round one symbol of
every piece is inserted: the suffixes one longer than the last round's get their place by the rank of their
symbol in the Burrows-Wheeler transform so far, and the longest common prefixes with their neighbours are
one more than the least common prefix between the two occurrences of the symbol. Transform, prefixes and
suffix numbers are arrays that each round reads and rewrites front to back, as sequential files would be;
they stay in the task's memory, since a block is bounded (BLOCK_BYTES) and tasks may not use a machine's own
folders. Runs of common prefixes of at least `length` are the repeated strings; of each, the earliest stays.

The rows of a fingerprint are read in order and never held together; one with more than GROUP_PIECES distinct
pieces is dealt to several blocks as it is read. Each block then hands
the hash and earliest place of its strings of such fingerprints to one aggregation, which removes all but
the earliest.

Defined cases: null and empty texts have no bytes; texts shorter than `length` lose nothing; texts of any
length are worked through in parts; rows with one doc_id, or with null ids (which come first), are different
documents, ordered by hash of the text; an empty table stays empty; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelore.llm.common import materialise, shuffle_partitions

LENGTH = 100
GRAM = 32
RUN = LENGTH - GRAM + 1  # the most starts that one place of a fingerprint can serve
CHUNK_BYTES = 1 << 17
SLICE_BYTES = 1 << 23
BLOCK_BYTES = 1 << 19
GROUP_PIECES = 4_096

_U = np.uint64
_RNG = np.random.default_rng(11)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_ODD = _RNG.integers(0, 1 << 63, 16, dtype=np.uint64) * _U(2) + _U(1)


# ---------------------------------------------------------------- the construction


def collection_bwt(pieces: list[bytes], cap: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(transform, common prefixes up to cap, piece, suffix length) of all suffixes in sorted order.

    The transform holds 1 + byte, and 0 at the suffix that is a whole piece. common[r] is the length that
    suffixes r - 1 and r share. Equal suffixes stand in the order of their pieces. Pieces and cap are below
    256 bytes. A suffix is one number: piece, length, common prefix and symbol, so that a round rewrites one
    sequence.
    """
    m = len(pieces)
    size = np.array([len(p) for p in pieces], np.int64)
    data = np.frombuffer(b"".join(pieces) + b"\0", np.uint8)
    end = np.cumsum(size)
    used = np.unique(data)
    if len(used) > 255 or size.max(initial=0) > 255 or cap > 255:
        raise ValueError("more than 255 symbols, or a piece of more than 255 bytes")
    code = np.zeros(256, np.uint8)
    code[used] = np.arange(1, len(used) + 1)
    data = code[data]

    def suffix(piece: np.ndarray, length: int, shared: np.ndarray) -> np.ndarray:
        """The numbers of suffixes of one length; the symbol is the one before the suffix."""
        there = size[piece] > length
        symbol = np.where(there, data[np.where(there, end[piece] - length - 1, 0)], 0).astype(np.uint64)
        return symbol | shared.astype(np.uint64) << _U(8) | _U(length << 16) | piece.astype(np.uint64) << _U(24)

    rows = suffix(np.arange(m), 0, np.zeros(m, np.int64))
    fresh = np.ones(m, bool)
    for j in range(int(size.max(initial=0))):
        symbols = rows.astype(np.uint8)
        order = symbol_ranks(symbols)
        n_ended = len(symbols) - int(np.count_nonzero(symbols))
        grown = n_ended + np.flatnonzero(fresh[order[n_ended:]])
        if not len(grown):
            break
        row = order[grown]
        bytes_of = rows.view(np.uint8)
        common = bytes_of[1::8] if sys.byteorder == "little" else bytes_of[6::8]

        def shared(left: np.ndarray) -> np.ndarray:
            """Common prefix of the extensions of order[left] and order[left + 1]; 0 where the symbol changes."""
            a, b = order[np.maximum(left, 0)], order[np.minimum(left + 1, len(order) - 1)]
            same = (left >= 0) & (left + 1 < len(order)) & (symbols[a] == symbols[b])
            out = np.zeros(len(left), np.int64)
            if same.any():
                bounds = np.column_stack([a[same] + 1, b[same] + 1]).ravel()
                padded = np.append(common, np.uint8(0))
                out[same] = np.minimum(np.minimum.reduceat(padded, bounds)[::2].astype(np.int64) + 1, cap)
            return out

        with_left, with_right = shared(grown - 1), shared(grown)
        place = m + grown - n_ended
        fresh = np.zeros(len(rows) + len(row), bool)
        fresh[place] = True
        merged = np.empty(len(fresh), np.uint64)
        merged[~fresh] = rows
        merged[place] = suffix((rows[row] >> _U(24)).astype(np.int64), j + 1, with_left)
        inside = place + 1 < len(merged)
        after = place[inside] + 1
        merged[after] = merged[after] & _U(0xFFFFFFFFFFFF00FF) | with_right[inside].astype(np.uint64) << _U(8)
        rows = merged
    spelled = np.append(0, used.astype(np.int16) + 1)
    return spelled[rows.astype(np.uint8)], (rows >> _U(8)).astype(np.uint8), (rows >> _U(24)).astype(np.int64), (rows >> _U(16)).astype(np.uint8).astype(np.int64)


def symbol_ranks(symbols: np.ndarray) -> np.ndarray:
    """Places by symbol, then by place: where in this order a place stands is the rank of its symbol's occurrence."""
    if len(symbols) >= 1 << 24:
        return np.argsort(symbols, kind="stable")
    keys = symbols.astype(np.uint32) << np.uint32(24) | np.arange(len(symbols), dtype=np.uint32)
    keys.sort()
    return (keys & np.uint32(0xFFFFFF)).astype(np.int64)


def repeated_strings(common: np.ndarray, piece: np.ndarray, length: np.ndarray, at_least: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, piece, suffix length) of the suffixes of at least that length, equal strings in one class."""
    keep = length >= at_least
    new = (common < at_least) & keep
    return (np.cumsum(new) - 1)[keep], piece[keep], length[keep]


# ---------------------------------------------------------------- pieces of texts


def _windowed(values: np.ndarray, width: int, best) -> np.ndarray:
    """best over values[i : i + width], by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    if have < width:
        rest = width - have
        out = best(out[: len(out) - rest], out[rest:])
    return out


def _grams(data: np.ndarray) -> np.ndarray:
    h, have, k = _BYTE[data], 1, 0
    while have < GRAM:
        h = h[:-have] * _ODD[k] + h[have:]
        have, k = have * 2, k + 1
    h = (h ^ (h >> _U(31))) * _ODD[14]
    return h ^ (h >> _U(29))


def cut_pieces(data: np.ndarray, stops: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(fingerprint, two content hashes, first start, starts, whether the fingerprint may occur twice) of the pieces.

    `data` holds texts one after another, `stops` the end of each.
    """
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.uint64, np.int64, np.int64, bool))
    grams = _grams(data)
    width = length - GRAM + 1
    least = _windowed(grams, width, np.minimum)[:n]
    text = np.searchsorted(stops, np.arange(n), side="right") if len(stops) > 1 else np.zeros(n, np.int64)
    valid = np.arange(n) + length <= stops[text]
    change = np.ones(n, bool)
    change[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, n))
    use = valid[first]
    first, count = first[use], count[use]
    parts = -(-count // RUN)
    within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(first, parts) + within * RUN
    count = np.minimum(np.repeat(count, parts) - within * RUN, RUN)
    last = start + count - 1 + length - GRAM
    content, second = count.astype(np.uint64), ~count.astype(np.uint64)
    for t in range(-(-(RUN + length) // GRAM)):
        gram = grams[np.minimum(start + GRAM * t, last)]
        content = (content ^ (content >> _U(32))) * _ODD[13] + gram
        second = (second ^ (second >> _U(27))) * _ODD[10] ^ gram
    content, second = ((x ^ (x >> _U(32))) * _ODD[12] for x in (content, second))
    content ^= content >> _U(29)
    second ^= second >> _U(31)
    # places of grams that are the least of some string, and those with an equal one shortly before
    pad = np.zeros(width - 1, np.uint64)
    reach = _windowed(np.concatenate([pad, least, pad]), width, np.maximum)[: len(grams)]
    chosen = np.flatnonzero(reach == grams[: len(reach)])
    order = np.lexsort((chosen, grams[chosen]))
    by = chosen[order]
    close = np.zeros(len(grams) + 1, np.int64)
    twice = (grams[by[1:]] == grams[by[:-1]]) & (by[1:] - by[:-1] < RUN + length)
    close[by[1:][twice] + 1] = 1
    close = np.cumsum(close)
    several = close[last + 1] > close[start]
    return least[start], content, second, start, count, several


def text_parts(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, stops, text number, offset in the text) of runs of texts; long texts in overlapping parts."""
    held: list[bytes] = []
    numbers: list[int] = []
    offsets: list[int] = []
    size = 0

    def out():
        return np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(x) for x in held]), np.array(numbers), np.array(offsets)

    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), CHUNK_BYTES):
            part = text[at : at + CHUNK_BYTES + length - 1]
            if len(part) < length:
                continue
            held.append(part)
            numbers.append(i)
            offsets.append(at)
            size += len(part)
            if size >= CHUNK_BYTES:
                yield out()
                held, numbers, offsets, size = [], [], [], 0
    if held:
        yield out()


def _first_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by the keys, the first key leading; whether each row in that order begins a new triple of the first three)."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys[:3]])
    return order, new


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, about SLICE_BYTES of text at a time."""
    sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
    cuts = [0, *(np.flatnonzero(np.diff(sizes // SLICE_BYTES)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


OCCURRENCE = "mark long, content long, second long, doc long, start long, count int, several boolean, gone boolean"


def occurrences(texts: DataFrame) -> DataFrame:
    """Pieces of (doc, text); of equal pieces of a batch only the earliest stays open, the others are gone."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            docs = batch.column(0).to_numpy()
            data = batch.column(1).to_pylist()
            found = []
            for chunk, stops, number, offset in text_parts(data):
                mark, content, second, start, count, several = cut_pieces(chunk, stops)
                text = np.searchsorted(stops, start, side="right")
                begin = np.concatenate([[0], stops[:-1]])[text]
                found.append((mark, content, second, docs[number[text]], start - begin + offset[text], count, several))
            if not found:
                continue
            mark, content, second, doc, start, count, several = (np.concatenate(x) for x in zip(*found))
            order, new = _first_of(mark, content, second, doc, start)
            mark, content, second, doc, start, count, several = (x[order] for x in (mark, content, second, doc, start, count, several))
            mark = np.where(new, mark, (doc.astype(np.uint64) + start.astype(np.uint64)) * _ODD[11])  # what is gone is dealt out evenly
            columns = [mark.view(np.int64), content.view(np.int64), second.view(np.int64), doc, start, count.astype(np.int32), several, ~new]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["mark", "content", "second", "doc", "start", "count", "several", "gone"])

    return texts.mapInArrow(cut, OCCURRENCE)


JUDGED = "piece boolean, mark long, salt int, shared boolean, doc long, start long, count int"


def judged(found: DataFrame, partitions: int, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Starts that are gone (piece false), and the distinct pieces that the construction has to look at.

    The rows of a fingerprint come one after another. Only the earliest of equal pieces goes on; at most
    2 * group_pieces of them are held.
    """

    def groups(mark, doc, start, count, several, before: int) -> Iterator[pa.RecordBatch]:
        """Of distinct pieces of whole fingerprints; `before` pieces of the first one have been handed on already."""
        first = np.append(True, mark[1:] != mark[:-1])
        group = np.cumsum(first) - 1
        earlier = np.where(group == 0, before, 0)
        kinds = np.bincount(group)[group] + earlier
        place = np.arange(len(group)) - np.flatnonzero(first)[group] + earlier
        at = np.flatnonzero((kinds > 1) | several)
        if len(at):
            yield _judged(True, mark[at], (place // group_pieces)[at], (kinds > group_pieces)[at], doc[at], start[at], count[at])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before, last = None, 0, None
        for batch in batches:
            mark, content, second, doc, start, count, several, gone = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            new = np.ones(len(mark), bool)
            live = np.flatnonzero(~gone)
            key = [x[live] for x in (mark, content, second)]
            if len(live):
                new[live[1:]] = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
                new[live[0]] = last != tuple(k[0] for k in key)
                last = tuple(k[-1] for k in key)
            copies = gone | ~new
            if copies.any():
                yield _judged(False, mark[copies], 0, False, doc[copies], start[copies], count[copies])
            now = [x[~copies] for x in (mark, doc, start, count, several)]
            held = now if held is None else [np.concatenate([a, b]) for a, b in zip(held, now, strict=True)]
            if not len(held[0]):
                continue
            cut = int(np.searchsorted(held[0], held[0][-1], side="left"))  # the last fingerprint may go on in the next batch
            if cut:
                yield from groups(*[x[:cut] for x in held], before)
                held, before = [x[cut:] for x in held], 0
            if (many := len(held[0]) // group_pieces * group_pieces) > group_pieces or before and many:
                part = [x[:many] for x in held]
                yield _judged(True, part[0], (before + np.arange(many)) // group_pieces, True, *part[1:4])
                held, before = [x[many:] for x in held], before + many
        if held is not None and len(held[0]):
            yield from groups(*held, before)

    dealt = found.repartition(partitions, "mark").sortWithinPartitions("mark", "content", "second", "doc", "start")
    return dealt.mapInArrow(judge, JUDGED)


def _judged(piece: bool, mark, salt, shared, doc, start, count) -> pa.RecordBatch:
    n = len(mark)
    columns = [np.full(n, piece), mark, np.broadcast_to(salt, n).astype(np.int32), np.broadcast_to(shared, n), doc, start, count.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], ["piece", "mark", "salt", "shared", "doc", "start", "count"])


def piece_texts(pieces: DataFrame, texts: DataFrame) -> DataFrame:
    """The pieces with their bytes, from the whole texts."""
    wanted = pieces.groupBy("doc").agg(F.collect_list(F.struct("mark", "salt", "shared", "start", "count")).alias("at"))
    schema = pa.schema([("mark", pa.int64()), ("salt", pa.int32()), ("shared", pa.bool_()), ("doc", pa.int64()), ("start", pa.int64()), ("bytes", pa.binary())])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, at in zip(*batch.columns, strict=True):
                doc, text, at = doc.as_py(), text.as_py(), at.as_py()
                rows = [(x["mark"], x["salt"], x["shared"], doc, x["start"], text[x["start"] : x["start"] + x["count"] + LENGTH - 1]) for x in at]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return texts.join(wanted, "doc").select("doc", "text", "at").mapInArrow(fetch, "mark long, salt int, shared boolean, doc long, start long, bytes binary")


FOUND = "gone boolean, doc long, start long, count int, string binary"


def constructed(pieces: DataFrame, partitions: int) -> DataFrame:
    """Runs of starts that are gone (gone true), and the earliest places of the strings of shared fingerprints with their hash."""

    def block(rows: list[tuple]) -> pa.RecordBatch:
        texts = [r[4] for r in rows]
        _, common, piece, length = collection_bwt(texts)
        cls, piece, length = repeated_strings(common, piece, length)
        size = np.array([len(x) for x in texts])
        doc = np.array([r[2] for r in rows], np.int64)[piece]
        offset = size[piece] - length
        start = np.array([r[3] for r in rows], np.int64)[piece] + offset
        shared = np.array([r[1] for r in rows], bool)[piece]
        order = np.lexsort((start, doc, cls))
        first = np.ones(len(order), bool)
        first[1:] = cls[order][1:] != cls[order][:-1]
        gone, open_ = order[~first], order[first & shared[order]]
        strings = [hashlib.blake2b(texts[piece[i]][offset[i] : offset[i] + LENGTH], digest_size=16).digest() for i in open_]
        gone = gone[np.lexsort((start[gone], doc[gone]))]
        begins = np.flatnonzero(np.append(True, (doc[gone][1:] != doc[gone][:-1]) | (start[gone][1:] != start[gone][:-1] + 1))) if len(gone) else np.zeros(0, np.int64)
        runs, sizes = gone[begins], np.diff(np.append(begins, len(gone)))
        columns = [np.repeat([True, False], [len(runs), len(open_)]), np.concatenate([doc[runs], doc[open_]]), np.concatenate([start[runs], start[open_]]), np.concatenate([sizes, np.ones(len(open_), np.int64)]).astype(np.int32)]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([None] * len(runs) + strings, pa.binary())], ["gone", "doc", "start", "count", "string"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for mark, salt, shared, doc, start, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if size >= BLOCK_BYTES and (mark, salt) != last:
                    yield block(rows)
                    rows, size = [], 0
                rows.append((mark, shared, doc, start, data))
                size += len(data)
                last = (mark, salt)
        if rows:
            yield block(rows)

    dealt = pieces.repartition(partitions, "mark", "salt").sortWithinPartitions("mark", "salt", "doc", "start")
    return dealt.mapInArrow(build, FOUND)


RESULT = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removed(texts: DataFrame, gone: DataFrame) -> DataFrame:
    """The figures of every document, from the starts that are gone: (doc, start, count)."""
    by_doc = gone.groupBy("doc").agg(F.collect_list(F.struct("start", "count")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, at in zip(batch.column(1), batch.column(2), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                if not at.is_valid:
                    rows.append((len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                    continue
                start = at.values.field("start").to_numpy()
                stop = np.minimum(start + at.values.field("count").to_numpy() - 1 + LENGTH, len(data))
                edges = np.bincount(start, minlength=len(data) + 1)[: len(data) + 1] - np.bincount(stop, minlength=len(data) + 1)
                out = np.cumsum(edges)[:-1] > 0
                spans = int(out[0]) + int((out[1:] & ~out[:-1]).sum())
                rows.append((len(data), int(out.sum()), spans, hashlib.sha256(data[~out]).hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return texts.join(by_doc, "doc", "left").select("doc", "text", "at").mapInArrow(cut, RESULT)


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """((doc, text as bytes), None); where ids repeat or are null, doc is a place in the order and the second table gives its doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    plain = not docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count()
    if plain:
        return rows.withColumnRenamed("doc_id", "doc"), None
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id", tie).sortWithinPartitions("doc_id", tie)
    placed = materialise(ordered.withColumn("doc", F.monotonically_increasing_id()), "placed")
    return placed.select("doc", "text"), placed.select("doc", "doc_id")


def dedup(docs: DataFrame, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    n = shuffle_partitions(docs.sparkSession)
    texts, names = numbered(docs)
    first = materialise(judged(occurrences(texts), n, group_pieces), "pieces")
    built = materialise(constructed(piece_texts(first.filter("piece"), texts), n), "strings")
    open_ = built.filter("not gone")
    earliest = open_.groupBy("string").agg(F.min(F.struct("doc", "start")).alias("least"))
    late = open_.join(earliest, "string").filter(F.struct("doc", "start") > F.col("least"))
    gone = first.filter("not piece").select("doc", "start", "count")
    for more in (built.filter("gone"), late):
        gone = gone.unionByName(more.select("doc", "start", "count"))
    out = removed(texts, gone)
    if names is None:
        return out.withColumnRenamed("doc", "doc_id")
    return out.join(names, "doc").drop("doc").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
