"""Best-fit packing of documents into sequences of bounded length by swap-based local search.

A document's token ids, with the end id, are cut only where they exceed `capacity`: into pieces of that many, of which
the first may be shorter. Pieces of full length are sequences as they are; every document has at most one shorter
piece. These are packed:

- They are dealt into groups of about GROUP_ITEMS by a hash. A group starts from best fit in falling order of length.
- Local search in each group: the bin with the least fill gives to the others, in exchange for nothing (a move), one
  of its documents or two for one of theirs, or one for two of theirs. Of all exchanges that the other bin has room
  for, the one that increases the sum of squared fills most is made, until the bin is empty or has no exchange; then
  the next bin. Sweeps over the bins go on while one of them empties a bin; PATIENCE failures in a row end a sweep.
- Full bins are done. Bins that aren't are dealt anew into groups, whole, by another hash, and searched again: as long
  as a round does away with more than one in ENOUGH of them and they could still be fewer.

So no task holds more than a group, and a round moves a few numbers for each document in a bin that isn't full. Ids are
encoded and written once, and are not moved.

The encoder. For a byte-level vocabulary without a normaliser, the library's own cuts fall before each single blank,
and around each single line feed, between two characters that aren't white space. So runs between such places are
encoded by the library once, and remembered; texts of other vocabularies are encoded whole.

Defined cases: a null text is the empty text, and gives the end id alone; a null doc_id is kept; rows with one doc_id
are documents each; very long texts give as many pieces as they need; an empty table stays empty; further columns are
ignored. Sequence numbers are any numbers: the smallest `slot` (row of the written pieces) in the sequence.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelore.llm.common import fresh_path, materialise, shuffle_partitions
from timelore.llm.token_codes import RUN_OVERHEAD, chunks

CAPACITY = 2_048
GROUP_ITEMS = 2_048
ENOUGH = 1_000
PATIENCE = 64

# ---------------------------------------------------------------- tokens

#: Bytes that end, or begin, a character that isn't white space in UTF-8, as far as one byte tells.
_ENDS = rb"[!-~\x8b-\x9e\xa1-\xa7\xaa-\xae\xb0-\xbf]"
_BEGINS = rb"[!-~\xc3-\xdf\xe0\xe4-\xf4]"
_TWO = rb"[\xc3-\xdf][\x80-\xbf]"  # no white space has two bytes but those that begin with C2
_BLANK, _LINE = (re.compile(c + b"(?:(?<=" + _ENDS + c + b")|(?<=" + _TWO + c + b"))(?=" + _BEGINS + b")") for c in (b" ", b"\n"))
#: Bytes of visible ASCII, blanks, line feeds, and of the two-byte characters that begin with C3, which are no white space.
_USUAL = bytes([0x0A, 0x20, 0xC3, *range(0x21, 0x7F), *range(0x80, 0xC0)])
#: Letters of Latin alphabets alone: one cut of the library's pattern. ASCII signs but the apostrophe after them: the next one.
_WORD = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
_SIGNS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'")
#: Text that an encoder's known runs may take, with RUN_OVERHEAD each.
KNOWN_BYTES = 1 << 28


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: visible Latin-1 characters as they are, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(0x100 + i) for i, b in enumerate(hidden)}


def cut_runs(text: bytes) -> list[list[bytes]]:
    """Lines of runs: the text is cut at single blanks and single line feeds between two characters that aren't white space."""
    if not text.translate(None, _USUAL) and text[:1] not in (b" ", b"\n", b"") and text[-1:] not in (b" ", b"\n") and not any(x in text for x in (b"  ", b" \n", b"\n ", b"\n\n")):
        return [line.split(b" ") for line in text.split(b"\n")]
    return [_BLANK.split(line) for line in _LINE.split(text)]


class Runs(dict):
    """ids of runs that stand after `lead`, worked out when first asked for."""

    def __init__(self, encoder: RunEncoder, lead: str):
        super().__init__()
        self.encoder, self.lead = encoder, lead

    def __missing__(self, run: bytes) -> bytes:
        encoder = self.encoder
        stem = run.rstrip(_SIGNS)
        if not (stem.isalpha() or _WORD.fullmatch(stem.decode(errors="replace"))):
            ids = encoder.whole(self.lead + run.decode(errors="replace"))
        elif len(stem) < len(run):
            ids = self[stem] + encoder.after(run[len(stem) :])
        else:
            ids = encoder.cut(self.lead, run)
        self[run] = ids
        encoder.known_bytes += len(run) + RUN_OVERHEAD
        return ids


class RunEncoder:
    """ids of whole texts, as `Tokenizer.encode(text, add_special_tokens=False)` gives them.

    All ids come from the library: those of a word from its model, those of other runs from the whole tokenizer.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        spec = json.loads(tokenizer_json)
        cut = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens", [])
        plain_added = all(not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]) and not re.search(r"\s", x["content"]) and not _WORD.fullmatch(x["content"].rstrip(_SIGNS.decode())) for x in added) and sys.byteorder == "little" and array("I").itemsize == 4
        self.by_run = spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and plain_added and not spec["model"].get("dropout")
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.forget()

    def forget(self) -> None:
        self.first, self.later = Runs(self, ""), Runs(self, " ")  # at the start of a line, and after a blank
        self.signs: dict[bytes, bytes] = {}
        self.known_bytes = 0

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def cut(self, lead: str, text: bytes) -> bytes:
        """ids of one cut of the library's pattern, from its model."""
        shown = text.decode() if text.isascii() else text.decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(self.letters[0x20] + shown if lead else shown)]).tobytes()

    def after(self, signs: bytes) -> bytes:
        if signs not in self.signs:
            self.signs[signs] = self.cut("", signs)
        return self.signs[signs]

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        """ids of each text (UTF-8), as little-endian unsigned 32-bit numbers."""
        if not self.by_run:
            return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast([x.decode(errors="replace") for x in texts], add_special_tokens=False)]
        if self.known_bytes > KNOWN_BYTES:
            self.forget()
        first, later, feed = self.first, self.later.__getitem__, self.whole("\n")
        out = []
        for text in texts:
            out.append(feed.join([b"".join([first[line[0]], *map(later, line[1:])]) for line in cut_runs(text)]))
        return out


_ENCODERS: dict[int, RunEncoder] = {}


def run_encoder(tokenizer_json: str) -> RunEncoder:
    """One encoder for each worker process and vocabulary."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = RunEncoder(tokenizer_json)
    return _ENCODERS[key]


PIECES = "doc_id long, slot long, piece int, start long, length long, ids binary, ids_crc32 long"


def write_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """PIECES of all documents, written to the shared folder; ids are little-endian unsigned 32-bit numbers."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())  # a fixed file of a few MB
    tail = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = run_encoder(vocabulary.value)
        slot = TaskContext.get().partitionId() << 40
        for batch in batches:
            for docs_, texts in chunks(batch):
                rows = []
                for doc, code in zip(docs_, coder.encode_many(texts), strict=True):
                    code += tail
                    n = len(code) // 4
                    first = n - (n - 1) // capacity * capacity
                    for piece, stop in enumerate(range(first, n + 1, capacity)):
                        start = max(0, stop - capacity)
                        ids = code[4 * start : 4 * stop]
                        rows.append((doc, slot, piece, start, stop - start, ids, zlib.crc32(ids)))
                        slot += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    path = fresh_path(spark, "pieces")
    texts.mapInArrow(cut, PIECES).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(PIECES).parquet(path)


_PIECES = pa.schema([("doc_id", pa.int64()), ("slot", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64())])


# ---------------------------------------------------------------- local search


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: longest first, each into the fullest bin that has room."""
    out = np.empty(len(sizes), np.int64)
    room: list[tuple[int, int]] = []
    n = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(room, (size, -1))
        if at == len(room):
            left, b, n = capacity, n, n + 1
        else:
            left, b = room.pop(at)
        out[i] = b
        if left > size:
            insort(room, (left - size, b))
    return out


class Bins:
    """Items in bins, and the exchanges between them."""

    def __init__(self, sizes: np.ndarray, bins: np.ndarray, capacity: int):
        self.sizes, self.bins, self.capacity = np.asarray(sizes, np.int64), np.array(bins, np.int64), capacity
        self.fill = np.bincount(self.bins, weights=self.sizes).astype(np.int64)

    def offers(self, a: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, ...]]]:
        """(sums in order, single or pair behind each) of what bin a can give."""
        own = np.flatnonzero(self.bins == a)
        i, j = np.triu_indices(len(own), 1)
        sums = np.concatenate([self.sizes[own], self.sizes[own[i]] + self.sizes[own[j]]])
        values, at = np.unique(sums, return_index=True)
        behind = np.concatenate([np.column_stack([own, np.full(len(own), -1)]), np.column_stack([own[i], own[j]])])[at]
        return values, behind, own

    def exchange(self, a: int) -> bool:
        """The best exchange that brings bin a nearer to empty; whether there is one."""
        values, behind, own = self.offers(a)
        open_ = self.fill < self.capacity
        open_[a] = False
        open_ &= self.fill > 0
        others = np.flatnonzero(open_)
        items = np.flatnonzero(open_[self.bins])
        taken = np.concatenate([np.zeros(len(others), np.int64), self.sizes[items]])
        home = np.concatenate([others, self.bins[items]])
        best = self._best(a, values, taken, home)
        if best is None:
            first, second, sums, pair_home = self._pairs(others)
            best = self._best(a, self.sizes[own], sums, pair_home)
            if best is None:
                return False
            at, v = best
            give, take, b = [own[v]], [first[at], second[at]], pair_home[at]
        else:
            at, v = best
            give, take, b = [x for x in behind[v] if x >= 0], [] if at < len(others) else [items[at - len(others)]], home[at]
        self.bins[give], self.bins[take] = b, a
        moved = self.sizes[give].sum() - self.sizes[take].sum()
        self.fill[a] -= moved
        self.fill[b] += moved
        return True

    def _best(self, a: int, values: np.ndarray, taken: np.ndarray, home: np.ndarray) -> tuple[int, int] | None:
        """(place in `taken`, place in `values`) of the exchange that increases the squared fills most."""
        if not len(taken):
            return None
        order = np.argsort(values, kind="stable")
        ordered = values[order]
        fill = self.fill[home]
        at = np.searchsorted(ordered, taken + self.capacity - fill, side="right") - 1
        moved = np.where(at >= 0, ordered[np.maximum(at, 0)] - taken, 0)
        gain = np.where(moved > 0, moved * (fill - self.fill[a] + moved), 0)
        best = int(gain.argmax())
        return (best, int(order[at[best]])) if gain[best] > 0 else None

    def _pairs(self, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of items that share one of the other bins."""
        wanted = np.zeros(len(self.fill), bool)
        wanted[others] = True
        own = np.flatnonzero(wanted[self.bins])
        own = own[np.argsort(self.bins[own], kind="stable")]
        first, second = [own[:0]], [own[:0]]
        for apart in range(1, len(own)):  # at most as many steps as a bin has items
            same = self.bins[own[apart:]] == self.bins[own[:-apart]]
            if not same.any():
                break
            first.append(own[:-apart][same])
            second.append(own[apart:][same])
        one, two = np.concatenate(first), np.concatenate(second)
        return one, two, self.sizes[one] + self.sizes[two], self.bins[one]

    def search(self) -> None:
        """Sweeps over the bins, least fill first, while a sweep empties one and there may be fewer.

        A sweep ends after PATIENCE bins in a row that could not be emptied.
        """
        least = -(-int(self.sizes.sum()) // self.capacity)
        while (before := int((self.fill > 0).sum())) > least:
            seen: set[int] = set()
            failed = 0
            while failed < PATIENCE and int((self.fill > 0).sum()) > least:
                waiting = [b for b in np.flatnonzero((self.fill > 0) & (self.fill < self.capacity)).tolist() if b not in seen]
                if not waiting:
                    break
                a = min(waiting, key=lambda b: (self.fill[b], b))
                seen.add(a)
                while self.fill[a] and self.exchange(a):
                    pass
                failed = failed + 1 if self.fill[a] else 0
            if int((self.fill > 0).sum()) == before:
                break


# ---------------------------------------------------------------- Spark

PLACED = "slot long, length long, sequence_id long, offset long, head boolean, open boolean"
_PLACED = pa.schema([("slot", pa.int64()), ("length", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("head", pa.bool_()), ("open", pa.bool_())])


def searched(items: DataFrame, groups: int, turn: int, capacity: int) -> DataFrame:
    """PLACED of items (slot, length, sequence_id) after local search in `groups` groups of whole bins."""

    def solve(slot: np.ndarray, length: np.ndarray, sequence: np.ndarray) -> pa.RecordBatch:
        if turn == 0:
            bins = best_fit(length, capacity)
        else:
            bins = np.unique(sequence, return_inverse=True)[1]
        state = Bins(length, bins, capacity)
        state.search()
        order = np.lexsort((slot, state.bins))
        slot, length, bins = slot[order], length[order], state.bins[order]
        head = np.append(True, bins[1:] != bins[:-1])
        begin = np.flatnonzero(head)[np.cumsum(head) - 1]
        before = np.cumsum(length) - length
        columns = [slot, length, slot[begin], before - before[begin], head, state.fill[bins] < capacity]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PLACED, strict=True)], schema=_PLACED)

    def each_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [c.to_numpy() for c in batch.columns]
            held = now if held is None else [np.concatenate([x, y]) for x, y in zip(held, now, strict=True)]
            cuts = np.flatnonzero(held[0][1:] != held[0][:-1]) + 1
            for x, y in zip([0, *cuts[:-1].tolist()], cuts.tolist()):
                yield solve(*[c[x:y] for c in held[1:]])
            if len(cuts):
                held = [c[cuts[-1] :] for c in held]
        if held is not None and len(held[0]):
            yield solve(*held[1:])

    n = shuffle_partitions(items.sparkSession)
    group = F.pmod(F.xxhash64("sequence_id", F.lit(turn)), F.lit(groups)).alias("group")
    dealt = items.select(group, "slot", "length", "sequence_id").repartition(n, "group").sortWithinPartitions("group", "slot")
    return dealt.mapInArrow(each_group, PLACED)


def place(pieces: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(slot, sequence_id, offset) of the pieces (slot, length) that are shorter than the capacity."""
    items = pieces.filter(F.col("length") < capacity).select("slot", "length", F.col("slot").alias("sequence_id"))
    totals = F.count("*").alias("items"), F.sum("length").alias("tokens"), F.sum(F.col("head").cast("int")).alias("bins")
    done = None
    count, before, turn = items.count(), None, 0
    while True:
        found = materialise(searched(items, max(1, -(-count // group_items)), turn, capacity), "placed")
        now = found.filter("open").agg(*totals).first()
        full = found.filter("not open")
        fewer = before is None or before - (now["bins"] or 0) - full.filter("head").count() > before // ENOUGH
        last = not now["items"] or not fewer or count <= group_items or now["bins"] <= -(-now["tokens"] // capacity)
        part = found if last else full
        done = part if done is None else done.unionByName(part)
        if last:
            return done.select("slot", "sequence_id", "offset")
        items = found.filter("open").select("slot", "length", "sequence_id")
        count, before, turn = now["items"], now["bins"], turn + 1


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, group_items: int = GROUP_ITEMS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The written pieces (PIECES) with the sequence and the place in it of each."""
    pieces = write_pieces(docs, tokenizer_path, capacity, end_id, text_col, id_col)
    return pieces.join(place(pieces, capacity, group_items), "slot", "left").withColumns({"sequence_id": F.coalesce("sequence_id", "slot"), "offset": F.coalesce("offset", F.lit(0))})


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids of whole sequences; a sequence is at most one capacity long."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    joined = F.aggregate("parts", F.lit(b""), lambda ids, p: F.concat(ids, p["ids"]))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("n_tokens"), joined.alias("ids"))
