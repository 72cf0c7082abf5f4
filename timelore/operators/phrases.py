"""Where the texts of a batch of queries stand in rows of text, in one scan of the rows.

The different texts of a block of queries (TERM_BLOCK at most) form a trie of UTF-8 bytes, which each task builds for
itself. A task's rows lie one after the other in a buffer; all their places go down the trie together, a byte at a time,
and those that fall off are left out. So a row costs its bytes and what it holds, however many queries there are, and
rows are not moved.

`every` gives all (query text, row); `best` only what can be among the best rows of a text, and how many rows hold it:
a task keeps the `most` best of its rows for each text, so what leaves it does not grow with its rows.

Texts of three characters and more ignore case; shorter ones fold A-Z only, and are not counted (f = 0). Rows of ASCII
alone are read once for both; others as they are in lower case for the former, and as they are for the latter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from timelore.functions.columns import ascii_lower
from timelore.sources import shared

MIN_LONG = 3
#: Different texts that are looked for in one scan.
TERM_BLOCK = 1 << 15
#: Bytes of rows that go down the trie together.
WINDOW = 1 << 18
#: Entries of a trie's table; larger tries are searched.
TABLE = 1 << 22
#: Rows that a task holds at most before it hands on the best so far.
HELD_ROWS = 1 << 20
#: BM25's k1 and b.
K1, B = 1.2, 0.75
#: Of weights, as numpy and the JVM may round otherwise.
SLACK = 1e-9
_TEXTS = ("_ascii", "_low", "_plain")

Term = tuple[int, bool, bytes]  # lead, is_long, text as it is looked for
Hits = tuple[np.ndarray, np.ndarray, np.ndarray]  # row, term, times


class Trie:
    """Different byte strings, none empty. Node 0 is the root; nodes are numbered by depth, parent and byte. A-Z are read as a-z."""

    def __init__(self, terms: list[bytes]):
        flat = np.frombuffer(b"".join(terms), np.uint8)
        self.sizes = np.array([len(t) for t in terms], np.int64)
        starts = np.cumsum(self.sizes) - self.sizes
        used = np.unique(flat)
        self.width = len(used) + 1
        self.number = np.zeros(256, np.uint8 if self.width <= 256 else np.uint16)
        self.number[used] = np.arange(1, self.width)
        node, alive, depth, edges = np.zeros(len(terms), np.int64), np.arange(len(terms)), 0, [np.zeros(0, np.int64)]
        count = 1
        while len(alive):
            new, which = np.unique(node[alive] * self.width + self.number[flat[starts[alive] + depth]], return_inverse=True)
            node[alive] = count + which
            edges.append(new)
            count += len(new)
            depth += 1
            alive = alive[self.sizes[alive] > depth]
        self.number[65:91] = self.number[97:123]
        self.edges = np.concatenate(edges)
        self.term = np.full(count, -1, np.int32)
        self.term[node] = np.arange(len(terms))
        self.longest = depth
        self.table = None
        if count * self.width <= TABLE:
            self.table = np.zeros(count * self.width, np.int32)
            self.table[self.edges] = np.arange(1, count)
        first = self.step(np.zeros(self.width, np.int64), np.arange(self.width))
        pairs = self.step(np.repeat(first, self.width), np.tile(np.arange(self.width), self.width))
        self.pairs = np.where(np.repeat(first, self.width) > 0, pairs, 0).astype(np.int32 if self.table is not None else np.int64)
        self.begun = self.pairs > 0
        self.code = np.uint16 if self.width <= 256 else np.int32
        self.single = self.term[first] if (self.term[first] >= 0).any() else None  # the root has no term

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The nodes below; 0 where there is none."""
        key = node * self.width + byte
        if self.table is not None:
            return self.table[key]
        at = np.searchsorted(self.edges, key)
        return np.where(self.edges[np.minimum(at, len(self.edges) - 1)] == key, at + 1, 0)

    def occurrences(self, data: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(place after begin, term) of what starts from begin up to end; data goes on as far as it may reach."""
        n = end - begin
        own = data[begin : end + self.longest]
        ids = np.zeros(n + self.longest + 1, self.number.dtype)
        ids[: len(own)] = self.number[own]
        found = []
        if self.single is not None:
            term = self.single[ids[:n]]
            at = np.flatnonzero(term >= 0)
            found.append((at, term[at]))
        code = ids[:n].astype(self.code)
        code *= self.code(self.width)
        code += ids[1 : n + 1]
        at = np.flatnonzero(self.begun[code]).astype(np.int32)
        node, depth = self.pairs[code[at]], 2
        while len(at):
            term = self.term[node]
            whole = np.flatnonzero(term >= 0)
            if len(whole):
                found.append((at[whole], term[whole]))
            if depth == self.longest:
                break
            node = self.step(node, ids[at + depth])
            on = node > 0
            at, node, depth = at[on], node[on], depth + 1
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return np.concatenate([a for a, _ in found]), np.concatenate([t for _, t in found])

    def counted(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[Hits]:
        """Hits of rows, which lie in data from one offset to the next."""
        row, rows, terms = 0, len(offsets) - 1, len(self.sizes)
        window = max(WINDOW, self.longest)
        while row < rows:
            last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + window, "right")) - 1)
            here, codes = data[: offsets[last]], []
            lengths = np.diff(offsets[row : last + 1])
            for begin in range(int(offsets[row]), int(offsets[last]), window):  # several of a row longer than a window
                at, term = self.occurrences(here, begin, min(begin + window, int(offsets[last])))
                if last - row > 1:
                    owner = np.repeat(np.arange(last - row, dtype=np.int32), lengths)[at]
                    inside = at + begin + self.sizes[term] <= offsets[row + 1 + owner]
                    owner, term = owner[inside], term[inside]
                    codes.append(np.unique(owner.astype(np.int64) * terms + term, return_counts=True))
                else:  # data ends with the row
                    codes.append(np.unique(term.astype(np.int64), return_counts=True))
            if len(codes) > 1:
                code, which = np.unique(np.concatenate([c for c, _ in codes]), return_inverse=True)
                codes = [(code, np.bincount(which, np.concatenate([n for _, n in codes])).astype(np.int64))]
            for code, times in codes:
                if len(code):
                    yield code // terms + row, code % terms, times
            row = last


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a column of byte strings; null is empty."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    return np.frombuffer(data or b"", np.uint8), np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def finder(terms: list[Term]) -> Callable[[pa.RecordBatch], Iterator[Hits]]:
    """What gives the hits of a batch of rows with the columns _TEXTS; built where it is first used."""
    made: list[tuple[Trie, np.ndarray]] = []

    def hits(batch: pa.RecordBatch) -> Iterator[Hits]:
        if not made:
            for kinds in ((True, False), (True,), (False,)):
                own = [i for i, t in enumerate(terms) if t[1] in kinds]
                made.append((Trie([terms[i][2] for i in own]), np.array(own, np.int64)))
        for name, (trie, own) in zip(_TEXTS, made, strict=True):
            if len(own) and len(batch):
                for row, term, times in trie.counted(*_bytes(batch.column(name))):
                    yield row, own[term], times

    return hits


def _read(evidence: DataFrame, terms: list[Term], *kept: Column) -> DataFrame:
    """Rows with a text, as `finder` reads them."""
    plain = F.octet_length("text") == F.length("text")
    raw = F.col("text").cast("binary")
    long_, short = any(t[1] for t in terms), any(not t[1] for t in terms)
    nothing = F.lit(None).cast("binary")
    texts = F.when(plain, raw), F.when(~plain, F.lower("text").cast("binary")) if long_ else nothing, F.when(~plain, raw) if short else nothing
    return evidence.filter("text is not null").select(*kept, *[c.alias(n) for c, n in zip(texts, _TEXTS, strict=True)])


# ---------------------------------------------------------------- terms of queries


def asked_terms(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of trimmed (query_id, query): the different texts (lead, is_long, term), and (lead, query_id) of all queries."""
    long_ = F.length("query") >= MIN_LONG
    asked = shared.settled(queries.select("query_id", long_.alias("is_long"), F.when(long_, F.lower("query")).otherwise(ascii_lower(F.col("query"))).alias("term")), "asked")
    terms = shared.settled(asked.groupBy("is_long", "term").agg(F.min("query_id").alias("lead")), "terms")
    return terms, shared.settled(asked.join(terms, ["is_long", "term"]).select("lead", "query_id"), "names")


def blocks(terms: DataFrame) -> Iterator[list[Term]]:
    """The terms, TERM_BLOCK at a time; never more than a block on the driver, and one block (maybe empty) at least."""
    block: list[Term] = []
    first = True
    for r in terms.select("lead", "is_long", "term").orderBy("lead", "is_long", "term").toLocalIterator():
        if len(block) == TERM_BLOCK:
            yield block
            block, first = [], False
        block.append((r.lead, r.is_long, r.term.encode()))
    if block or first:
        yield block


# ---------------------------------------------------------------- hits of rows


def every(evidence: DataFrame, terms: list[Term], kept: list[str]) -> DataFrame:
    """(lead, is_long, f, kept columns) of each row that holds a term."""
    hits = finder(terms)
    lead, is_long = np.array([t[0] for t in terms], np.int64), np.array([t[1] for t in terms], bool)
    rows = _read(evidence, terms, *kept)
    schema = StructType([StructField("lead", LongType()), *StructType.fromDDL("is_long boolean, f long").fields, *rows.select(*kept).schema.fields])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, term, times in hits(batch):
                where = pa.array(row)
                columns = [pa.array(lead[term]), pa.array(is_long[term]), pa.array(np.where(is_long[term], times, 0)), *[batch.column(c).take(where) for c in kept]]
                yield pa.RecordBatch.from_arrays(columns, ["lead", "is_long", "f", *kept])

    return rows.mapInArrow(find, schema)


def weight(f: np.ndarray, d: np.ndarray, mean: float) -> np.ndarray:
    """What BM25 multiplies idf with."""
    return f * (K1 + 1) / (f + K1 * (1 - B + B * d / mean))


def _leading(term: np.ndarray, value: np.ndarray, place: np.ndarray, is_long: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which rows can be among the `most` best of their term by falling value and rising place; terms with so many; their least value).

    Of long terms, values that differ by rounding alone count as equal, and of one value the first `most` stay.
    """
    order = np.lexsort((place, -value, term))
    t, v = term[order], value[order]
    spot = np.arange(len(order))
    new = np.append(True, t[1:] != t[:-1])
    begin = np.maximum.accumulate(np.where(new, spot, 0))
    same = np.maximum.accumulate(np.where(new | np.append(True, v[1:] != v[:-1]), spot, 0))
    last = begin + most - 1
    full = (last < len(order)) & (t[np.minimum(last, len(order) - 1)] == t)
    least = np.where(full, v[np.minimum(last, len(order) - 1)], -np.inf)
    least = np.where(is_long[t], least * (1 - SLACK), least)
    keep = (spot <= last) | is_long[t] & (v >= least) & (spot - same < most)
    heads = new & full
    return order[keep], t[heads], least[heads]


def best(evidence: DataFrame, terms: list[Term], kept: list[str], most: int, mean_length: float, held_rows: int = HELD_ROWS) -> DataFrame:
    """(lead, is_long, n, f, chars, kept columns): rows marked `shown` that can be among the `most` best of a term, by BM25 and
    evidence_seq, and the newest of short ones; n is null there. One more row for each task and term has the number n of its
    rows, shown or not, that hold the term, and nulls.

    kept has evidence_seq. Tasks are as many as the cluster can use, so what they hand on grows with the terms and not with the rows.
    """
    hits = finder(terms)
    lead, is_long = np.array([t[0] for t in terms], np.int64), np.array([t[1] for t in terms], bool)
    rows = _read(evidence, terms, *kept, F.length("text").alias("chars"), F.col("shown"))
    head = StructType.fromDDL("lead long, is_long boolean, n long, f long, chars int").fields
    schema = StructType([*head, *[StructField(x.name, x.dataType, True) for x in rows.select(*kept).schema.fields]])

    def table(term: np.ndarray, f: np.ndarray, batch: pa.RecordBatch, row: np.ndarray) -> pa.Table:
        where = pa.array(row)
        return pa.table([pa.array(lead[term]), pa.array(is_long[term]), pa.nulls(len(term), pa.int64()), pa.array(f), *[batch.column(c).take(where) for c in ("chars", *kept)]], names=[x.name for x in schema])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, least = np.zeros(len(terms), np.int64), np.full(len(terms), -np.inf)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]] = []  # term, value, place, row
        least_held = min(1 << 16, held_rows // 4)
        size, after = 0, least_held

        def cut() -> None:
            term, value, place = (np.concatenate([h[i] for h in held]) for i in range(3))
            on, full, new = _leading(term, value, place, is_long, most)
            least[full] = np.maximum(least[full], new)
            held[:] = [(term[on], value[on], place[on], pa.concat_tables([h[3] for h in held]).take(pa.array(on)))]

        for batch in batches:
            if not len(batch):
                continue
            kinds = [batch.schema.field(c).type for c in ("chars", *kept)]
            shown = batch.column("shown").fill_null(False).to_numpy(zero_copy_only=False)
            chars = batch.column("chars").to_numpy(zero_copy_only=False)
            seq = batch.column("evidence_seq").cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            some = []
            for row, term, times in hits(batch):
                counts += np.bincount(term, minlength=len(terms))
                row, term, times = (x[shown[row]] for x in (row, term, times))
                long_ = is_long[term]
                value = np.where(long_, weight(times, np.maximum(0, chars[row] - 2), mean_length), seq[row])
                on = np.flatnonzero(value >= least[term])
                some.append((term[on], value[on], np.where(long_, seq[row], -seq[row])[on], row[on], np.where(long_, times, 0)[on]))
            if not some:
                continue
            term, value, place, row, f = (np.concatenate(x) for x in zip(*some, strict=True))
            on, full, new = _leading(term, value, place, is_long, most) if len(term) else (np.zeros(0, np.int64),) * 3
            least[full] = np.maximum(least[full], new)
            held.append((term[on], value[on], place[on], table(term[on], f[on], batch, row[on])))
            size += len(on)
            if size > after:
                cut()
                size = len(held[0][0])
                after = max(least_held, 2 * size)
                if size > held_rows // 2:  # what comes later has to beat them all the same
                    yield from held[0][3].to_batches()
                    held.clear()
                    size, after = 0, least_held
        if held:
            cut()
            yield from held[0][3].to_batches()
        there = np.flatnonzero(counts)
        if len(there):
            some = [pa.array(lead[there]), pa.array(is_long[there]), pa.array(counts[there])]
            nulls = [pa.nulls(len(there), x) for x in (pa.int64(), *kinds)]
            yield pa.RecordBatch.from_arrays([*some, *nulls], [x.name for x in schema])

    return rows.coalesce(2 * evidence.sparkSession.sparkContext.defaultParallelism).mapInArrow(find, schema)
