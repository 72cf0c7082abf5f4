"""Periodic runs of words by uniting suffix classes in the order of falling common prefixes.

A run is a stretch of consecutive words with smallest period q and at least max(LEAST, TIMES * q) words that no
neighbouring word extends; a word goes if some run holds it after that run's first q words.

Suffixes. A run of period q from word s makes the suffixes at s and s + q share at least (TIMES - 1) * q words, and
never fewer than SHARED. So only words under a repeated SHARED-gram of their document matter: stretches of those, each
closed by a symbol of its own, keep all common prefixes of SHARED words and more. They are found by sorted hashes (a
collision makes a stretch longer, never shorter), several documents at a time; symbols carry their document, so that
nothing is shared between two. Suffixes are sorted by prefix doubling, of which a round touches only suffixes that are
not alone yet; common prefixes of neighbours follow in one walk over the text.

Kruskal. The edges of the sorted suffixes, longest common prefix first, unite classes of suffixes. A class is a stretch
of the suffix order, so finding the class at an edge is a look at the stretch's ends; it keeps its positions in order,
and the smaller list is merged into the larger. Two positions p < p' that become neighbours in the united list share
exactly the edge's l words: if TIMES - 1 times their distance q is within l, the words from p on have period q for
q + l words and no longer, and q is their smallest period (a smaller one would stand between p and p'). The run is
taken from its first word, where the word before p differs from the one before p'.

The work of a document stays in one task; documents of many tasks are independent, so nothing is shuffled. Texts are
taken about CHUNK_BYTES at a time, a longer one by itself; it is read to word numbers in parts.

Defined cases: null and empty texts, and texts of blanks, have no words and no runs; repeated rows are judged each;
a null id gives a null id (and, in the query, the words as they are); an empty table stays empty; further columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, TIMES = 6, 4
#: A run has at least this many words in common with itself one period on: LEAST - 1 for q = 1, and 3 * q from q = 2.
SHARED = 5
CHUNK_BYTES = 1 << 21

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_ODD = np.random.default_rng(13).integers(0, 1 << 63, SHARED + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

Run = tuple[int, int, int]


def word_numbers(text: bytes, vocabulary: dict[bytes, int]) -> np.ndarray:
    """The words of a text between ASCII blanks, as numbers; new words are added. Long texts in parts."""
    parts, at = [], 0
    while at < len(text) or not parts:
        cut = _BLANK.search(text, at + CHUNK_BYTES)
        stop = cut.start() if cut else len(text)
        words = text[at:stop].split()
        new = set(words).difference(vocabulary)
        vocabulary.update(zip(new, range(len(vocabulary), len(vocabulary) + len(new)), strict=True))
        parts.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
        at = stop + 1
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def stretches(words: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, places): all words under a SHARED-gram that its document repeats, in order.

    `words` holds the documents one after another, `stops` the end of each. After each stretch stands a symbol that
    occurs once, with place -1.
    """
    none = np.zeros(0, np.int64)
    n = len(words) - SHARED + 1
    if n <= 0:
        return none, none
    document = np.repeat(np.arange(len(stops), dtype=np.int64), np.diff(np.concatenate([[0], stops])))
    grams = document[:n].astype(np.uint64) * _ODD[SHARED]
    for t in range(SHARED):
        grams += words[t : t + n].astype(np.uint64) * _ODD[t]
    grams ^= grams >> np.uint64(29)
    whole = document[:n] == document[SHARED - 1 :]
    ordered = np.sort(grams[whole])
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return none, none
    again = again[np.append(True, again[1:] != again[:-1])]
    near = np.searchsorted(again, grams)
    first = np.flatnonzero(whole & (again[np.minimum(near, len(again) - 1)] == grams))
    edges = np.bincount(first, minlength=len(words) + 1) - np.bincount(first + SHARED, minlength=len(words) + 1)
    place = np.flatnonzero(np.cumsum(edges[: len(words)]) > 0)
    last = np.append((place[1:] != place[:-1] + 1) | (document[place[1:]] != document[place[:-1]]), True)
    at = np.arange(len(place)) + np.cumsum(last) - last
    places = np.full(len(place) + int(last.sum()), -1, np.int64)
    places[at] = place
    _, kinds = np.unique(document[place] * (int(words.max()) + 1) + words[place], return_inverse=True)
    symbols = np.empty(len(places), np.int64)
    symbols[at] = kinds
    ends = places < 0
    symbols[ends] = len(place) + np.arange(int(ends.sum()))
    return symbols, places


def sorted_suffixes(symbols: np.ndarray) -> np.ndarray:
    """Suffix numbers in sorted order, by prefix doubling; the last symbol must occur once."""
    m = len(symbols)
    order = np.argsort(symbols, kind="stable")
    place = np.arange(m)
    new = np.append(True, symbols[order][1:] != symbols[order][:-1])
    group = np.maximum.accumulate(np.where(new, place, 0))
    rank = np.empty(m, np.int64)
    rank[order] = group
    open_ = order[~(new & np.append(new[1:], True))]
    length = 1
    while len(open_):
        key = rank[open_] * m + rank[open_ + length]
        by = np.argsort(key, kind="stable")
        open_, key = open_[by], key[by]
        old = rank[open_]
        i = np.arange(len(open_))
        head = np.append(True, old[1:] != old[:-1])
        spot = old + i - np.maximum.accumulate(np.where(head, i, 0))
        new = np.append(True, key[1:] != key[:-1])
        order[spot] = open_
        rank[open_] = spot[np.maximum.accumulate(np.where(new, i, 0))]
        open_ = open_[~(new & np.append(new[1:], True))]
        length *= 2
    return order


def common_prefixes(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """common[r]: the length that suffixes order[r - 1] and order[r] share; 0 for r = 0."""
    m = len(order)
    before = np.full(m, -1, np.int64)
    before[order[1:]] = order[:-1]
    by_place = np.zeros(m, np.int64)
    text, left, out = memoryview(np.ascontiguousarray(symbols)), memoryview(before), memoryview(by_place)
    shared = 0
    for i in range(m):
        j = left[i]
        if j < 0:
            shared = 0
            continue
        while i + shared < m and j + shared < m and text[i + shared] == text[j + shared]:
            shared += 1
        out[i] = shared
        if shared:
            shared -= 1
    return by_place[order]


def seeded_runs(symbols: np.ndarray, order: np.ndarray, common: np.ndarray) -> list[Run]:
    """(first place, words, period) of the runs, from classes united by falling common prefixes."""
    edges = np.flatnonzero(common >= SHARED)
    edges = edges[np.argsort(-common[edges], kind="stable")]
    text, suffix, left_of, right_of = (memoryview(np.ascontiguousarray(x, np.int64)) for x in (symbols, order, np.arange(len(order)), np.arange(len(order))))
    classes: dict[int, list[int]] = {}  # ordered positions, by each end of the class's stretch
    out = []

    def seed(p: int, q: int, shared: int) -> None:
        if p == 0 or text[p - 1] != text[p + q - 1]:
            out.append((p, q + shared, q))

    for k, shared in zip(edges.tolist(), common[edges].tolist(), strict=True):
        left, right = left_of[k - 1], right_of[k]
        a = classes.pop(k - 1, None) or [suffix[k - 1]]
        b = classes.pop(k, None) or [suffix[k]]
        small, large = (a, b) if len(a) <= len(b) else (b, a)
        reach = shared // (TIMES - 1)
        if len(small) == 1:
            x = small[0]
            at = bisect_left(large, x)
            if at and x - large[at - 1] <= reach:
                seed(large[at - 1], x - large[at - 1], shared)
            if at < len(large) and large[at] - x <= reach:
                seed(x, large[at] - x, shared)
            large.insert(at, x)
        else:
            if 16 * len(small) < len(large):
                for x in small:
                    insort(large, x)
            else:
                large += small
                large.sort()
            for before, x, after in zip([-1, *small], small, [*small[1:], -1]):
                at = bisect_left(large, x)
                if at and (y := large[at - 1]) != before and x - y <= reach:
                    seed(y, x - y, shared)
                if at + 1 < len(large) and (y := large[at + 1]) != after and y - x <= reach:
                    seed(x, y - x, shared)
        classes[left] = classes[right] = large
        left_of[right], right_of[left] = left, right
    return out


def runs_of(documents: list[np.ndarray]) -> list[list[Run]]:
    """(start, words, period) of the runs of each document, by start and period."""
    out: list[list[Run]] = [[] for _ in documents]
    if not documents:
        return out
    stops = np.cumsum([len(x) for x in documents])
    symbols, places = stretches(np.concatenate(documents), stops)
    if len(symbols):
        order = sorted_suffixes(symbols)
        begins = np.concatenate([[0], stops[:-1]])
        for p, words, q in seeded_runs(symbols, order, common_prefixes(symbols, order)):
            i = int(np.searchsorted(stops, places[p], side="right"))
            out[i].append((int(places[p] - begins[i]), words, q))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: np.ndarray, runs: list[Run]) -> np.ndarray:
    """The words without those that a run repeats."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return words[np.cumsum(edges[:-1]) == 0]


def periodic_tail(doc_id: int | None, words: np.ndarray) -> np.ndarray:
    """Of documents with h % 10 = 0, h = crc32 of the id in decimals: the words from g % n on repeat, g = h // 10."""
    if doc_id is None or not len(words):
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([words[:a], np.resize(words[a : a + p], n - a)])


def detect(docs: DataFrame, edit: Callable[[int | None, np.ndarray], np.ndarray] | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, runs (array of start, length, period, by start and period) and the collapsed text of every document.

    `edit` may change a document's words, as numbers, before they are judged.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in (part for batch in batches for part in chunks(batch)):
            vocabulary: dict[bytes, int] = {}
            words = [word_numbers(x, vocabulary) for x in texts]
            if edit is not None:
                words = [edit(i, x) for i, x in zip(ids, words, strict=True)]
            runs = runs_of(words)
            spelled = list(vocabulary).__getitem__
            kept = [b" ".join(map(spelled, collapsed(x, r).tolist())) for x, r in zip(words, runs, strict=True)]
            flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
            structs = pa.StructArray.from_arrays([pa.array(flat[:, c].copy()) for c in range(3)], fields=list(run))
            offsets = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(offsets, structs), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(judge, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[list[int | None], list[bytes]]]:
    """(ids, texts) of a batch, about CHUNK_BYTES of text at a time."""
    sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(sizes // CHUNK_BYTES)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            part = batch.slice(a, b - a)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()


def digest(found: DataFrame) -> DataFrame:
    """Counts, the longest run (then the first, then of the smallest period) and hashes of what `detect` gives."""

    def line(r: Column) -> Column:
        return F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))

    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    out = found.withColumn("top", top)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.expr("(top.length * 1000) div -top.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
