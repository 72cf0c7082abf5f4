"""Benchmark decontamination by pigeonhole edit matching over words.

A test item of m words (lower-cased runs of word characters) may differ from a passage of a document in at
most k = floor(0.2 m) inserted, deleted or replaced words. Cut into k + 1 pieces, at least one piece must
stand in the passage unchanged. All pieces are found at once by an Aho-Corasick automaton over the whole
text; around each hit Myers' bit-parallel algorithm gives the edit distance of the item to the best passage.

Result: one row for each (document, item) whose distance is within the budget. Nothing else is dropped or
capped: every hit is verified. An item of fewer than five words has no budget and is found where it stands
word for word; a caller may leave such items out by `min_words`. Items are handled in blocks of bounded text,
each block shipped to the tasks and run against all documents.

Defined cases: items without words (null and empty ones too) take no part; a null or empty text has no hits; a
very long text is searched whole, only the stretches around hits are measured; repeated items match each;
repeated rows and null ids are reported each by id, and `decontaminate` judges every row by its own text; an
empty table on either side gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
ERROR_RATE = 0.2
BLOCK_CHARS = 1 << 20
SCHEMA = "doc_id long, item_id long, distance int, item_words int, similarity double, end_word int"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def pieces(n_words: int, budget: int) -> list[tuple[int, int]]:
    """(start, end) of budget + 1 pieces of near-equal length."""
    cuts = [n_words * i // (budget + 1) for i in range(budget + 2)]
    return list(zip(cuts, cuts[1:]))


class Pattern:
    """Bit masks of one item for Myers' algorithm; a symbol is a word."""

    def __init__(self, words: list[str]):
        self.m = len(words)
        self.masks: dict[str, int] = {}
        for i, w in enumerate(words):
            self.masks[w] = self.masks.get(w, 0) | 1 << i

    def best(self, text: list[str]) -> tuple[int, int]:
        """(smallest edit distance to any run of `text`, index of its last word): ties to the first."""
        full = (1 << self.m) - 1
        top = 1 << (self.m - 1)
        plus, minus, now = full, 0, self.m
        least, where = self.m, -1
        for j, w in enumerate(text):
            eq = self.masks.get(w, 0)
            diagonal = ((((eq & plus) + plus) & full) ^ plus) | eq | minus
            up = (minus | ~(diagonal | plus)) & full
            down = plus & diagonal
            now += bool(up & top) - bool(down & top)
            up = (up << 1) & full
            down = (down << 1) & full
            plus = (down | ~(diagonal | up)) & full
            minus = up & diagonal
            if now < least:
                least, where = now, j
        return least, where


class Matcher:
    """All items of a block."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float = ERROR_RATE, min_words: int = 1):
        import ahocorasick

        self.items: list[tuple[int, Pattern, int]] = []
        places: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            words = words_of(text)
            if len(words) < max(1, min_words):
                continue
            budget = int(error_rate * len(words))
            for a, b in pieces(len(words), budget):
                places.setdefault(" " + " ".join(words[a:b]) + " ", []).append((len(self.items), a))
            self.items.append((item_id, Pattern(words), budget))
        self.automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, (len(piece), at))
        if places:
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, float, int]]:
        """(item_id, distance, words of the item, similarity, last word) for each item within its budget."""
        if not self.items:
            return []
        words = words_of(text)
        hits = list(self.automaton.iter(" " + " ".join(words) + " "))
        if not hits:
            return []
        starts = np.cumsum([0] + [len(w) + 1 for w in words])
        shifts: dict[int, set[int]] = {}
        for end, (size, at) in hits:
            word = int(np.searchsorted(starts, end - size + 1))
            for item, offset in at:
                shifts.setdefault(item, set()).add(word - offset)
        found = []
        for item, begins in sorted(shifts.items()):
            item_id, pattern, budget = self.items[item]
            best = (budget + 1, -1)
            for a, b in _windows(sorted(begins), pattern.m, budget, len(words)):
                distance, where = pattern.best(words[a:b])
                best = min(best, (distance, a + where))
            if best[0] <= budget:
                found.append((item_id, best[0], pattern.m, 1 - best[0] / pattern.m, best[1]))
        return found


def _windows(begins: list[int], m: int, k: int, n: int) -> list[tuple[int, int]]:
    """Merged stretches of words in which a passage with a hit at one of these shifts must lie."""
    out: list[list[int]] = []
    for s in begins:
        a, b = max(0, s - k), min(n, s + m + k)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, BLOCK_CHARS of text at a time; never more than a block on the driver."""
    block: list[tuple[int, str]] = []
    size = 0
    rows = benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        block.append((r.item_id, r.text))
        size += len(r.text)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_words: int = 1) -> DataFrame:
    """One row of SCHEMA for each document and item within the budget."""
    spark = docs.sparkSession
    texts = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], SCHEMA)
    for block in item_blocks(benchmark):
        items = spark.sparkContext.broadcast(block)  # BLOCK_CHARS at most

        def search(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items.value, error_rate, min_words)
            for batch in batches:
                rows = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for hit in matcher.matches(text.as_py())]
                if rows:
                    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "item_id", "distance", "item_words", "similarity", "end_word"])

        out = out.unionByName(texts.mapInArrow(search, SCHEMA))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_words: int = 1) -> DataFrame:
    """The rows without a leak, columns unchanged: the rows themselves pass through the search, block after block."""
    at = docs.columns.index("text")
    out = docs
    for block in item_blocks(benchmark):
        items = docs.sparkSession.sparkContext.broadcast(block)  # BLOCK_CHARS at most

        def keep(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items.value, error_rate, min_words)
            for batch in batches:
                yield batch.filter(pa.array([not (text.is_valid and matcher.matches(text.as_py())) for text in batch.column(at)], pa.bool_()))

        out = out.mapInArrow(keep, docs.schema)
    return out
