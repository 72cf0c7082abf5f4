"""Packing: the encoder against the library, the search against optima, packed tables against the whole documents."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from timelore.llm import packing
from timelore.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
PATH = tokenizer_path("byte_bpe_50k.json")
BLANKS = [" ", "  ", "\n", "\n\n", "\t", "\r\n", " \n", "\n ", *map(chr, (0x0B, 0x1C, 0x85, 0xA0, 0x1680, 0x180E, 0x2000, 0x200A, 0x200B, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)), " ", " "]
PARTS = ["word", "it's", "we'LL", "12", "3.5", "<|endoftext|>", "\0", "-", "'", "'s", "A", "_", "na" + chr(0xEF) + "ve", "e" + chr(0x301), *map(chr, (0xE9, 0xFC, 0x65E5, 0x1F600, 0x2026, 0x201C, 0x212B, 0x9A8, 0xFEFF))]


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as f:
        return packing.RunEncoder(f.read())


def test_runs_give_the_librarys_ids(encoder):
    assert encoder.by_run
    draw, library = random.Random(2), Tokenizer.from_file(PATH)
    texts = ["".join(draw.choice(PARTS if draw.random() < 0.6 else BLANKS) for _ in range(draw.randint(0, 12))) for _ in range(6_000)]
    texts += [f"a{b}b {b}{c} {c}" for b in BLANKS for c in BLANKS]
    texts += ["".join(chr(c) for c in range(a, a + 64) if not 0xD800 <= c < 0xE000) for a in range(0, 0x3100, 64)]
    texts += [f"x {chr(c)} y\n{chr(c)}\nz {chr(c)}w w{chr(c)} " for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    texts += [f"x w{chr(c)}d, {chr(c)}. {chr(c)}" for c in range(0xA0, 0x300)] + [f"ab{chr(a)}{chr(b)} {chr(a)}c{chr(b)} c{chr(a)}" for a in range(33, 127) for b in range(33, 127)]
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        want = [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch(some, add_special_tokens=False)]
        assert encoder.encode_many([x.encode() for x in some]) == want


def fewest(sizes: list[int], capacity: int) -> int:
    """The fewest bins, by trying all places for each item."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def put(i: int, rooms: list[int]) -> None:
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for b, room in enumerate(rooms):
            if room >= sizes[i] and room not in rooms[:b]:
                put(i + 1, [*rooms[:b], room - sizes[i], *rooms[b + 1 :]])
        put(i + 1, [*rooms, capacity - sizes[i]])

    put(0, [])
    return best


def test_search_is_near_the_optimum():
    draw, over = random.Random(8), 0
    for _ in range(150):
        capacity = draw.choice([10, 20, 100])
        sizes = np.array([draw.randint(1, capacity - 1) for _ in range(draw.randint(1, 9))])
        start = packing.best_fit(sizes, capacity)
        state = packing.Bins(sizes, start, capacity)
        squares = (state.fill**2).sum()
        state.search()
        assert (state.fill == np.bincount(state.bins, weights=sizes, minlength=len(state.fill))).all() and state.fill.max() <= capacity
        assert (state.fill**2).sum() >= squares
        over += int((state.fill > 0).sum()) - fewest(sizes.tolist(), capacity)
    assert over <= 3


def test_each_kind_of_exchange_empties_a_bin():
    for bins in ([[7], [2, 1]], [[9, 8], [10, 6], [3]], [[6, 5], [8, 4], [9]]):
        sizes = np.array([x for b in bins for x in b])
        capacity = 20 if len(bins) == 3 and sum(sizes) > 30 else -(-int(sizes.sum()) // (len(bins) - 1))
        state = packing.Bins(sizes, np.repeat(np.arange(len(bins)), [len(b) for b in bins]), capacity)
        state.search()
        assert int((state.fill > 0).sum()) == -(-int(sizes.sum()) // capacity)
    assert packing.Bins(np.array([5, 5]), np.array([0, 0]), 10).exchange(0) is False


def check(rows, docs: list[tuple[int | None, str | None]], capacity: int) -> int:
    """The number of sequences, after all that must hold of packed rows."""
    library = Tokenizer.from_file(PATH)
    want = []
    for doc, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) - (len(ids) - 1) // capacity * capacity, len(ids) + 1, capacity)]
        want += [(doc, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(want, key=repr)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_query_packs_all_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = QUERIES["op11_packing"](spark, SF).collect()
    assert check(rows, docs, 2_048) <= -(-sum(r.length for r in rows) // 2_048) + 1


def test_odd_tables_and_many_groups(spark, hard_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in hard_docs.collect()]
    packed = packing.pack(hard_docs.withColumn("slot", hard_docs["doc"]), PATH, capacity=64, group_items=4)
    check(packed.collect(), docs, 64)
    whole = packing.sequences(packed).collect()
    rows = packed.collect()
    assert sum(r.n_tokens for r in whole) == sum(r.length for r in rows) and all(len(r.ids) == 4 * r.n_tokens for r in whole)
    ids = {r.sequence_id: r.ids for r in whole}
    assert all(ids[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == r.ids for r in rows)
    assert packing.pack(no_docs, PATH).count() == 0
    draw = random.Random(3)
    some = [(i, "w " * draw.choice([1, 5, 13, 21, 40, 55, 62])) for i in range(700)]
    rows = packing.pack(spark.createDataFrame(some, "doc_id long, text string"), PATH, capacity=128, group_items=100).collect()
    assert check(rows, some, 128) <= -(-sum(r.length for r in rows) // 128) + 3
