"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Learning, on at most `sample_rows` vectors (smallest hash of the id): principal axes of the unit vectors, then
the rotations of iterative quantisation from TURNS starts, which bring the signs of the rotated axes close to
the vectors; the code of a vector is the BITS signs. The search radius R is learned too: the Hamming radius
that holds the k nearest of sample queries for `target` of them.

Index: a code is cut into PARTS 16-bit substrings, each with a table from value to rows (sorted values with
offsets). If two codes differ in at most R bits, some substring differs in at most floor(R / PARTS): so probing
all values within that radius in all tables finds every code within R. The found codes are checked against R
and re-ranked by cosine in double precision on the original vectors.

Every row is indexed. The index is a written table, a row for each block of at most INDEX_BLOCK vectors with
their codes and tables, made where the vectors are, once. Queries go to it QUERY_BLOCK at a time; each block of
the index answers with at most k rows a query, so no vector is ever moved. A query for which all blocks
together find fewer than k codes is asked again with twice the radius, until it has k or the radius is BITS.

Vectors of different lengths aren't compared: each length has codes and an index of its own.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do null
ids; equal vectors tie and go to the smaller id; a repeated id is one candidate (its first vector by hash); an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timelore.llm.common import materialise

TURNS = 2
BITS, WIDTH = 64 * TURNS, 16
PARTS = BITS // WIDTH
INDEX_BLOCK, QUERY_BLOCK = 16_384, 1_024
RESULT = "query_id long, vec_id long, score double"
INDEX = "ids binary, vectors binary, codes binary, orders array<binary>, firsts array<binary>"


@dataclass
class Codes:
    """The learned map from vectors to codes, and the search radius."""

    mean: np.ndarray
    axes: np.ndarray
    radius: int

    def of(self, unit: np.ndarray) -> np.ndarray:
        """[n, TURNS] words of 64 signs."""
        signs = (unit - self.mean) @ self.axes > 0
        return np.packbits(signs, axis=1, bitorder="little").view("<u8")


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def learn(vectors: np.ndarray, k: int, target: float, rounds: int = 30) -> Codes:
    """Axes, rotations and radius from a sample of vectors."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    mean = unit.mean(axis=0)
    _, _, axes = np.linalg.svd(unit - mean, full_matrices=False)
    axes = axes[:64].T
    seed = np.random.default_rng(7)
    turned = []
    for _ in range(TURNS):
        turn = np.linalg.qr(seed.normal(size=(64, 64)))[0]
        if axes.shape[1] < 64:  # fewer axes than bits: more directions inside their span
            turned.append(axes @ turn[: axes.shape[1]])
            continue
        points = (unit - mean) @ axes
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.sign(points @ turn).T @ points)
            turn = (u @ w).T
        turned.append(axes @ turn)
    codes = Codes(mean, np.concatenate(turned, axis=1), BITS)
    own = codes.of(unit)
    some = np.arange(0, len(unit), max(1, len(unit) // 300))
    near = unit[some] @ unit.T
    near[np.arange(len(some)), some] = -2
    top = np.argsort(-near, axis=1)[:, : min(k, len(unit) - 1)]
    far = np.sort(hamming(own[some][:, None], own[top]), axis=None)
    codes.radius = int(far[min(len(far) - 1, int(target * len(far)))]) if len(far) else BITS
    return codes


def probes(radius: int) -> np.ndarray:
    """All 16-bit masks of at most `radius` bits."""
    if radius >= WIDTH // 2:
        every = np.arange(1 << WIDTH, dtype=np.uint32)
        return every[np.bitwise_count(every) <= radius].astype(np.uint16)
    masks = [0]
    for r in range(1, radius + 1):
        masks += [sum(1 << b for b in bits) for bits in combinations(range(WIDTH), r)]
    return np.array(masks, np.uint16)


class SubstringTables:
    """The tables of one block of codes [n, TURNS]."""

    def __init__(self, codes: np.ndarray, rows: list[np.ndarray] | None = None, first: list[np.ndarray] | None = None):
        self.codes = codes
        if rows is None:
            parts = codes.view("<u2")
            rows = [np.argsort(parts[:, p], kind="stable").astype("<i4") for p in range(PARTS)]
            first = [np.searchsorted(parts[rows[p], p], np.arange((1 << WIDTH) + 1)).astype("<i4") for p in range(PARTS)]
        self.rows, self.first = rows, first

    def probed(self, code: np.ndarray, masks: np.ndarray) -> np.ndarray:
        """Rows with a substring at one of the masks from the code's."""
        found = np.zeros(len(self.codes), bool)
        for p, value in enumerate(code.view("<u2")):
            values = (masks ^ value).astype(np.int64)
            a, b = self.first[p][values], self.first[p][values + 1]
            full = b > a
            a, b = a[full], b[full]
            n = (b - a).astype(np.int64)
            at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
            found[self.rows[p][at]] = True
        return np.flatnonzero(found)

    def within(self, code: np.ndarray, radius: int, masks: np.ndarray) -> np.ndarray:
        """Rows of all codes at most `radius` bits away."""
        rows = self.probed(code, masks)
        return rows[hamming(self.codes[rows], code) <= radius]


def nearest(query: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, float]]:
    """The k best (id, cosine) by score, then smaller id."""
    score = (vectors * query).sum(axis=1) / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))
    order = np.lexsort((ids, -score))[:k]
    return [(int(ids[i]), float(score[i])) for i in order]


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of the vectors that take part, one for each id."""
    v = F.col(vector_col)
    sound = v.isNotNull() & (F.size(v) > 0) & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(sound).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))
    if rows.groupBy("id").count().filter("count > 1").isEmpty():
        return rows
    return rows.groupBy("id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def build_index(rows: DataFrame, codes: Codes) -> DataFrame:
    """Blocks (INDEX) of rows (id, v) of one length, made where the rows are."""
    shared = rows.sparkSession.sparkContext.broadcast(codes)  # two small matrices

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, INDEX_BLOCK):
                part = batch.slice(at, INDEX_BLOCK)
                v = matrix(part.column(1))
                own = shared.value.of(v / np.linalg.norm(v, axis=1, keepdims=True))
                tables = SubstringTables(own)
                row = [part.column(0).to_numpy().astype("<i8").tobytes(), v.astype("<f8").tobytes(), own.tobytes(), [x.tobytes() for x in tables.rows], [x.tobytes() for x in tables.first]]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.list_(pa.binary()) if isinstance(x, list) else pa.binary()) for x in row], ["ids", "vectors", "codes", "orders", "firsts"])

    return rows.mapInArrow(build, INDEX)


def query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the queries, QUERY_BLOCK at a time; never more than a block on the driver."""
    ids, block = [], []
    for r in queries.orderBy("id").toLocalIterator():
        ids.append(r.id)
        block.append(r.v)
        if len(ids) == QUERY_BLOCK:
            yield np.array(ids), np.array(block, float)
            ids, block = [], []
    if ids:
        yield np.array(ids), np.array(block, float)


def within_radius(index: DataFrame, queries: DataFrame, codes: Codes, radius: int, k: int) -> DataFrame:
    """RESULT: of each block of the index the k nearest of each query among the codes within the radius."""
    spark = index.sparkSession
    out = spark.createDataFrame([], RESULT)
    for ids, asked in query_blocks(queries):
        shared = spark.sparkContext.broadcast((ids, asked, codes))  # QUERY_BLOCK vectors at most

        def meet(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, asked, codes = shared.value
            asked_codes = codes.of(asked / np.linalg.norm(asked, axis=1, keepdims=True))
            masks = probes(radius // PARTS)
            for batch in batches:
                for own_ids, own_vectors, own_codes, orders, firsts in zip(*batch.columns, strict=True):
                    names = np.frombuffer(own_ids.as_buffer(), "<i8")
                    v = np.frombuffer(own_vectors.as_buffer(), "<f8").reshape(len(names), -1)
                    tables = SubstringTables(np.frombuffer(own_codes.as_buffer(), "<u8").reshape(-1, TURNS), *([np.frombuffer(x, "<i4") for x in y.as_py()] for y in (orders, firsts)))
                    found = []
                    for i, query_id in enumerate(ids.tolist()):
                        at = tables.within(asked_codes[i], radius, masks)
                        at = at[names[at] != query_id]
                        found += [(query_id, *x) for x in nearest(asked[i], v[at], names[at], k)]
                    columns = list(zip(*found)) or [[]] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])

        out = out.unionByName(index.mapInArrow(meet, RESULT))
    return out


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_length(rows: DataFrame, every: int, k: int, target: float, sample_rows: int) -> DataFrame:
    """The result for rows (id, v) of one length."""
    sample = np.array([r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").collect()], float)  # bounded by sample_rows
    codes = learn(sample, k, target)
    index = materialise(build_index(rows, codes), "index")
    queries = rows.filter(F.col("id") % every == 0)
    wanted = min(k, rows.count() - 1)
    radius, out = codes.radius, None
    while wanted > 0:
        found = materialise(best_of(within_radius(index, queries, codes, radius, k), k), "nearest")
        done = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= wanted).select("query_id")
        part = found.join(done, "query_id", "left_semi")
        out = part if out is None else out.unionByName(part)
        queries = materialise(queries.join(done, queries["id"] == done["query_id"], "left_anti"), "short")
        if queries.isEmpty():
            break
        radius = min(BITS, max(1, 2 * radius))
    return out if out is not None else rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def search(vectors: DataFrame, every: int = 50, k: int = 5, target: float = 0.97, sample_rows: int = 10_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the queries whose id is divisible by `every`, against all rows."""
    rows = materialise(usable(vectors, id_col, vector_col), "vectors")
    out = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in rows.groupBy(F.size("v").alias("size")).count().orderBy("size").toLocalIterator():  # one row for each length
        out = out.unionByName(search_length(rows.filter(F.size("v") == r["size"]), every, k, target, sample_rows))
    return out
