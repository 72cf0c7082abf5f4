"""Exact nearest vectors of many queries on a grid of cells, without what can't be among the best.

Queries and vectors both stay tables. They are dealt out evenly, by a hash of their number, into columns and rows of a
grid; the cell of a row and a column meets its vectors and queries in one task, so a cell's size is bounded (CELL_NUMBERS)
and the plan is the same for any number of queries.

In a cell, vectors with the same nearest pivot form blocks; small cells have few pivots, so that blocks are worth a step.
A block has a centre c and a radius r, so no score of query q
there exceeds q.c + |q| r. Queries are taken in blocks too; a pair of blocks is skipped when the bound of none of its
queries reaches that query's `most`-th score so far, which starts from the best of a sample of vectors. Pairs are tried in
the order of their bounds; of a pair only scores that reach their query's are looked at further. Pivots and sample (the SAMPLE vectors with the smallest hash) decide what is skipped, and
never what is found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, PIVOTS = 2_048, 128
#: Most numbers of vectors, and of queries, in a cell.
CELL_NUMBERS, QUERY_NUMBERS = 1 << 23, 1 << 22
BLOCK_QUERIES, BLOCK_VECTORS = 256, 1_024
#: Rows of a block, as far as a cell has FEW_BLOCKS of them; below that, the least rows of one.
WORTH_QUERIES, WORTH_VECTORS = 64, 256
LEAST_QUERIES, LEAST_VECTORS = 8, 32
FEW_QUERIES, FEW_VECTORS = 8, 32
LEAST_CELL = 512
EXACT_NUMBERS = 1 << 22
SLACK = 1e-9

FOUND = "query_id long, segment_id long, score double, tried long, skipped long"


def _matrix(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers, where each list starts and the last ends)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.array(column.value_lengths().fill_null(0), np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.append(0, np.cumsum(lengths))


def _rows(values: np.ndarray, starts: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
    return values[starts[which][:, None] + np.arange(n)]


def pivots(n: int, worth: int, least: int, few: int) -> int:
    """How many pivots n rows have."""
    return max(1, min(PIVOTS, max(n // worth, min(n // least, few))))


def nearest_pivots(v: np.ndarray, sample: np.ndarray | None, number: int = PIVOTS) -> np.ndarray:
    """The place of the nearest among the first sample vectors."""
    out = np.zeros(len(v), np.int32)
    if sample is not None and number > 1:
        p = sample[:number]
        for at in range(0, len(v), 4_096):
            out[at : at + 4_096] = ((p * p).sum(axis=1) - 2 * v[at : at + 4_096] @ p.T).argmin(axis=1)
    return out


def floors(q: np.ndarray, sample: np.ndarray | None, most: int) -> np.ndarray:
    """The `most`-th best score of each query in the sample, which the result can't fall below."""
    if sample is None or len(sample) < most:
        return np.full(len(q), -np.inf)
    return np.concatenate([np.partition(np.clip(q[at : at + BLOCK_QUERIES] @ sample.T, -1.0, 1.0), -most, axis=1)[:, -most] for at in range(0, len(q), BLOCK_QUERIES)]) - SLACK


def _blocks(names: np.ndarray, pivot: np.ndarray, v: np.ndarray, most_rows: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """(names, vectors, centre, radius) of blocks of one pivot."""
    order = np.lexsort((names, pivot))
    cuts = np.flatnonzero(np.append(True, pivot[order][1:] != pivot[order][:-1]))
    out = []
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
        for at in range(a, b, most_rows):
            own = order[at : min(b, at + most_rows)]
            centre = v[own].mean(axis=0)
            out.append((own, v[own], centre, float(np.sqrt(((v[own] - centre) ** 2).sum(axis=1).max()))))
    return out


class Best:
    """The best scores of a block of queries so far: (query, name, score), with some that the `most` best have passed."""

    def __init__(self, floor: np.ndarray, most: int):
        self.floor, self.most = floor.copy(), most
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        self.new = 0

    def add(self, query: np.ndarray, names: np.ndarray, scores: np.ndarray) -> None:
        self.held.append((query, names, scores))
        self.new += len(query)
        if self.new * 4 >= self.most * len(self.floor):
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best, by query, falling score and name."""
        query, names, scores = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((names, -scores, query))
        query = query[order]
        first = np.searchsorted(query, np.arange(len(self.floor)))
        on = np.arange(len(order)) - first[query] < self.most
        query, names, scores = query[on], names[order[on]], scores[order[on]]
        last = np.flatnonzero(np.bincount(query, minlength=len(self.floor)) == self.most)
        ends = np.searchsorted(query, last, "right") - 1
        self.floor[last] = np.fmax(self.floor[last], scores[ends])
        self.held, self.new = [(query, names, scores)], 0
        return self.held[0]


def reaching(score: np.ndarray, floor: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of unclamped scores that can be among the `most` best, with all that tie for the last place."""
    least = np.where(floor - SLACK <= -1.0, -np.inf, floor - SLACK)[:, None]
    on = ~(score < least)
    if score.shape[1] > most and on.sum() > most * len(score):  # the floors are low still
        on &= ~(score < np.minimum(np.partition(score, -most, axis=1)[:, [-most]], 1.0) - SLACK)
    return np.nonzero(on)


def met(queries: pa.Table, vectors: pa.Table, sample: dict[int, np.ndarray], most: int) -> pa.Table:
    """FOUND of one cell."""
    out: list[tuple[np.ndarray, ...]] = []
    q_values, q_starts = _matrix(queries["vector"])
    v_values, v_starts = _matrix(vectors["vector"])
    q_size, v_size = np.diff(q_starts), np.diff(v_starts)
    q_names, v_names = queries["id"].to_numpy(), vectors["id"].to_numpy()
    for n in np.intersect1d(q_size, v_size).tolist():
        qs, vs = np.flatnonzero(q_size == n), np.flatnonzero(v_size == n)
        all_v, all_q, near = _rows(v_values, v_starts, vs, n), _rows(q_values, q_starts, qs, n), sample.get(n)
        floor = floors(all_q, near, most)
        blocks = _blocks(v_names[vs], nearest_pivots(all_v, near, pivots(len(vs), WORTH_VECTORS, LEAST_VECTORS, FEW_VECTORS)), all_v, BLOCK_VECTORS)
        centres, radii = np.array([b[2] for b in blocks]), np.array([b[3] for b in blocks])
        for own, q, _, _ in _blocks(q_names[qs], nearest_pivots(all_q, near, pivots(len(qs), WORTH_QUERIES, LEAST_QUERIES, FEW_QUERIES)), all_q, BLOCK_QUERIES):
            length = np.sqrt((q * q).sum(axis=1))
            reach = q @ centres.T + length[:, None] * radii + SLACK * (1 + length[:, None])
            best, tried, skipped = Best(floor[own], most), 0, 0
            for at in np.argsort(-reach.max(axis=0), kind="stable").tolist():
                open_ = np.minimum(reach[:, at], 1.0) >= best.floor - SLACK
                if not open_.any():
                    skipped += 1
                    continue
                tried += 1
                rows, v, _, _ = blocks[at]
                one, other = reaching(q @ v.T, best.floor, most)
                step = max(1, EXACT_NUMBERS // n)
                exact = [(v[other[i : i + step]] * q[one[i : i + step]]).sum(axis=1) for i in range(0, len(one), step)]
                best.add(one, v_names[vs[rows]][other], np.clip(np.concatenate([np.zeros(0), *exact]), -1.0, 1.0))
            one, names_found, scores = best.cut()
            names = q_names[qs[own]][one]
            note = np.zeros((2, len(names)), np.int64)
            if len(names):
                note[:, 0] = tried, skipped
            out.append((names, names_found, scores, *note))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.int64, np.int64)]
    return pa.table(columns, names=["query_id", "segment_id", "score", "tried", "skipped"])


def grid(vectors: DataFrame, queries: DataFrame, most: int, cell_numbers: int = CELL_NUMBERS, query_numbers: int = QUERY_NUMBERS) -> DataFrame:
    """FOUND: of each cell the `most` best vectors of each query, and how many pairs of blocks were tried and skipped.

    vectors, queries: (id, vector). Only vectors of the query's length count; null and empty ones take no part.
    """
    spark = vectors.sparkSession
    rows, asked = (t.filter("size(vector) > 0").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")) for t in (vectors, queries))
    by_size: dict[int, list[list[float]]] = {}
    for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect():
        by_size.setdefault(len(r.vector), []).append(r.vector)
    sample = {n: np.array(v) for n, v in by_size.items()}
    count = lambda t, name: t.agg(F.count("*").alias(name), F.coalesce(F.sum(F.size("vector")), F.lit(0)).alias(f"{name}_numbers"))
    n = count(rows, "v").crossJoin(count(asked, "q")).first()  # one row each
    down = max(1, -(-n.v_numbers // cell_numbers), min(spark.sparkContext.defaultParallelism, n.v // LEAST_CELL))
    across = max(1, -(-n.q_numbers // query_numbers))
    deal = lambda parts, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(parts))
    cells = lambda others, place: F.explode(F.transform(F.sequence(F.lit(0), F.lit(others - 1)), place)).alias("cell")
    tasks = 4 * down * across  # by number, as cells are work that their bytes don't show; most are alone in a task
    left = asked.select("*", cells(down, lambda row: row * F.lit(across) + deal(across, 1))).repartition(tasks, "cell")
    right = rows.select("*", cells(across, lambda column: deal(down, 2) * F.lit(across) + column)).repartition(tasks, "cell")
    shared = spark.sparkContext.broadcast(sample)  # SAMPLE vectors
    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(lambda a, b: met(a, b, shared.value, most), FOUND)


def vector_rank(vectors: DataFrame, query_vectors: DataFrame, most: int, **cells: int) -> DataFrame:
    """(query_id, segment_id, score, place): the `most` best clamped dot products of each query, for equal lengths only.

    vectors: segment_id, vector; query_vectors: query_id, vector. Ties go to the smaller segment. Scores are sums in
    double of the products.
    """
    found = grid(vectors.select(F.col("segment_id").alias("id"), "vector"), query_vectors.select(F.col("query_id").alias("id"), "vector"), most, **cells)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "segment_id")
    return found.select("query_id", "segment_id", "score").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def skipped_share(found: DataFrame) -> float | None:
    """The share of pairs of blocks that a grid has skipped."""
    tried, skipped = found.agg(F.sum("tried"), F.sum("skipped")).first()
    return skipped / (tried + skipped) if tried is not None and tried + skipped else None
