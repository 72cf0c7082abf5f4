"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Entries c become whole numbers x = floor(64 * c) + 1000000. The fit list is each distinct x vector once: n of them,
with sums S in each dimension; it is written as blocks of packed vectors, and never leaves the tasks. Centred rows
are (n * x - S) / n, from exact differences.

Bidiagonalisation. X holds the centred rows of the fit list. Step k makes u_k = X v_k - beta_k u_{k-1} and
v_{k+1} = X'u_k - alpha_k v_k, both orthogonalised against all before. The long vectors u are never stored: each is
X p for a short p, so one scan of the blocks a step, in which every task makes u = X p of its rows and at once its
part of X'u, u'u and of u's products with all former u; the sums of the parts orthogonalise u (p and X'u are linear in
u). A scan is repeated where much had to be taken off, and until u is orthogonal to rounding. The short vectors v are
orthogonalised twice. Where alpha or beta vanishes, a new v orthogonal to all others starts afresh, so that equal
eigenvalues and dependent dimensions are found too. After as many steps as there are dimensions the singular values
and right vectors of the small bidiagonal matrix, turned by the v, are the deviations and components.

`tolerance`: None (the default) takes all steps. Else it stops once the wanted components' residuals are within
tolerance times the largest singular value, for vectors of many dimensions with few strong directions; copies of one
eigenvalue may then be missed.

Bounds: the driver holds matrices of (dimensions x dimensions); each scan sends it 2 * dimensions + 1 numbers,
summed on executors. `deviation` and sums are exact: in 64 bits where a bound on them shows that they fit, else in
Python's whole numbers.

Defined cases: rows with a null vector, or with null or non-finite entries, are dropped; entries that are more
than 2^56 in size count as 2^56. Vectors of different lengths aren't compared: each length is a fit of its own, and
empty vectors have no components. Components of eigenvalue 0 (to rounding) don't exist, so a table with fewer than two different
vectors gives no rows. Repeated ids, null ids and equal vectors each give their rows. A deviation that doesn't fit a
long is null. An empty table stays empty; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelore.llm.common import materialise

COMPONENTS = 16
SCALE, SHIFT, MOST = 64, 1_000_000, 1 << 62
BLOCK_NUMBERS = 1 << 18
#: A step's length below this share of the matrix's norm is rounding.
VANISHED = 1e-13

RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that take part."""
    v = F.col(vector_col)
    sound = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = lambda c: F.greatest(F.least(F.floor(c * F.lit(float(SCALE))), F.lit(MOST)), F.lit(-MOST))
    return vectors.filter(sound).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v.cast("array<double>"), lambda c: scaled(c) + F.lit(SHIFT)).alias("x"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def fit_blocks(rows: DataFrame, d: int) -> DataFrame:
    """The fit list as written blocks: `block` holds vectors one after another, as little-endian 64-bit numbers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK_NUMBERS // d)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = matrix(batch.column(0).slice(at, step), d)
                yield pa.RecordBatch.from_arrays([pa.array([part.astype("<i8").tobytes()], pa.binary())], ["block"])

    return materialise(rows.select("x").distinct().mapInArrow(pack, "block binary"), "fit")


def summed(blocks: DataFrame, d: int, part: Callable[[np.ndarray], np.ndarray], exact: bool = False) -> np.ndarray:
    """The sum of part(vectors) over the blocks, an array of one length: by place, first in each task, then on executors.

    With `exact`, parts are Python's whole numbers; they travel as decimals of two halves.
    """
    if exact:
        schema, fields = "place int, high decimal(20,0), low decimal(20,0)", ["place", "high", "low"]
    else:
        schema, fields = "place int, value double", ["place", "value"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for block in batch.column(0):
                now = part(np.frombuffer(block.as_buffer(), "<i8").reshape(-1, d))
                total = now if total is None else total + now
        if total is not None:
            columns = [pa.array(np.arange(len(total)), pa.int32())]
            if exact:
                columns += [pa.array([f(int(x)) for x in total], pa.decimal128(20)) for f in (lambda x: x >> 62, lambda x: x & (1 << 62) - 1)]
            else:
                columns.append(pa.array(total))
            yield pa.RecordBatch.from_arrays(columns, fields)

    sums = blocks.mapInArrow(add, schema).groupBy("place").agg(*[F.sum(c).alias(c) for c in fields[1:]])
    found = sorted(sums.collect())  # one row for each place
    if exact:
        return np.array([(int(r.high) << 62) + int(r.low) for r in found], object)
    return np.array([r.value for r in found])


def whole_sums(x: np.ndarray) -> np.ndarray:
    """[number of rows, then the sum in each dimension], exact, in Python's whole numbers."""
    fits = len(x) == 0 or int(np.abs(x).max()) < (1 << 62) // len(x)
    return np.array([len(x), *(x.sum(axis=0) if fits else x.astype(object).sum(axis=0))], object)


@dataclass
class Centre:
    """n and the sums of the fit list; exact differences from them."""

    n: int
    sums: list[int]

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit numbers where they fit, else Python's."""
        most = max(int(np.abs(x).max(initial=0)) * self.n, *map(abs, self.sums))
        if most < 1 << 62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - S / n in double precision."""
        return (self.apart(x) / self.n).astype(np.float64)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        apart = self.apart(x)
        size = np.abs(apart.astype(np.float64)).max(initial=0.0)
        if apart.dtype == object or size * size * x.shape[1] >= 2.0**62:
            total = (apart.astype(object) ** 2).sum(axis=1)
            return [int(s) if s < 1 << 63 else None for s in total]
        return (apart * apart).sum(axis=1).tolist()


@dataclass
class Fit:
    """Components (d x k) and eigenvalues of the covariance, its trace, and what whitening leaves off the identity."""

    centre: Centre
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centre.rows(x) @ self.components / np.sqrt(self.eigenvalues)


def off(vector: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """The vector without its part in the orthonormal basis, taken off twice."""
    if basis:
        v = np.array(basis)
        for _ in range(2):
            vector = vector - v.T @ (v @ vector)
    return vector


def bidiagonalise(scan: Callable[[np.ndarray, np.ndarray], tuple[float, np.ndarray, np.ndarray]], d: int, norm: float, wanted: int, tolerance: float | None = None, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right vectors in columns) of X.

    scan(p, P) gives u'u, (X P)'u and X'u of u = X p; P has the p of all former u in its columns.
    """
    draw = np.random.default_rng(seed)
    right: list[np.ndarray] = []  # v
    short: list[np.ndarray] = []  # p, with u = X p
    images: list[np.ndarray] = []  # X'u
    alphas: list[float] = []
    betas: list[float] = []  # betas[k] links u_{k-1} and v_k

    def fresh() -> np.ndarray:
        v = off(draw.normal(size=d), right)
        return v / np.linalg.norm(v)

    v, beta = fresh(), 0.0
    while True:
        p = v - beta * short[-1] if beta else v.copy()
        alpha, image, removed = 0.0, np.zeros(d), np.inf
        for _ in range(4):
            square, along, image = scan(p, np.array(short).T if short else np.zeros((d, 0)))
            before = np.sqrt(max(square, 0.0))
            for h, q, w in zip(along, short, images):
                p, image = p - h * q, image - h * w
            removed = np.linalg.norm(along)
            alpha = np.sqrt(max(square - removed**2, 0.0))
            if alpha <= VANISHED * norm or removed <= 1e-9 * before:
                break
        right.append(v)
        betas.append(beta)
        if alpha <= VANISHED * norm:
            alpha, p, image = 0.0, np.zeros(d), np.zeros(d)
        else:
            p, image = p / alpha, image / alpha
        alphas.append(alpha)
        short.append(p)
        images.append(image)
        k = len(right)
        if k == d:
            break
        rest = off(image - alpha * v, right)
        beta = float(np.linalg.norm(rest))
        if tolerance is not None and k > wanted:
            left, values, _ = np.linalg.svd(np.diag(alphas) + np.diag(betas[1:], 1))
            if (beta * np.abs(left[-1, :wanted]) <= tolerance * values[0]).all():
                break
        if beta > VANISHED * norm:
            v = rest / beta
        else:
            v, beta = fresh(), 0.0
    _, values, turned = np.linalg.svd(np.diag(alphas) + np.diag(betas[1:], 1))
    return values, np.array(right).T @ turned.T


def fit(blocks: DataFrame, d: int, components: int = COMPONENTS, tolerance: float | None = None) -> Fit | None:
    """The fit over the written blocks; None where no two vectors differ."""
    count_and_sums = summed(blocks, d, whole_sums, exact=True)
    if not len(count_and_sums) or count_and_sums[0] < 2:
        return None
    n = int(count_and_sums[0])
    centre = Centre(n, [int(s) for s in count_and_sums[1:]])
    total = float(summed(blocks, d, lambda x: np.array([(centre.rows(x) ** 2).sum()]))[0])

    def scan(p: np.ndarray, former: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def part(x: np.ndarray) -> np.ndarray:
            rows = centre.rows(x)
            u = rows @ p
            return np.concatenate([[u @ u], (rows @ former).T @ u, rows.T @ u])

        found = summed(blocks, d, part)
        k = former.shape[1]
        return float(found[0]), found[1 : 1 + k], found[1 + k :]

    values, vectors = bidiagonalise(scan, d, np.sqrt(total), components, tolerance)
    keep = min(components, int((values > values[0] * VANISHED * d).sum()))
    out = Fit(centre, vectors[:, :keep], values[:keep] ** 2 / n, total / n)

    def moments(x: np.ndarray) -> np.ndarray:
        z = out.whiten(x)
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    found = summed(blocks, d, moments) / n
    mean = found[:keep]
    out.identity_error = float(np.abs(found[keep:].reshape(keep, keep) - np.outer(mean, mean) - np.eye(keep)).max())
    return out


def whitened(rows: DataFrame, found: Fit) -> DataFrame:
    """RESULT of rows (vec_id, x) of the fit's length."""
    shared = rows.sparkSession.sparkContext.broadcast(found)  # a matrix of dimensions x components
    d = len(found.centre.sums)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        k = len(own.eigenvalues)
        explained = own.eigenvalues / own.trace
        for whole in batches:
            for at in range(0, whole.num_rows, step := max(1, BLOCK_NUMBERS // d)):
                batch = whole.slice(at, step)
                x = matrix(batch.column(1), d)
                m = len(x)
                columns = [
                    batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, own.centre.n)), pa.array(own.centre.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(own.whiten(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, own.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, RESULT)


def whiten(vectors: DataFrame, components: int = COMPONENTS, tolerance: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """RESULT for every row that takes part and each component."""
    rows = whole_numbers(vectors, id_col, vector_col)
    spark = vectors.sparkSession
    out = spark.createDataFrame([], RESULT)
    for size in rows.groupBy(F.size("x").alias("size")).count().orderBy("size").toLocalIterator():  # one row for each length
        if d := size["size"]:
            own = rows.filter(F.size("x") == d)
            found = fit(fit_blocks(own, d), d, components, tolerance)
            if found is not None:
                out = out.unionByName(whitened(own, found))
    return out
