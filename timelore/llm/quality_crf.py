"""Document quality from a linear-chain conditional random field over lines.

Each non-blank line is a step with state good or bad. The score of a good line is linear in features of the
line and of its two neighbours; a 2 x 2 matrix scores the change from line to line. Forward-backward
marginals P(good) of the lines, weighted by line length, give the document's mean, and a logistic curve
fitted on the training rows turns that mean into the score.

Training labels are per document. Lines start with the label of their document; twice, lines of bad
documents that the current field finds good with P > 0.5 become good (never all lines of a document: the
worst stays bad), and the field is fitted again. Lines of good documents stay good. Fitted on at most
`sample_docs` labelled documents (smallest hash of the id), with all their lines; scoring reads whole texts.
Inputs of a score are the text alone.

Defined cases: a null or empty text, or one of blanks only, is one empty line; very long texts are scored
whole, and a line holds N_OWN numbers in memory, neighbours being added as sums; rows without label are scored only; null labels aren't used; of several labels of a document the
smallest counts; without labels of both kinds the score is the smoothed share of good labels, 1 with none;
repeated rows and null ids are scored each; an empty table stays empty; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH_CHARS = 1 << 20
GOOD_FROM = 0.3

UPPER, LOWER, DIGIT, SPACE, MARK = range(5)


def _classes() -> np.ndarray:
    """The kind of each code point of the basic plane; all others count as letters."""
    table = np.full(1 << 16, LOWER, np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        table[i] = SPACE if c.isspace() else DIGIT if c.isdigit() else UPPER if c.isupper() else LOWER if c.isalpha() else MARK
    return table


_CLASS: list[np.ndarray] = []
_MIX = np.uint64(0x9E3779B97F4A7C15)
N_OWN = 21


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own features of all lines [L, N_OWN], characters of each line, lines of each text).

    Own features: shares of upper-case letters, marks, digits and bars, steps of these, lengths, repeats of
    the word before and repeats of earlier words of the line, repeats of an earlier line.
    """
    if not _CLASS:
        _CLASS.append(_classes())
    lines, counts = [], []
    for text in texts:
        own = [x for x in text.split("\n") if x and not x.isspace()] or [" "]
        lines += own
        counts.append(len(own))
    codes = np.frombuffer("\n".join(lines).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0", np.uint32)
    kind = _CLASS[0][np.minimum(codes, 0xFFFF)]
    kind[codes > 0xFFFF] = LOWER
    breaks = codes == 10
    ends = np.flatnonzero(breaks)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = (ends - starts + 1).astype(float)

    def per_line(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags.astype(np.float32), starts)

    upper, lower, digit, mark = (per_line(kind == k) for k in (UPPER, LOWER, DIGIT, MARK))
    bars = per_line(codes == 124)
    inside = kind != SPACE
    first = inside & np.concatenate([[True], ~inside[:-1]])
    words = per_line(first)
    word_at = np.flatnonzero(first)
    line_of = np.searchsorted(starts, word_at, side="right") - 1
    place = np.arange(len(codes), dtype=np.uint64)
    owner = np.cumsum(first) - 1
    head_of = word_at[np.maximum(owner, 0)] if len(word_at) else np.zeros(len(codes), np.int64)
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * (((place - np.where(inside, head_of, 0).astype(np.uint64)) * np.uint64(2) + np.uint64(1)) * _MIX)
    mixed[~inside] = 0
    hashes = np.add.reduceat(mixed, word_at) if len(word_at) else np.zeros(0, np.uint64)
    again = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])]) if len(hashes) else np.zeros(0, bool)
    repeats = np.bincount(line_of, again, len(lines))
    order = np.lexsort((hashes, line_of))
    seen = np.zeros(len(hashes), bool)
    if len(hashes):
        seen[order[1:]] = (hashes[order][1:] == hashes[order][:-1]) & (line_of[order][1:] == line_of[order][:-1])
    known = np.bincount(line_of, seen, len(lines))
    doc_of = np.repeat(np.arange(len(counts)), counts)
    line_hash = np.array([hash(x) for x in lines], np.int64)
    by = np.lexsort((np.arange(len(lines)), line_hash, doc_of))
    copy = np.zeros(len(lines), bool)
    copy[by[1:]] = (line_hash[by][1:] == line_hash[by][:-1]) & (doc_of[by][1:] == doc_of[by][:-1])
    letters = np.maximum(1, upper + lower)
    n_words = np.maximum(1, words)
    up, mk, dg, br, rp, kn = upper / letters, mark / size, digit / size, bars / n_words, repeats / n_words, known / n_words
    own = np.column_stack(
        [
            up, up > 0.3, up > 0.8, mk, mk > 0.08, mk > 0.2, dg, dg > 0.2, br, br > 0.3, rp, rp > 0.2, rp > 0.6, kn, kn > 0.7,
            copy, np.log1p(size) / 5, size < 20, letters / n_words / 10, letters / n_words > 15, np.log1p(n_words) / 5,
        ]
    ).astype(np.float32)
    return own, size, np.array(counts)


def neighbours(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the line before and of the line after within a text, zero at its ends."""
    before, after = np.zeros_like(values), np.zeros_like(values)
    before[1:], after[:-1] = values[:-1], values[1:]
    ends = np.cumsum(counts)
    before[np.append(0, ends[:-1])], after[ends - 1] = 0, 0
    return before, after


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """[L, 3 N_OWN]: own features, those of the line before and those of the line after."""
    return np.concatenate([own, *neighbours(own, counts)], axis=1)


@dataclass
class LineField:
    """Weights of a good line, bias, change scores (bad-bad, bad-good, good-bad, good-good) and the document curve."""

    weights: np.ndarray
    bias: float
    change: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None

    def marginals(self, own: np.ndarray, counts: np.ndarray) -> np.ndarray:
        here, before, after = (own @ w for w in self.weights.reshape(3, -1))
        level = here + neighbours(before, counts)[0] + neighbours(after, counts)[1] + self.bias
        return forward_backward(level, self.change, counts)[0]

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        own, size, counts = line_features(texts)
        mean = document_means(self.marginals(own, counts), size, counts)
        return 1 / (1 + np.exp(-np.clip(self.slope * _logit(mean) + self.offset, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def document_means(good: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    at = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return np.add.reduceat(good * size, at) / np.add.reduceat(size, at)


def forward_backward(level: np.ndarray, change: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(P(good) of each line, expected changes [2, 2], log of the partition sum) over all documents at once.

    Documents go side by side, longest first, so step t works on those that have a line t.
    """
    change_p = np.exp(change)
    good = np.exp(np.clip(level, -30, 30))
    order = np.argsort(-counts, kind="stable")
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])[order]
    sizes = counts[order]
    steps = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(steps), side="left")
    forward = np.zeros((len(level), 2))
    log_z = 0.0
    for t in range(steps):
        at = starts[: live[t]] + t
        now = np.column_stack([np.ones(len(at)), good[at]])
        if t:
            now *= forward[at - 1] @ change_p
        total = now.sum(axis=1, keepdims=True)
        log_z += np.log(total).sum()
        forward[at] = now / total
    pair = np.zeros((2, 2))
    back = np.ones((len(level), 2))
    for t in range(steps - 2, -1, -1):
        at = starts[: live[t + 1]] + t
        ahead = np.column_stack([np.ones(len(at)), good[at + 1]]) * back[at + 1]
        joint = forward[at][:, :, None] * change_p[None] * ahead[:, None, :]
        pair += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        new = ahead @ change_p.T
        back[at] = new / new.sum(axis=1, keepdims=True)
    both = forward * back
    return both[:, 1] / both.sum(axis=1), pair, log_z


def fit_field(features: np.ndarray, labels: np.ndarray, counts: np.ndarray, steps: int = 120, rate: float = 0.1, ridge: float = 1e-3) -> LineField:
    """Maximum likelihood of the line labels by Adam; the gradient is observed minus expected counts."""
    n, d = features.shape
    parts = np.zeros(d + 5)
    first, second = np.zeros_like(parts), np.zeros_like(parts)
    inner = np.ones(n, bool)
    inner[np.concatenate([[0], np.cumsum(counts)[:-1]])] = False
    here = np.flatnonzero(inner)
    seen = np.bincount(labels[here - 1] * 2 + labels[here], minlength=4)
    for step in range(1, steps + 1):
        good, pair, _ = forward_backward(features @ parts[:d] + parts[d], parts[d + 1 :].reshape(2, 2), counts)
        miss = labels - good
        grad = np.concatenate([features.T @ miss, [miss.sum()], seen - pair.ravel()]) / n - ridge * np.concatenate([parts[:d], np.zeros(1), parts[d + 1 :]])
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        parts = parts + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return LineField(parts[:d], float(parts[d]), parts[d + 1 :].reshape(2, 2))


def fit_documents(own: np.ndarray, size: np.ndarray, counts: np.ndarray, quality: np.ndarray, rounds: int = 2) -> LineField:
    features = with_neighbours(own, counts)
    doc_of = np.repeat(np.arange(len(counts)), counts)
    labels = quality[doc_of].astype(int)
    model = fit_field(features, labels, counts)
    for _ in range(rounds):
        alone = 1 / (1 + np.exp(-np.clip(features @ model.weights + model.bias, -30, 30)))
        worst = np.minimum.reduceat(alone, np.concatenate([[0], np.cumsum(counts)[:-1]]))[doc_of]
        labels = np.where(quality[doc_of] == 1, 1, (alone > 0.5) & (alone > worst)).astype(int)
        model = fit_field(features, labels, counts)
    mean = _logit(document_means(model.marginals(own, counts), size, counts))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps for the curve, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a * mean + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        x = np.column_stack([mean, np.ones(len(mean))])
        grad = x.T @ (quality - p) - 1e-2 * np.array([a - 1, b])
        move = np.linalg.solve((x * w[:, None]).T @ x + 1e-2 * np.eye(2), grad)
        a, b = a + np.clip(move[0], -1, 1), b + np.clip(move[1], -1, 1)
    model.slope, model.offset = float(a), float(b)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = 4_000, training: Column | None = None) -> LineField:
    """The field from labelled documents; `training` says which ids may be used (all but the held-out fold)."""
    allowed = training if training is not None else ~held_out(F.col("doc_id"))
    marks = labels.filter("quality is not null and doc_id is not null").filter(allowed).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for quality, text in zip(batch.column(0), batch.column(1), strict=True):
                features, size, _ = line_features([text.as_py()])
                features, size = features.astype("<f4"), size.astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([quality.as_py()], pa.int32()), pa.array([features.tobytes()]), pa.array([size.tobytes()])], ["quality", "features", "size"])

    sample = texts.join(F.broadcast(chosen), "doc_id").select("quality", "text")  # at most sample_docs small rows
    rows = sample.mapInArrow(featured, "quality int, features binary, size binary").collect()  # sample_docs rows
    quality = np.array([r["quality"] for r in rows])
    if not len(rows) or quality.min() == quality.max():
        return LineField(np.zeros(3 * N_OWN), 0.0, np.zeros((2, 2)), constant=float((quality.sum() + 1) / (len(rows) + 1)))
    order = sorted(range(len(rows)), key=lambda i: (zlib.crc32(rows[i]["features"]), rows[i]["quality"]))  # one order for any number of tasks
    own = np.concatenate([np.frombuffer(rows[i]["features"], "<f4").reshape(-1, N_OWN) for i in order]).astype(float)
    size = np.concatenate([np.frombuffer(rows[i]["size"], "<f4") for i in order]).astype(float)
    counts = np.array([len(rows[i]["size"]) // 4 for i in order])
    return fit_documents(own, size, counts, quality[order])


def chunked(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts with about BATCH_CHARS characters."""
    held, size = [], 0
    for x in texts:
        held.append(x)
        size += len(x)
        if size >= BATCH_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def scorer(model: LineField, id_and_text: DataFrame) -> DataFrame:
    """(doc_id, score) of (doc_id, text)."""
    shared = id_and_text.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.scores(x) for x in chunked(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["doc_id", "score"])

    return id_and_text.mapInArrow(rate, "doc_id long, score double")


def score(docs: DataFrame, model: LineField) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return scorer(model, texts).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))


def fit_and_score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return score(docs, fit(docs, labels, **options))


def keep_good(docs: DataFrame, model: LineField, at_least: float = GOOD_FROM) -> DataFrame:
    """The documents whose score is at least that, columns unchanged: the rows themselves pass through the scorer."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(at).to_pylist()]
            scores = [shared.value.scores(x) for x in chunked(texts)]
            yield batch.filter(pa.array((np.concatenate(scores) if scores else np.zeros(0)) >= at_least))

    return docs.mapInArrow(keep, docs.schema)
