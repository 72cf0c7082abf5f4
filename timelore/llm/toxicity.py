"""Toxicity severity by cumulative-link ordinal regression on sparse words.

P(grade >= j) = sigmoid(w.x - theta_j), j = 1..K-1: one weight vector shared by all ordered thresholds.
x holds log(1 + count) of the words in a vocabulary chosen by association with the label. The output for
each document is the distribution's expected grade, with P(grade >= 1) as the score.

Where labels say only toxic or not, `severity_grades` orders the toxic rows: their grade 1..3 is the third
of the toxic rows, by the rate of strongly associated words, that they fall in.

These grades are proxies: the tables hold no severities, and they come from the same words that the model reads.

The model is fitted on at most `sample_rows` labelled rows (those with the smallest hash of their id) and
has at most `max_words` weights, of words whose association is LEAST_Z or more; weights have a normal prior of
precision PRIOR. Scoring reads every whole text.

Defined cases: a very long text is counted whole; a null or empty text has no words and gets the score of an empty vector; documents without a
label are only scored; null labels are not used; of several labels of a document the largest counts; with
no labels, or of one kind only, every score is that share of toxic rows (0 with none); repeated rows and
null ids are scored each; an empty table stays empty; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelore.llm.common import materialise

WORD = re.compile(r"\w+")
GRADES = 4
LEAST_Z, PRIOR = 1.75, 0.03


@dataclass
class OrdinalModel:
    """`words` maps a word to its weight; `thresholds` ascend."""

    words: dict[str, float] = field(default_factory=dict)
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, 30.0))

    def at_least(self, text: str) -> np.ndarray:
        """P(grade >= j) for j = 1..K-1."""
        counts = Counter(filter(self.words.__contains__, WORD.findall(text.lower())))
        level = sum(self.words[w] * np.log1p(n) for w, n in sorted(counts.items()))
        return 1 / (1 + np.exp(np.clip(self.thresholds - level, -30, 30)))


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, toxic, text) to (doc_id, toxic, words, counts, total)."""
    for batch in batches:
        counted = [Counter(WORD.findall(x.lower())) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([list(c) for c in counted], pa.list_(pa.string())), pa.array([list(c.values()) for c in counted], pa.list_(pa.int32())), pa.array([c.total() for c in counted], pa.int32())],
            ["doc_id", "toxic", "words", "counts", "total"],
        )


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """At most `sample_rows` labelled documents, chosen by hash of the id."""
    marks = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")  # at most sample_rows small rows


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 8_000, max_words: int = 4_000) -> OrdinalModel:
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, sample_rows)
    counted = materialise(sample.mapInArrow(word_counts, "doc_id long, toxic int, words array<string>, counts array<int>, total int"), "toxic-sample")
    n, n_toxic = counted.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < n_toxic < n:
        return OrdinalModel(thresholds=np.full(GRADES - 1, -30.0 if n and n_toxic else 30.0))
    rate = n_toxic / n
    seen = counted.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).filter("n >= 4")
    z = (F.col("t") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    vocabulary = {r.word: (i, r.z) for i, r in enumerate(seen.select("word", z.alias("z")).filter(F.abs("z") >= LEAST_Z).orderBy(F.abs("z").desc(), "word").limit(max_words).collect())}
    index = spark.sparkContext.broadcast({w: i for w, (i, _) in vocabulary.items()})

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[(index.value[w], c) for w, c in zip(ws, cs, strict=True) if w in index.value] for ws, cs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array([[i for i, _ in r] for r in rows], pa.list_(pa.int32())), pa.array([[c for _, c in r] for r in rows], pa.list_(pa.int32()))], ["toxic", "total", "at", "counts"])

    rows = counted.select("toxic", "words", "counts", "total").mapInArrow(indexed, "toxic int, total int, at array<int>, counts array<int>").collect()  # bounded by sample_rows and max_words
    strong = np.array([z for _, z in vocabulary.values()]) >= 4.0
    sizes = np.array([len(r["at"]) for r in rows])
    at = np.array([i for r in rows for i in r["at"]], np.int64)
    counts = np.array([c for r in rows for c in r["counts"]], float)
    owner = np.repeat(np.arange(len(rows)), sizes)
    hits = np.bincount(owner, counts * strong[at], len(rows)) / np.maximum(1, [r["total"] for r in rows])
    grades = severity_grades(np.array([r["toxic"] for r in rows]), hits)
    weights, thresholds = fit_ordinal(owner, at, np.log1p(counts), grades, len(vocabulary), ridge=PRIOR * len(vocabulary) / len(rows))
    return OrdinalModel({w: float(weights[i]) for w, (i, _) in vocabulary.items() if abs(weights[i]) > 1e-3}, thresholds)


def severity_grades(toxic: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """0 for clean rows; 1..GRADES-1 for toxic rows by the quantile of their rate among the toxic."""
    cuts = np.quantile(rate[toxic > 0], np.arange(1, GRADES - 1) / (GRADES - 1))
    return np.where(toxic > 0, 1 + np.searchsorted(cuts, rate, side="left"), 0)


def fit_ordinal(owner: np.ndarray, at: np.ndarray, value: np.ndarray, grades: np.ndarray, n_words: int, ridge: float = 0.02, steps: int = 250, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds by Adam on the mean log likelihood, thresholds as a first and log gaps."""
    n = len(grades)
    above = [np.clip((grades >= j).mean(), 1e-4, 1 - 1e-4) for j in range(1, GRADES)]
    start = np.array([-np.log(p / (1 - p)) for p in above])
    parts = np.concatenate([np.zeros(n_words), start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    first, second = np.zeros_like(parts), np.zeros_like(parts)

    def thresholds(p: np.ndarray) -> np.ndarray:
        return p[n_words] + np.concatenate([[0], np.cumsum(np.exp(p[n_words + 1 :]))])

    for step in range(1, steps + 1):
        w, theta = parts[:n_words], thresholds(parts)
        level = np.bincount(owner, w[at] * value, n)
        ge = 1 / (1 + np.exp(np.clip(theta[None, :] - level[:, None], -30, 30)))
        edges = np.column_stack([np.ones(n), ge, np.zeros(n)])
        i = np.arange(n)
        p = np.maximum(edges[i, grades] - edges[i, grades + 1], 1e-9)
        slope = np.column_stack([np.zeros(n), ge * (1 - ge), np.zeros(n)])
        d_level = -(slope[i, grades] - slope[i, grades + 1]) / p / n
        d_theta = np.zeros(GRADES + 1)
        np.add.at(d_theta, grades, slope[i, grades] / p / n)
        np.add.at(d_theta, grades + 1, -slope[i, grades + 1] / p / n)
        d_theta = d_theta[1:-1]
        gaps = np.exp(parts[n_words + 1 :])
        tails = np.cumsum(d_theta[::-1])[::-1]
        grad = np.concatenate([np.bincount(at, d_level[owner] * value, n_words) + ridge * w / n_words, tails[:1], tails[1:] * gaps])
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        parts = parts - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return parts[:n_words], thresholds(parts)


def score(docs: DataFrame, model: OrdinalModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, score = P(grade >= 1), expected_severity, grade (most likely), predicted (score >= threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_words

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ge = np.array([shared.value.at_least(x) for x in batch.column(1).to_pylist()]).reshape(-1, GRADES - 1)
            each = np.column_stack([np.ones(len(ge)), ge]) - np.column_stack([ge, np.zeros(len(ge))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ge[:, 0]), pa.array(ge.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array((ge[:, 0] >= threshold).astype(np.int32))],
                ["doc_id", "score", "expected_severity", "grade", "predicted"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(rate, "doc_id long, score double, expected_severity double, grade int, predicted int")


def fit_and_score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return score(docs, fit(docs, labels, **options))
