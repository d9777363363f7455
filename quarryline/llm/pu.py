"""Learning from positives and unlabelled texts: the class prior, the corrected risk, and the passes over the corpus.

Only labels that say "positive" are ever read. All other texts are unlabelled, positives among them; what negatives look
like follows by taking the share of positives, the class prior, out of the unlabelled risk. That difference must not fall
below zero: where it does, the step goes the other way (non-negative risk).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on: positives, and rows whose labels are not looked at.
POSITIVES, UNLABELLED = 3000, 9000
#: Bins of scores from which the prior is read, over all documents.
BINS = 256


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass(frozen=True)
class Linear:
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(x @ self.weights + self.bias)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> Linear:
    """Logistic loss with the non-negative risk; Adam over all rows at each step, and the weights of least risk
    stay."""
    prior = np.float32(prior)
    w = np.zeros(positive.shape[1] + 1, np.float32)
    p = np.hstack([positive, np.ones((len(positive), 1), np.float32)], dtype=np.float32)
    u = np.hstack([unlabelled, np.ones((len(unlabelled), 1), np.float32)], dtype=np.float32)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    best, least = w, np.inf
    for step in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        minus = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        risk = prior * np.logaddexp(0, -zp).mean() + max(minus, 0) + decay * (w @ w) / 2
        if risk < least:
            best, least = w, risk
        down = u.T @ _sigmoid(zu) / len(u) - prior * (p.T @ _sigmoid(zp)) / len(p)
        gradient = down - prior * (p.T @ _sigmoid(-zp)) / len(p) if minus >= 0 else -down
        gradient = gradient + decay * w
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient * gradient
        w = w - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    # the risk is flat around its best bias: take the one by which as many unlabelled texts are positive as the prior says
    bias = best[-1] - np.quantile(u @ best, 1 - prior)
    return Linear(best[:-1].astype(np.float64), float(bias))


def bins(scores: np.ndarray) -> np.ndarray:
    """Scores as counts by bin of their logit, which tells very high scores apart."""
    scores = np.clip(scores, 1e-6, 1 - 1e-6)
    at = (np.log(scores / (1 - scores)) + 14) / 28 * BINS
    return np.bincount(np.clip(at, 0, BINS - 1).astype(np.int64), minlength=BINS)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.2) -> float:
    """The share of positives among the unlabelled, from counts by bin.

    Above any score, unlabelled texts hold at least prior times the share that positives have there; the least such ratio
    bounds the prior, and is near it where hardly a negative scores that high. Each ratio is raised by its own standard
    error, so that small counts do not give the bound, and at least ``least`` of the positives must lie above.
    """
    n_p, n_u = positive.sum(), unlabelled.sum()
    above_p, above_u = positive[::-1].cumsum() / n_p, unlabelled[::-1].cumsum() / n_u
    fits = (above_p >= least) & (above_u > 0)
    p, u = above_p[fits], above_u[fits]
    ratio = u / p * (1 + np.sqrt((1 - u) / (u * n_u)) + np.sqrt((1 - p) / (p * n_p)))
    return float(np.clip(ratio.min(initial=0.98), 0.005, 0.98))


def _sample(documents: DataFrame, labels: DataFrame, label: str, trains: Column, positives: int, unlabelled: int) -> DataFrame:
    """``doc_id, is_positive``, bounded: the ids whose hashes come first, positives among those with labels and unlabelled
    among all documents of the fold, labelled or not."""
    trained = F.col("doc_id").isNotNull() & trains
    known = labels.where(trained).groupBy("doc_id").agg(F.max(label).alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    first = known.where("label = 1").orderBy(*order).limit(positives).select("doc_id", F.lit(1).alias("is_positive"))
    rest = documents.where(trained).select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(unlabelled)
    return first.union(rest.select("doc_id", F.lit(0).alias("is_positive")))


def _texts(column: pa.Array) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]


def learn_and_score(
    documents: DataFrame,
    labels: DataFrame,
    label: str,
    held_out: Column,
    describe: Callable[[list[str]], list[np.ndarray]],
    prepare: Callable[[list[np.ndarray], list[np.ndarray]], Callable[[list[np.ndarray]], np.ndarray]],
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``documents``.

    ``describe`` gives raw features of texts, ``prepare`` looks at those of the sample and gives a function from raw
    features to rows of a matrix. ``held_out`` is over ``doc_id``. The classifier is fitted on at most ``positives`` and
    ``unlabelled`` rows of the other fold; the prior is read from all documents.
    """
    docs = documents.select("doc_id", "text")
    sample = F.broadcast(_sample(docs, labels, label, ~F.coalesce(held_out, F.lit(False)), positives, unlabelled))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = describe(_texts(batch.column(0)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([f.astype(np.float32).tobytes() for f in found], pa.binary())], ["is_positive", "raw"]
            )

    rows = docs.join(sample, "doc_id").select("text", "is_positive").mapInArrow(raw, "is_positive int, raw binary").collect()
    others, found = [[np.frombuffer(r.raw, np.float32) for r in rows if r.is_positive == kind] for kind in (0, 1)]
    del rows  # the raw features take as much as the matrices; the driver holds only these from here on
    model, matrix = None, None
    if found and others:
        matrix = prepare(found, others)
        p, u = matrix(found), matrix(others)
        del found, others
        half = len(p) // 2 or 1
        first = fit(p[:half], u, 0.5, decay=3e-3)  # no prior yet: it only has to rank, and to do so on unseen texts

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(BINS, np.int64)
            for batch in batches:
                total += bins(first.score(matrix(describe(_texts(batch.column(0))))))
            yield pa.RecordBatch.from_arrays([pa.array(range(BINS), pa.int32()), pa.array(total, pa.int64())], ["bin", "n"])

        counted = docs.select("text").mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))
        everything = np.zeros(BINS, np.int64)
        for row in counted.collect():
            everything[row.bin] = row.n
        prior = class_prior(bins(first.score(p[half:] if len(p) > 1 else p)), np.maximum(everything, 0))
        model = fit(p, u, prior)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column(2))
            scores = model.score(matrix(describe(texts))) if model else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text").mapInArrow(
        score, "doc_id long, held_out boolean, score double, predicted int"
    )
