"""A quality classifier from trusted good texts and unlabelled ones.

A text is described by some twenty measures of its words, signs and repetitions. Each measure is cut at quantiles of the
unlabelled sample, and the classifier adds up one weight per measure and step.
"""

from __future__ import annotations

import operator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.pu import POSITIVES, UNLABELLED, learn_and_score

_SIGNS = "#*$%&|<>~^=_{}[]@/\\"
STEPS = 12


def measures(text: str) -> np.ndarray:
    words = text.split()
    n, size = max(len(words), 1), max(len(text), 1)
    lines = [line for line in text.split("\n") if line.strip()]
    low = [w.lower() for w in words]
    endless = sum(map(operator.eq, low, low[1:]))
    windows = len(low) - 2
    return np.array(
        [
            np.log1p(len(words)),
            np.log1p(size / n),
            sum(map(text.count, _SIGNS)) / n,
            text.count("!") / n,
            text.count("|") / n,
            text.count("?") / n,
            text.count(".") / n,
            text.count(",") / n,
            sum(map(text.count, "0123456789")) / n,
            sum(map(str.isupper, words)) / n,
            sum(map(str.istitle, words)) / n,
            endless / n,
            len(set(low)) / n,
            1 - len(set(zip(low, low[1:], low[2:]))) / windows if windows > 0 else 0,
            1 - len(set(lines)) / len(lines) if lines else 0,
            np.log1p(max(map(len, words), default=0)),
            sum(map(str.isalpha, words)) / n,
            np.log1p(size / (len(lines) or 1)),
        ],
        np.float32,
    )


def _describe(texts: list[str]) -> list[np.ndarray]:
    return [measures(t) for t in texts]


def _prepare(positive: list[np.ndarray], unlabelled: list[np.ndarray]):
    """Steps at quantiles of both sets: for each measure and cut, whether the measure is above the cut."""
    shares = np.concatenate([[0.005, 0.02], np.linspace(0.05, 0.95, STEPS), [0.98, 0.995]])
    both = np.concatenate([np.stack(unlabelled), np.stack(positive)])
    cuts = np.quantile(both, shares, axis=0).T.astype(np.float32)

    def matrix(rows: list[np.ndarray]) -> np.ndarray:
        if not rows:
            return np.zeros((0, cuts.size), np.float32)
        x = np.stack(rows)
        return (x[:, :, None] > cuts[None]).reshape(len(x), -1).astype(np.float32)

    return matrix


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def quality_scores(documents: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """One row per row of ``documents`` (``doc_id``, ``text``; others are ignored): ``doc_id, held_out, score, predicted``.

    Labels (``doc_id``, ``quality``) are read as trusted positives only, from rows that are not held out and at most
    ``positives`` of them; repeated ids count once, as positive if any row says so; null ids and labels are passed over.
    Null and empty texts are described like any other. A null ``doc_id`` is not held out. Without a positive row there is
    nothing to learn, and all scores are 0. An empty table gives an empty table.
    """
    return learn_and_score(documents, labels, "quality", held_out(), _describe, _prepare, positives, unlabelled)
