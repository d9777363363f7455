"""A toxicity classifier from confirmed toxic texts and unlabelled ones.

A text is described by its words without the marks around them and by the runs of five bytes inside its words (a blank may
stand at either end), each hashed to a bucket of its own kind. Buckets that are more frequent among positives than among
the unlabelled become features: whether the text has them, whatever its length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.pu import POSITIVES, UNLABELLED, learn_and_score
from quarryline.llm.words import mix, slices, word_hashes

WIDTH, BITS = 5, 20
#: Features at most; how many times as frequent they must be among positives, and by how many standard errors.
FEATURES, LIFT, ERRORS = 3000, 2.0, 5.0
_MARKS = str.maketrans({c: " " for c in ".,;:!?\"'()"})


def grams(texts: list[str]) -> list[np.ndarray]:
    """The buckets of each text, distinct and in order. Texts are lowered and their white space is made one blank."""
    normals = [b" " + " ".join(t.lower().split()).encode() + b" " for t in texts]
    out = []
    for start, end in slices(normals):
        part = normals[start:end]
        raw = np.frombuffer(b"\n".join(part), np.uint8)
        if len(raw) < WIDTH:
            out += [np.empty(0, np.int32)] * len(part)
            continue
        n = len(raw) - WIDTH + 1
        packed = np.zeros(n, np.uint64)
        inner = np.ones(n, bool)
        for i in range(WIDTH):
            byte = raw[i : n + i]
            packed = packed << np.uint64(8) | byte
            inner &= byte != 10
            if 0 < i < WIDTH - 1:
                inner &= byte != 32
        buckets = (mix(packed) >> np.uint64(64 - BITS)).astype(np.int32)
        at = 0
        for text in part:
            last = max(at, at + len(text) - WIDTH + 1)
            out.append(np.unique(buckets[at:last][inner[at:last]]))
            at += len(text) + 1
    return out


def words(texts: list[str]) -> list[np.ndarray]:
    """The buckets of each text's words, distinct and in order; marks that end words or sentences are blanks."""
    normals = [" ".join(t.lower().translate(_MARKS).split()).encode() for t in texts]
    out = []
    for start, end in slices(normals):
        hashes, offsets = word_hashes(normals[start:end])
        buckets = (hashes >> np.uint64(64 - BITS)).astype(np.int32)
        out += [np.unique(buckets[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    return out


def _describe(texts: list[str]) -> list[np.ndarray]:
    return [np.concatenate((g, w + np.int32(1 << BITS))) for g, w in zip(grams(texts), words(texts))]


def _prepare(positive: list[np.ndarray], unlabelled: list[np.ndarray]):
    counts = [
        np.bincount(np.concatenate([*rows, np.empty(0, np.float32)]).astype(np.int64), minlength=2 << BITS) for rows in (positive, unlabelled)
    ]
    p, u = counts[0] / len(positive), counts[1] / len(unlabelled)
    usual = np.maximum(u, 0.5 / len(unlabelled))
    gain = (p - u) / np.sqrt(usual / len(positive))
    gain[(p < LIFT * usual) | (gain < ERRORS)] = 0
    chosen = np.argsort(-gain, kind="stable")[:FEATURES]
    chosen = chosen[gain[chosen] > 0]
    column = np.full(2 << BITS, -1, np.int32)
    column[chosen] = np.arange(len(chosen))

    def matrix(rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(rows), len(chosen)), np.float32)
        for i, row in enumerate(rows):
            at = column[row.astype(np.int64)]
            out[i, at[at >= 0]] = 1
        return out

    return matrix


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def toxicity_scores(documents: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """One row per row of ``documents`` (``doc_id``, ``text``; others are ignored): ``doc_id, held_out, score, predicted``.

    Labels (``doc_id``, ``toxic``) are read as confirmed positives only, from rows that are not held out and at most
    ``positives`` of them; repeated ids count once, as positive if any row says so; null ids and labels are passed over.
    Null and empty texts have no features and get the score of none. A null ``doc_id`` is not held out. Without a positive
    row there is nothing to learn, and all scores are 0. An empty table gives an empty table.
    """
    return learn_and_score(documents, labels, "toxic", held_out(), _describe, _prepare, positives, unlabelled)
