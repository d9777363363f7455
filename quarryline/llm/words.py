"""Words and shingles of many texts at once: 64-bit hashes in numpy arrays, for use inside tasks.

Words are runs of anything but ASCII white space, with A-Z lowered. Hashes are the same in every task. Two different
words or shingles share a 64-bit hash about once in 10^19 pairs; where a result hangs on one pair of texts, callers
compare the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 5
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_STEP = np.uint64(0xD1B54A32D192ED03)
_SLICE = 1 << 20
_powers: list[np.ndarray] = []


def normal(text: bytes | None) -> bytes:
    """The words of a UTF-8 text, joined by one space. bytes.lower and bytes.split know ASCII only, as the words do."""
    return b" ".join((text or b"").lower().split())


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: list[bytes], size: int = _SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes, one text at least: what is turned into arrays at a time."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def pieces(batch: pa.RecordBatch, column: int, size: int = _SLICE) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``size`` bytes of one text column, one row at least; an empty batch as it is."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths, dtype=np.int64) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for the next slice."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * _SLICE)
        factors = np.full((2, size), 1, np.uint64)
        factors[0, 1:] = _BASE
        factors[1, 1:] = pow(_BASE, -1, 1 << 64)
        _powers[:] = list(np.cumprod(factors, axis=1))
    return _powers[0], _powers[1]


def word_hashes(normals: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of some normal texts, and where each text's words begin (and the last ones end)."""
    counts = np.array([t.count(b" ") + 1 if t else 0 for t in normals], np.int64)
    offsets = np.concatenate(([0], np.cumsum(counts)))
    buffer = np.frombuffer(b" ".join([t for t in normals if t]), np.uint8)
    if not len(buffer):
        return np.empty(0, np.uint64), offsets
    power, inverse = _table(len(buffer) + 1)
    ends = np.append(np.flatnonzero(buffer == 32), len(buffer))
    starts = np.append(0, ends[:-1] + 1)
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * power[: len(buffer)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), offsets


def windows(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every run of ``width`` words inside a text, in order, and where each text's runs begin."""
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    begins = np.concatenate(([0], np.cumsum(counts)))
    at = np.arange(begins[-1]) + np.repeat(offsets[:-1] - begins[:-1], counts)
    total = np.full(len(at), width, np.uint64)
    for i in range(width):
        total = total * _STEP + hashes[at + i]
    return mix(total), begins


def shingles(normals: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text's shingles, repeats included, and where they begin: runs of five words, or all words of a
    text that has fewer, or nothing."""
    hashes, offsets = word_hashes(normals)
    full, begins = windows(hashes, offsets, WIDTH)
    counts, words = np.diff(begins), np.diff(offsets)
    short = np.flatnonzero((words > 0) & (words < WIDTH))
    if not len(short):
        return full, begins
    counts[short] = 1
    all_begins = np.concatenate(([0], np.cumsum(counts)))
    out = np.empty(all_begins[-1], np.uint64)
    is_short = np.zeros(len(out), bool)
    is_short[all_begins[short]] = True
    out[~is_short] = full
    for i in short:
        out[all_begins[i]] = windows(hashes[offsets[i] : offsets[i + 1]], np.array([0, words[i]]), int(words[i]))[0][0]
    return out, all_begins


def shingle_set(normal_text: bytes) -> set[tuple[bytes, ...]]:
    """The shingles themselves, where two texts are compared word by word."""
    words = normal_text.split()
    if len(words) < WIDTH:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(WIDTH))))
