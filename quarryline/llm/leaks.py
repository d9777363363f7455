"""Benchmark decontamination: which test items stand in which documents.

An item counts as leaked when a document holds 75 % or more of its five-word shingles. Similarity of whole texts says
nothing there, since documents are much longer than items; containment does. Items are partitioned by size, and each size
class has its own length of MinHash signature: an item of q shingles may miss q / 4 of them, so of its q / 4 + 1 least
hashes at least one is in every document that holds the item. Documents look up all their shingles in the signatures, and
each item that is hit is counted on its whole shingle set, word by word.

Items are a stated query set and go to the tasks in blocks of bounded size, one pass over the documents per block.
Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.words import WIDTH, normal, shingle_set, shingles, slices, windows, word_hashes

PERCENT = 75
#: Bytes of item texts in one block, an item at least: what every task holds in memory.
BLOCK_BYTES = 4 << 20


def signature_length(size: int) -> int:
    """Least hashes to keep for the size class of ``size``: sizes from a power of two up to the next share a length."""
    largest = (1 << size.bit_length()) - 1
    return min(size, largest * (100 - PERCENT) // 100 + 1)


class _Block:
    """The items of one block as lookup tables: signature hashes by width of window, and the items behind each."""

    def __init__(self, items: list[tuple[int | None, bytes]]):
        self.ids = [i for i, _ in items]
        self.sets = [shingle_set(text) for _, text in items]
        by_width: dict[int, list[tuple[int, int]]] = {}
        for at, (_, text) in enumerate(items):
            hashes = np.unique(shingles([text])[0])
            width = min(WIDTH, text.count(b" ") + 1)
            by_width.setdefault(width, []).extend((int(h), at) for h in hashes[: signature_length(len(hashes))])
        self.tables = {}
        for width, found in by_width.items():
            found.sort()
            keys = np.array([h for h, _ in found], np.uint64)
            self.tables[width] = keys, np.array([at for _, at in found], np.int64), _bits(keys)

    def candidates(self, normals: list[bytes]) -> set[tuple[int, int]]:
        """Pairs of text and item that share a signature hash."""
        hashes, offsets = word_hashes(normals)
        out = set()
        for width, (keys, items, bits) in self.tables.items():
            seen, begins = windows(hashes, offsets, width)
            at = np.flatnonzero(bits[seen >> np.uint64(64 - 20)])
            low, high = np.searchsorted(keys, seen[at], "left"), np.searchsorted(keys, seen[at], "right")
            hit = low < high
            texts = np.searchsorted(begins, at[hit], "right") - 1
            for text, a, b in zip(texts.tolist(), low[hit].tolist(), high[hit].tolist()):
                out.update((text, item) for item in items[a:b].tolist())
        return out

    def contained(self, text: bytes, item: int, held: set) -> int:
        """How many of the item's shingles the text has; an item of fewer than five words is one run of them."""
        wanted = self.sets[item]
        width = len(next(iter(wanted)))
        if width < WIDTH:
            words = text.split()
            return int(next(iter(wanted)) in zip(*(words[i:] for i in range(width))))
        return len(wanted & held)


def _bits(keys: np.ndarray) -> np.ndarray:
    """Which upper 20 bits occur, so that most shingles are dismissed by one look."""
    bits = np.zeros(1 << 20, bool)
    bits[keys >> np.uint64(64 - 20)] = True
    return bits


def _search(items: list[tuple[int | None, bytes]]):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(items)
        for batch in batches:
            texts, ids = [normal(t) for t in batch.column(1).cast(pa.binary()).to_pylist()], batch.column(0).to_pylist()
            rows = []
            for start, end in slices(texts):
                last, held = None, set()
                for text, item in sorted(block.candidates(texts[start:end])):
                    if text != last:
                        last, held = text, shingle_set(texts[start + text])
                    shared = block.contained(texts[start + text], item, held)
                    if 100 * shared >= PERCENT * len(block.sets[item]):
                        rows.append((ids[start + text], block.ids[item], len(block.sets[item]), shared))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "n_item_shingles", "n_shared"]
            )

    return search


def _blocks(benchmark: DataFrame, size: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """Items in blocks, read one partition after the other; an item is a whole row, so one item is the least block."""
    block, held = [], 0
    for row in benchmark.select("item_id", F.col("text").cast("binary").alias("text")).toLocalIterator():
        text = normal(row.text)
        if not text:
            continue
        if block and held + len(text) > size:
            yield block
            block, held = [], 0
        block.append((row.item_id, text))
        held += len(text)
    if block:
        yield block


def leaks(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, n_item_shingles, n_shared``: a row for each document that holds an item.

    ``documents`` needs ``doc_id`` and ``text``, ``benchmark`` needs ``item_id`` and ``text``; other columns are ignored.
    An item of fewer than five words is held by a document with that run of words. Null, empty and blank texts hold nothing
    and are in nothing. Repeated rows give repeated rows; null ids are carried along. Either table empty: no rows.
    """
    schema = "doc_id long, item_id long, n_item_shingles long, n_shared long"
    found = documents.sparkSession.createDataFrame([], schema)
    docs = documents.select("doc_id", "text")
    for items in _blocks(benchmark, block_bytes):
        found = found.union(docs.mapInArrow(_search(items), schema))
    return found


def keep_clean(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``documents`` that hold no item, with all their columns. The texts stay where they are: each row's
    struct passes through the search, which drops it when it finds something."""
    kept = documents
    for items in _blocks(benchmark, block_bytes):
        kept = kept.mapInArrow(_filter(items, documents.columns.index("text")), documents.schema)
    return kept


def _filter(items: list[tuple[int | None, bytes]], at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(items)
        for batch in batches:
            texts = [normal(t) for t in batch.column(at).cast(pa.binary()).to_pylist()]
            clean = np.ones(len(texts), bool)
            for start, end in slices(texts):
                for text, item in sorted(block.candidates(texts[start:end])):
                    if clean[start + text]:
                        shared = block.contained(texts[start + text], item, shingle_set(texts[start + text]))
                        clean[start + text] = 100 * shared < PERCENT * len(block.sets[item])
            yield batch.filter(pa.array(clean))

    return run
