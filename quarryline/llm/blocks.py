"""Work done once per distinct word of a corpus, and handed back to the documents that use the word.

Documents stay in blocks of neighbouring rows. A block sends out its distinct words, packed by bucket of their hash, so
that equal words of all blocks meet in one task, however frequent they are: a block sends a word once. The answers go
back to the block, where they meet its documents, in which words are numbers by then. Neither step moves a text.

Blocks are named by their texts. Both passes over the documents cut the same blocks because a partition is cut by the
sizes of its rows in their order; a block whose answers are missing stops the job rather than giving a wrong result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

#: Bytes of text in a block, a row at least; bytes of distinct words worked on at a time, and words that blocks have asked for
#: by then, each of them four bytes.
BLOCK_BYTES, WORK_BYTES, ASKED = 16 << 20, 4 << 20, 4 << 20
_SCHEMA = "block binary, bucket int, payload binary"


def varints(values: np.ndarray) -> bytes:
    """Non-negative numbers, seven bits a byte, the lowest first."""
    values = values.astype(np.uint64)
    if not len(values):
        return b""
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        more = values >> np.uint64(bits) > 0
        if not more.any():
            break
        sizes += more
    ends = np.cumsum(sizes)
    out = np.zeros(ends[-1], np.uint8)
    for i in range(sizes.max()):
        has = sizes > i
        part = (values[has] >> np.uint64(7 * i)).astype(np.uint8) & 127
        out[(ends - sizes)[has] + i] = part | np.where(sizes[has] > i + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def unvarints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.int64)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate(([0], ends[:-1] + 1))
    sizes = ends - starts + 1
    out = np.zeros(len(ends), np.int64)
    for i in range(sizes.max()):
        has = sizes > i
        out[has] |= (raw[starts[has] + i].astype(np.int64) & 127) << (7 * i)
    return out


def pack(*parts: bytes) -> bytes:
    head = struct.pack(f"<{len(parts) + 1}I", len(parts), *map(len, parts))
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def unpack(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    (n,) = struct.unpack_from("<I", raw)
    at, out = 4 + 4 * n, []
    for size in struct.unpack_from(f"<{n}I", raw, 4):
        out.append(raw[at : at + size])
        at += size
    return out


def pack_words(words: list[bytes]) -> bytes:
    return pack(varints(np.array([len(w) for w in words], np.int64)), b"".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    sizes, body = unpack(data)
    ends = np.cumsum(unvarints(sizes)).tolist()
    return [body[a:b] for a, b in zip([0, *ends], ends)]


class _Block:
    """Rows in a row of one partition: ids, texts, and their words as numbers, the most frequent first."""

    def __init__(self, ids: list, texts: list[bytes], words_of: Callable[[str], list[str]], buckets: int):
        self.ids, self.sizes = ids, [len(t) for t in texts]
        digest = hashlib.blake2b(digest_size=16)
        numbers: dict[str, int] = {}
        sequences = []
        for text in texts:
            digest.update(struct.pack("<q", len(text)) + text)
            sequences.append(np.array([numbers.setdefault(w, len(numbers)) for w in words_of(text.decode("utf-8", "replace"))], np.int32))
        self.name = digest.digest()
        counts = np.bincount(np.concatenate([*sequences, np.empty(0, np.int32)]), minlength=len(numbers))
        rank = np.empty(len(numbers), np.int32)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(numbers))
        self.sequences = [rank[s] for s in sequences]
        by_bucket: list[list[tuple[bytes, int]]] = [[] for _ in range(buckets)]
        for (word, _), r in zip(numbers.items(), rank.tolist()):
            raw = word.encode()
            by_bucket[zlib.crc32(raw) % buckets].append((raw, r))
        self.buckets = [sorted(b) for b in by_bucket]

    def order(self) -> np.ndarray:
        """The numbers of the words, in the order of buckets in which answers come back."""
        return np.array([r for bucket in self.buckets for _, r in bucket], np.int64)


def _cut(batches: Iterator[pa.RecordBatch], words_of, buckets: int, size: int) -> Iterator[_Block]:
    ids, texts, held = [], [], 0
    for batch in batches:
        for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            text = text or b""
            if texts and held + len(text) > size:
                yield _Block(ids, texts, words_of, buckets)
                ids, texts, held = [], [], 0
            ids.append(id_)
            texts.append(text)
            held += len(text)
    if texts:
        yield _Block(ids, texts, words_of, buckets)


def _rows(rows: list[tuple[bytes, int, bytes]]) -> pa.RecordBatch:
    blocks, buckets, payloads = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(blocks, pa.binary()), pa.array(buckets, pa.int32()), pa.array(payloads, pa.binary())],
        ["block", "bucket", "payload"],
    )


def _answers(batches: Iterator[pa.RecordBatch], solve) -> Iterator[pa.RecordBatch]:
    held: list[tuple[bytes, int, np.ndarray]] = []
    distinct: dict[bytes, int] = {}
    size = asked = 0

    def flush():
        take = solve(list(distinct))
        return [_rows([(block, bucket, take(numbers))]) for block, bucket, numbers in held]

    for batch in batches:
        for block, bucket, payload in zip(*(column.to_pylist() for column in batch.columns)):
            words = unpack_words(payload)
            before = len(distinct)
            numbers = np.array([distinct.setdefault(word, len(distinct)) for word in words], np.int32)
            size += sum(len(words[i]) for i in np.flatnonzero(numbers >= before).tolist())
            asked += len(words)
            held.append((block, bucket, numbers))
            if size > WORK_BYTES or asked > ASKED:
                yield from flush()
                held, distinct, size, asked = [], {}, 0, 0
    if held:
        yield from flush()


def _assembled(batches: Iterator[pa.RecordBatch], unpack_answers, assemble) -> Iterator[pa.RecordBatch]:
    """Rows come by block, what the block kept first (once for each block of the same texts), then its answers."""
    name, kept, answers, last = None, [], [], None

    def done():
        for payload in kept:
            ids, missing, sizes, order, lengths, words, times = unpack(payload)
            order = unvarints(order)
            if len(order) != len(answers):
                raise RuntimeError("a block's words and answers differ: the rows came in another order on the second pass")
            by_number: list = [None] * len(order)
            for number, answer in zip(order.tolist(), answers):
                by_number[number] = answer
            ids = [None if m else i for i, m in zip(np.frombuffer(ids, np.int64).tolist(), missing)]
            ends = np.cumsum(unvarints(lengths)).tolist()
            words = unvarints(words)
            sequences = [words[a:b] for a, b in zip([0, *ends], ends)]
            if times:
                times = unvarints(times)
                sequences = [(np.cumsum(s), times[a:b]) for s, a, b in zip(sequences, [0, *ends], ends)]
            yield assemble(ids, unvarints(sizes).tolist(), sequences, by_number)

    for batch in batches:
        for block, bucket, payload in zip(*(column.to_pylist() for column in batch.columns)):
            if block != name:
                yield from done()
                name, kept, answers, last = block, [], [], None
            if bucket < 0:
                kept.append(payload)
            elif bucket != last:  # blocks of the same texts ask for the same answers
                answers += unpack_answers(payload)
                last = bucket
    yield from done()


def per_distinct_word(
    documents: DataFrame,
    words_of: Callable[[str], list[str]],
    solve: Callable[[list[bytes]], Callable[[np.ndarray], bytes]],
    unpack_answers: Callable[[bytes], list],
    assemble: Callable[[list, list[int], list, list], pa.RecordBatch],
    schema: str,
    frequencies: bool = False,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Rows of ``schema`` that ``assemble`` makes of each block's ids, text sizes in bytes, words as numbers and answers.

    Documents come to ``assemble`` as their words in order or, with ``frequencies``, as pairs of distinct words and how
    often each stands there. ``words_of`` cuts a text, and ``solve`` answers distinct words: it gives back what packs the answers of
    the words of some numbers, their places in its list, into bytes. There are as many buckets as
    ``spark.sql.shuffle.partitions``; a task holds at most WORK_BYTES of distinct words and ASKED numbers at a time.
    """
    spark = documents.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = documents.select("doc_id", "text")

    def ask(batches):
        for block in _cut(batches, words_of, buckets, block_bytes):
            rows = [(block.name, i, pack_words([w for w, _ in found])) for i, found in enumerate(block.buckets) if found]
            if rows:
                yield _rows(rows)

    def keep(batches):
        for block in _cut(batches, words_of, buckets, block_bytes):
            sequences, times = block.sequences, []
            if frequencies:  # the distinct words of each document as steps from one number to the next
                found = [np.unique(s, return_counts=True) for s in sequences]
                sequences, times = [np.diff(s, prepend=0) for s, _ in found], [n for _, n in found]
            lengths = np.array([len(s) for s in sequences], np.int64)
            payload = pack(
                np.array([i or 0 for i in block.ids], np.int64).tobytes(),
                bytes(i is None for i in block.ids),
                varints(np.array(block.sizes, np.int64)),
                varints(block.order()),
                varints(lengths),
                varints(np.concatenate([*sequences, np.empty(0, np.int64)])),
                varints(np.concatenate([*times, np.empty(0, np.int64)])),
            )
            yield _rows([(block.name, -1, payload)])

    answers = docs.mapInArrow(ask, _SCHEMA).repartition(buckets, "bucket").mapInArrow(
        lambda batches: _answers(batches, solve), _SCHEMA
    )
    return (
        docs.mapInArrow(keep, _SCHEMA)
        .union(answers)
        .repartition(buckets, "block")
        .sortWithinPartitions("block", "bucket")
        .mapInArrow(lambda batches: _assembled(batches, unpack_answers, assemble), schema)
    )
