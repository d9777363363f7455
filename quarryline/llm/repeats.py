"""Bytes inside strings of 400 bytes that stand anywhere else too, found by a run-length index.

Windows of 400 bytes are dealt to bins by their minimizer: the run of 32 bytes in them whose hash is least. Equal windows
have equal minimizers, so a bin holds all that a window could match. Neighbouring windows of one minimizer travel as one
segment, and only bins with two segments or more are looked into.

Segments that are equal as a whole are repeated as a whole. The distinct segments of a bin are concatenated and indexed:
their Burrows-Wheeler transform is kept as runs with the suffixes at both ends of each run. Inside a run, the longest
match of a suffix with its neighbour is one less than that of the suffix one byte to the left, so matches are compared at
run ends only and streamed along the text from there. Repetitive bins have few runs.

A bin of very many distinct segments is not put into one task: its windows are counted one by one, by their digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.words import mix, slices
from quarryline.session import workspace

LENGTH = 400
#: Bytes of segments indexed at a time, and bytes of distinct segments from which a bin is counted window by window: an
#: index takes about eighty bytes of memory for each of its text.
INDEX_BYTES, WIDE_BIN = 1 << 20, 4 << 20

_BASE = 0x9E3779B97F4A7C15
_ROWS = "text binary, first int, last int, bin long, segment long, n long"


_SPANS = "array<struct<start:long,end:long>>"


def _gram(length: int) -> int:
    """Bytes of a minimizer."""
    return max(1, length * 2 // 25)


def _name(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _number(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours: from the right inside blocks, and from the left inside the next."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def segments(texts: list[bytes], length: int) -> list[list[tuple[int, int, int]]]:
    """For each text its segments as ``first window, last window, bin``; texts shorter than ``length`` have none."""
    gram = _gram(length)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, end in slices(texts):
        raw = np.frombuffer(b"".join(texts[start:end]), np.uint8)
        if len(raw) < length:
            continue
        hashes, width = raw.astype(np.uint64) + np.uint64(1), 1
        total, at, rest = None, 0, gram
        while rest:  # hashes of `width` bytes from those of half as many, put together by the bits of `gram`
            if rest & 1:
                part = hashes[at:]
                total = part if total is None else total[: len(part)] * np.uint64(pow(_BASE, width, 1 << 64)) + part[: len(total)]
                at += width
            rest >>= 1
            if rest:
                hashes = hashes[: len(hashes) - width] * np.uint64(pow(_BASE, width, 1 << 64)) + hashes[width:]
                width *= 2
        n = len(raw) - gram + 1
        grams = mix(total[:n])
        bits = np.uint64(n.bit_length())
        least = _window_minima((grams >> bits << bits) | np.arange(n, dtype=np.uint64), length - gram + 1)
        chosen = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        base = 0
        for i in range(start, end):
            windows = len(texts[i]) - length + 1
            if windows > 0:
                own = chosen[base : base + windows]
                cuts = np.flatnonzero(own[1:] != own[:-1])
                firsts = np.concatenate(([0], cuts + 1))
                lasts = np.append(cuts, windows - 1)
                bins = grams[own[firsts]].view(np.int64)
                out[i] = list(zip(firsts.tolist(), lasts.tolist(), bins.tolist()))
            base += len(texts[i])
    return out


#: Bytes in the first key of a suffix: nine bits each, so that the end of the text differs from every byte.
_FIRST = 7


def _keys(text: np.ndarray) -> np.ndarray:
    """The first bytes of every suffix as one number."""
    n = len(text)
    padded = np.concatenate((text.astype(np.uint16) + np.uint16(1), np.zeros(_FIRST, np.uint16)))
    key = np.zeros(n, np.uint64)
    for i in range(_FIRST):
        key <<= np.uint64(9)
        key |= padded[i : n + i]
    return key


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The places of all suffixes in order, by doubling: names of strings of 7, 14, 28 … bytes until all differ."""
    n, size, key = len(text), _FIRST, _keys(text)
    name = np.empty(n, np.int32)
    while True:
        order = np.argsort(key).astype(np.int32)
        key = key[order]
        name[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1]))).astype(np.int32)
        if name[order[-1]] == n - 1:
            return order
        key = name.astype(np.uint64) << np.uint64(32)
        key[: max(n - size, 0)] |= name[size:].astype(np.uint64) + np.uint64(1)
        size *= 2


class RunIndex:
    """The Burrows-Wheeler transform of a text as runs, with the suffixes at both ends of each run."""

    def __init__(self, text: np.ndarray):
        order = suffix_array(text)
        before = text[order - 1].astype(np.int16)
        before[order == 0] = -1
        change = np.flatnonzero(before[1:] != before[:-1]) + 1
        self.heads, self.tails = np.concatenate(([0], change)), np.append(change, len(text)) - 1
        self.letters = before[self.heads]
        self._order, self._text, self._key = order, text, _keys(text)

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How long the strings at ``a`` and ``b`` agree: some bytes at a time while they do, then byte by byte."""
        n, length = len(self._text), np.zeros(len(a), np.int64)
        going = np.arange(len(a))
        for size, names in ((_FIRST, self._key), (1, self._text)):
            while len(going):
                at_a, at_b = a[going] + length[going], b[going] + length[going]
                inside = np.maximum(at_a, at_b) + size <= n
                same = inside & (names[np.where(inside, at_a, 0)] == names[np.where(inside, at_b, 0)])
                going = going[same]
                length[going] += size
            going = np.arange(len(a))
        return length

    def matching(self) -> np.ndarray:
        """The longest match of the string at each place with one elsewhere: the better of its two neighbours in order."""
        n, best = len(self._text), 0
        for ends, step in ((self.heads, -1), (self.tails, 1)):
            ends = ends[(ends + step >= 0) & (ends + step < n)]
            here, there = self._order[ends].astype(np.int64), self._order[ends + step].astype(np.int64)
            reach = np.zeros(n, np.int64)
            reach[here] = here + self._common(here, there)
            best = np.maximum(best, np.maximum.accumulate(reach) - np.arange(n))
        return best


def _stored(frame: DataFrame, label: str) -> DataFrame:
    path = workspace(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _bytes(column: pa.Array) -> list[bytes]:
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def _segment_rows(length: int):
    """Segments of the texts, ``n`` being 2 where a text repeats one inside itself. A segment that a text repeats comes
    once, and its places come as rows without ``bin``, which say that these windows are repeated for certain."""
    names = ["text", "first", "last", "bin", "segment", "n"]
    types = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            texts = _bytes(batch.column(0))
            for text, found in zip(texts, segments(texts, length)):
                name = _name(text)
                places: dict[int, list[tuple[int, int, int]]] = {}
                for first, last, bin_ in found:
                    places.setdefault(_number(text[first : last + length]), []).append((first, last, bin_))
                sure = []
                for number, at in places.items():
                    rows.append((name, *at[0], number, min(len(at), 2)))
                    if len(at) > 1:
                        sure += [(first, last) for first, last, _ in at]
                for first, last in _joined(sorted(sure), 0):
                    rows.append((name, first, last, None, None, 2))
                if len(rows) > 50_000:
                    yield _batch(rows, names, types)
                    rows = []
            yield _batch(rows, names, types)

    return run


def _joined(ranges: list[tuple[int, int]], gap: int) -> list[tuple[int, int]]:
    """Ranges in order, those at most ``gap`` + 1 apart made one."""
    out: list[tuple[int, int]] = []
    for first, last in ranges:
        if out and first <= out[-1][1] + gap + 1:
            out[-1] = out[-1][0], max(last, out[-1][1])
        else:
            out.append((first, last))
    return out


def _contents(length: int):
    """The bytes of segments from texts and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for packed, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = zstandard.ZstdDecompressor().decompress(packed)
                for p in places:
                    rows.append((p["bin"], p["segment"], p["n"], text[p["first"] : p["last"] + length], p["wide"]))
                    if len(rows) >= 5_000:
                        yield _batch(rows, ["bin", "segment", "n", "content", "wide"], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()])
                        rows = []
            yield _batch(rows, ["bin", "segment", "n", "content", "wide"], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()])

    return run


def _indexed(length: int):
    """For each segment that stands once, the ranges of its windows that stand in others. Rows come by bin; whole bins are
    put into one index until it is full."""

    def repeated(held: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        rows = []
        if held:
            starts = np.cumsum([0] + [len(content) + 1 for *_, content in held])
            text = np.frombuffer(b"".join(content + b"\xff" for *_, content in held), np.uint8)
            enough = RunIndex(text).matching() >= length
            for (bin_, segment, n, content), start in zip(held, starts.tolist()):
                if n == 1:
                    windows = np.concatenate(([False], enough[start : start + len(content) - length + 1], [False]))
                    edges = np.flatnonzero(windows[1:] != windows[:-1]).tolist()
                    rows += [(bin_, segment, a, b - 1) for a, b in zip(edges[::2], edges[1::2])]
        return _batch(rows, ["bin", "segment", "a", "b"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if size > INDEX_BYTES and row[0] != held[-1][0]:
                    yield repeated(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        yield repeated(held)

    return run


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bin_, segment, n, content in zip(*(column.to_pylist() for column in batch.columns)):
                rows = [(bin_, segment, n, i, hashlib.blake2b(content[i : i + length], digest_size=16).digest()) for i in range(len(content) - length + 1)]
                yield _batch(rows, ["bin", "segment", "n", "at", "window"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts by name, compressed for the exchange."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = _bytes(batch.column(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array([_name(t) for t in texts], pa.binary()), pa.array([squeeze.compress(t) for t in texts], pa.binary())], ["text", "packed"]
        )


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = _bytes(batch.column(1))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(map(len, texts), pa.int64()),
                pa.array([_name(t) for t in texts], pa.binary()),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                pc.fill_null(batch.column(1).cast(pa.string()), ""),
            ],
            ["doc_id", "n_bytes", "text", "whole_sha256", "whole"],
        )


def _removed(length: int):
    """What is left of each text without its repeated ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, packed, ranges in zip(*(column.to_pylist() for column in batch.columns)):
                text = zstandard.ZstdDecompressor().decompress(packed)
                spans = _joined(sorted((r["first"], r["last"] + length - 1) for r in ranges), 0)
                kept, at = [], 0
                for first, last in spans:
                    kept.append(text[at:first])
                    at = last + 1
                rest = b"".join(kept) + text[at:]
                out = [{"start": first, "end": last + 1} for first, last in spans]
                rows.append((name, len(text) - len(rest), out, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "replace")))
            listed = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield _batch(rows, ["text", "n_removed", "spans", "rest_sha256", "rest"], [pa.binary(), pa.int64(), listed, pa.string(), pa.string()])

    return run


def remove_repeats(documents: DataFrame, length: int = LENGTH, wide_bin: int = WIDE_BIN) -> DataFrame:
    """One row per row of ``documents`` (columns ``doc_id`` and ``text``; others are ignored): ``doc_id, n_bytes,
    n_removed, n_spans, kept_sha256, spans, text``: ``spans`` are the bytes that go as an array of ``start, end`` (end
    exclusive), in order and apart from each other; ``text`` is what is left without them, as UTF-8 (a character cut at
    the edge of a span becomes U+FFFD there; ``kept_sha256`` is of the exact bytes).

    A byte goes when a string of ``length`` bytes that covers it starts anywhere else in the input, in the same text or
    another; copies of a text are other texts, so repeated rows lose all their strings. Null texts are empty; texts shorter
    than ``length`` lose nothing; a null ``doc_id`` is carried along; an empty table gives an empty table.
    """
    text = documents.select("text")
    found = _stored(text.mapInArrow(_segment_rows(length), _ROWS), "segments")
    sure = found.where("bin IS NULL").select("text", "first", "last")
    shared = found.where("bin IS NOT NULL").groupBy("bin").agg(F.sum("n").alias("k")).where("k > 1").select("bin")
    rows = _stored(found.join(shared, "bin", "left_semi").select("text", "first", "last", "bin", "segment", "n"), "shared")
    distinct = _stored(
        rows.groupBy("bin", "segment").agg(F.sum("n").alias("n"), F.min(F.struct("text", "first", "last")).alias("place")), "distinct"
    )
    size = F.sum(F.col("place.last") - F.col("place.first") + length)
    mixed = distinct.groupBy("bin").agg(F.count("*").alias("k"), size.alias("size"), F.min("n").alias("least")).where("k > 1 AND least = 1")
    wanted = (
        distinct.join(mixed.select("bin", (F.col("size") > wide_bin).alias("wide")), "bin")
        .select(F.col("place.text").alias("text"), F.struct("bin", "segment", "n", "place.first", "place.last", "wide").alias("p"))
        .groupBy("text")
        .agg(F.collect_list("p").alias("places"))
    )
    packed = text.where(F.octet_length("text") >= length).mapInArrow(_packed, "text binary, packed binary").groupBy("text").agg(F.any_value("packed").alias("packed"))
    contents = _stored(
        packed.join(wanted, "text")
        .select("packed", "places")
        .mapInArrow(_contents(length), "bin long, segment long, n long, content binary, wide boolean"),
        "contents",
    )
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = (
        contents.where("NOT wide")
        .drop("wide")
        .repartition(partitions, "bin")
        .sortWithinPartitions("bin")
        .mapInArrow(_indexed(length), "bin long, segment long, a int, b int")
    )
    windows = contents.where("wide").drop("wide").mapInArrow(_windows(length), "bin long, segment long, n long, at int, window binary")
    seen = windows.groupBy("window").agg(F.sum("n").alias("k")).where("k > 1").select("window")
    counted = windows.where("n = 1").join(seen, "window", "left_semi").select("bin", "segment", F.col("at").alias("a"), F.col("at").alias("b"))
    partly = (
        narrow.union(counted).groupBy("bin", "segment").agg(F.collect_list(F.struct("a", "b")).alias("inside"))
    )
    single = (
        rows.join(distinct.where("n = 1").select("bin", "segment"), ["bin", "segment"], "left_semi")
        .join(partly, ["bin", "segment"])
        .select("text", "first", F.explode("inside").alias("r"))
        .select("text", (F.col("first") + F.col("r.a")).alias("first"), (F.col("first") + F.col("r.b")).alias("last"))
    )
    whole = rows.join(distinct.where("n > 1").select("bin", "segment"), ["bin", "segment"], "left_semi").select("text", "first", "last")
    ranges = (
        sure.union(whole).union(single).distinct().groupBy("text").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    )
    changed = packed.join(ranges, "text").select("text", "packed", "ranges").mapInArrow(
        _removed(length), f"text binary, n_removed long, spans {_SPANS}, rest_sha256 string, rest string"
    )
    named = documents.select("doc_id", "text").mapInArrow(_named, "doc_id long, n_bytes long, text binary, whole_sha256 string, whole string")
    return named.join(changed, "text", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("rest_sha256", "whole_sha256").alias("kept_sha256"),
        F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"),
        F.coalesce("rest", "whole").alias("text"),
    )
