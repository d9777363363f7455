"""Phrase collocations from a prefix-free parse: n-grams are counted in distinct chunks, weighted by how often each occurs.

A text is a sequence of words and breaks. Wherever the hash of four of them in a row hits the trigger, a chunk begins and
the one before it ends behind the same four; so equal stretches of text are cut alike wherever they stand, and the corpus
becomes a dictionary of distinct chunks with the frequency of each in the parse. A run of up to five words belongs to
the chunk in which it begins before the next trigger, so what chunks share is counted once.

Counts are taken level by level. A phrase is as frequent as the threshold only if its parts are, so a bitmap of fixed
size says which words, then which pairs, then which threes may be. Bitmaps only let runs pass; what passes is counted by
its own words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.words import mix, slices, windows, word_hashes
from quarryline.session import workspace

#: Most words of a phrase; words that a trigger looks at, one less; one in so many places is a trigger.
MOST, TRIGGER, SPACING = 5, 4, 32
#: Bits of a bitmap: 4 MB, whatever the corpus. Widths that have one. Bits of a hash that is counted for one: where two runs
#: share them, both may pass that else would not.
BITS, LEVELS, HASH_BITS = 25, 3, 40
#: Bytes of chunks worked on at a time, and keys that a task sums up before it lets them go.
WORK_BYTES, HELD = 2 << 20, 1 << 21
#: Parts in which the best phrases of a language are found before they meet.
DEALT = 64
_STEP = np.uint64(0xD1B54A32D192ED03)

# What ends a piece.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_BREAK = b"\xff"  # no byte of UTF-8
_AS_BREAK = bytes(_BREAK[0] if i in _ENDS else i for i in range(256))


def _tokens(text: bytes | None) -> bytes:
    """The words and breaks of a text, joined by one space, with as many breaks behind them as a trigger looks at."""
    spaced = (text or b"").lower().translate(_AS_BREAK).replace(_BREAK, b" \xff ")
    words = spaced.split()
    return b" ".join(words + [_BREAK] * TRIGGER) if words else b""


def _spans(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of some texts joined by spaces start and end, in bytes."""
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))
    return np.append(0, ends[:-1] + 1), ends


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, chunk, n_words, freq``: the chunks of each batch once, ``n_words`` being the words that begin in it."""
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), [_tokens(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        for low, high in slices(texts, WORK_BYTES):
            part = [(lang, t) for lang, t in zip(langs[low:high], texts[low:high]) if t]
            if not part:
                continue
            joined = b" ".join([t for _, t in part])
            starts, ends = _spans(joined)
            hashes, offsets = word_hashes([t for _, t in part])
            seen, begins = windows(hashes, offsets, TRIGGER)
            # A text's first place begins a chunk; its last trigger window holds breaks only and ends the last chunk.
            owner = np.repeat(np.arange(len(part)), np.diff(begins))
            place = np.arange(len(seen)) + np.repeat(offsets[:-1] - begins[:-1], np.diff(begins))
            cut = seen % np.uint64(SPACING) == 0
            cut[begins[:-1]] = True
            cut[begins[1:] - 1] = True
            place, owner = place[cut], owner[cut]
            inside = np.flatnonzero((owner[1:] == owner[:-1]) & (place[1:] > place[:-1]))
            first, last = place[inside], place[inside + 1]
            is_word = np.frombuffer(joined, np.uint8)[starts] != _BREAK[0]
            until = np.concatenate(([0], np.cumsum(is_word)))
            counts: Counter = Counter()
            words = (until[last] - until[first]).tolist()
            for i, a, b, n in zip(owner[inside].tolist(), starts[first].tolist(), ends[last + TRIGGER - 1].tolist(), words):
                counts[part[i][0], joined[a:b], n] += 1
            keys = list(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.string()),
                    pa.array([k[1] for k in keys], pa.binary()),
                    pa.array([k[2] for k in keys], pa.int64()),
                    pa.array(list(counts.values()), pa.int64()),
                ],
                ["lang", "chunk", "n_words", "freq"],
            )


def parse(documents: DataFrame) -> DataFrame:
    """The dictionary of ``documents`` (columns ``lang`` and ``text``): ``lang, chunk, n_words, freq``, a row per distinct
    chunk of a language. A null ``lang`` is ``und``; null and empty texts have no chunks."""
    lang = F.coalesce("lang", F.lit("und")).alias("lang")
    found = documents.select(lang, "text").mapInArrow(_parse, "lang string, chunk binary, n_words long, freq long")
    return found.groupBy("lang", "chunk", "n_words").agg(F.sum("freq").alias("freq"))


class _Chunks:
    """Some chunks as arrays, word by word: hashes, which are words, and the times their chunk counts."""

    def __init__(self, langs: list[str], chunks: list[bytes], freqs: list[int], bitmaps: list[np.ndarray]):
        self.joined = b" ".join(chunks)
        self.starts, self.ends = _spans(self.joined)
        hashes, offsets = word_hashes(chunks)
        sizes = np.diff(offsets)
        self.langs = list(dict.fromkeys(langs))
        number = {name: i for i, name in enumerate(self.langs)}
        self.lang = np.repeat(np.array([number[name] for name in langs], np.int32), sizes)
        salts = np.frombuffer(b"".join([hashlib.blake2b(name.encode(), digest_size=8).digest() for name in self.langs]), np.uint64)
        self.hashes = mix(hashes ^ mix(salts)[self.lang])
        self.times = np.repeat(np.array(freqs, np.int64), sizes)
        self._is_word = np.frombuffer(self.joined, np.uint8)[self.starts] != _BREAK[0]
        self._left = np.repeat(offsets[1:], sizes) - np.arange(len(hashes))  # words to the end of the chunk
        self._bitmaps = bitmaps

    def runs(self, most: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each width up to ``most``, where runs of so many words begin that belong to the chunk they stand in and all
        parts of which pass the bitmaps. What a chunk has in common with the next one belongs to that."""
        passes = self._is_word
        for width in range(1, most + 1):
            if width > 1:
                passes = passes & np.append(passes[1:], False) & (self._left >= width)
            if width <= len(self._bitmaps):
                at = np.flatnonzero(passes)
                bit = self.run_hashes(at, width) >> np.uint64(64 - BITS)
                held = self._bitmaps[width - 1][(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)
                passes = passes.copy()
                passes[at] = held & 1 > 0
            yield width, np.flatnonzero(passes & (self._left > TRIGGER))

    def run_hashes(self, at: np.ndarray, width: int) -> np.ndarray:
        if width == 1:
            return self.hashes[at]
        total = np.full(len(at), width, np.uint64)
        for i in range(width):
            total = total * _STEP + self.hashes[at + i]
        return mix(total)


def _held(batches: Iterator[pa.RecordBatch], packed: list[bytes]) -> Iterator[_Chunks]:
    bitmaps = [np.frombuffer(zlib.decompress(b), np.uint8) for b in packed]
    langs, chunks, freqs, size = [], [], [], 0
    for batch in batches:
        for lang, chunk, freq in zip(*(batch.column(i).to_pylist() for i in range(3))):
            langs.append(lang)
            chunks.append(chunk)
            freqs.append(freq)
            size += len(chunk)
            if size > WORK_BYTES:
                yield _Chunks(langs, chunks, freqs, bitmaps)
                langs, chunks, freqs, size = [], [], [], 0
    if chunks:
        yield _Chunks(langs, chunks, freqs, bitmaps)


def _sums(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of the times of each."""
    order = np.argsort(keys)
    keys = keys[order]
    begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[begins], np.add.reduceat(times[order], begins)


def _hashed(width: int, packed: list[bytes], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``h, times`` of the runs of one width: sums of as many slices as stay below ``HELD`` keys."""

    def rows(keys, times):
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(times)], ["h", "times"])

    keys, times = np.empty(0, np.uint64), np.empty(0, np.int64)
    for chunks in _held(batches, packed):
        *_, (_, at) = chunks.runs(width)
        if not len(at):
            continue
        keys = np.concatenate((keys, chunks.run_hashes(at, width) >> np.uint64(64 - HASH_BITS)))
        times = np.concatenate((times, chunks.times[at]))
        keys, times = _sums(keys, times)
        if len(keys) > HELD:
            yield rows(keys, times)
            keys, times = keys[:0], times[:0]
    if len(keys):
        yield rows(keys, times)


def _phrases(packed: list[bytes], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, phrase, width, times`` of the runs that pass, each once a slice. Runs are told apart by hash and length."""
    for chunks in _held(batches, packed):
        for width, at in chunks.runs(MOST):
            if not len(at):
                continue
            starts, ends = chunks.starts[at], chunks.ends[at + width - 1]
            order = np.lexsort((ends - starts, chunks.run_hashes(at, width)))
            keys, sizes = chunks.run_hashes(at, width)[order], (ends - starts)[order]
            begins = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (sizes[1:] != sizes[:-1])))
            first = order[begins]
            found = zip(starts[first].tolist(), ends[first].tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([chunks.langs[i] for i in chunks.lang[at[first]].tolist()], pa.string()),
                    pa.array([chunks.joined[a:b].decode() for a, b in found], pa.string()),
                    pa.array(np.full(len(first), width, np.int32)),
                    pa.array(np.add.reduceat(chunks.times[at][order], begins)),
                ],
                ["lang", "phrase", "width", "times"],
            )


def _bitmap(counted: DataFrame, least: int) -> bytes:
    """The bits of the hashes that count ``least`` or more, put together in tasks: the driver gets 4 KB for each 32,768 of
    them."""
    frequent = counted.groupBy("h").agg(F.sum("times").alias("times")).where(F.col("times") >= least)
    bit = F.shiftright("h", HASH_BITS - BITS) + 1  # Spark numbers bits from 1
    part = F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("part")
    out = bytearray(1 << BITS >> 3)
    for row in frequent.groupBy((F.bitmap_bucket_number(bit) - 1).alias("block")).agg(part).toLocalIterator():
        out[row.block * len(row.part) : (row.block + 1) * len(row.part)] = row.part
    return bytes(out)


def _mapped(dictionary: DataFrame, run: Callable, schema: str) -> DataFrame:
    return dictionary.select("lang", "chunk", "freq").mapInArrow(run, schema)


def frequent_phrases(dictionary: DataFrame, least: int) -> DataFrame:
    """``lang, phrase, width, f`` of every run of one to five words inside a piece that occurs ``least`` times or more."""
    packed: list[bytes] = []
    for width in range(1, LEVELS + 1):
        counted = _mapped(dictionary, partial(_hashed, width, list(packed)), "h long, times long")
        packed.append(zlib.compress(_bitmap(counted, least), 1))
    found = _mapped(dictionary, partial(_phrases, packed), "lang string, phrase string, width int, times long")
    return found.groupBy("lang", "phrase", "width").agg(F.sum("times").alias("f")).where(F.col("f") >= least)


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)), exact: products are decimals of 38 digits."""
    a, n, left, right = (c.cast("decimal(19,0)") for c in (a, n, left, right))
    top = (a * n).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")
    return F.call_function("div", top, (left * right).cast("decimal(38,0)"))


def collocations(documents: DataFrame, least: int = 100, most: int = 2000, absorb_percent: int = 100) -> DataFrame:
    """The ``most`` best phrases of each language of ``documents`` (columns ``lang`` and ``text``; others are ignored):
    ``lang, rank, phrase, a, l, r, n, score``.

    A phrase has two to five words in a row inside a piece of text and occurs ``least`` times or more. Cut in two where
    that scores least, and first among equals, it scores floor(1000 a n / (l r)): its count and that of all words of its
    language over the counts of its parts. A phrase is left out when one longer phrase that contains it occurs
    ``absorb_percent`` in a hundred times as often. Ranks go by score, count and the phrase's bytes.

    A null ``lang`` is ``und``; null and empty texts have no words; repeated rows count each; an empty table, and a
    language without such phrases, gives no rows.
    """
    spark = documents.sparkSession
    path = workspace(spark, "collocations-chunks")
    parse(documents).write.option("compression", "zstd").parquet(path)
    dictionary = spark.read.parquet(path)
    totals = dictionary.groupBy("lang").agg(F.sum(F.col("n_words") * F.col("freq")).alias("n"))
    path = workspace(spark, "collocations-phrases")
    frequent_phrases(dictionary, least).write.parquet(path)
    known = spark.read.parquet(path)
    words = F.split("phrase", " ")
    longer = known.where("width > 1").withColumn("words", words)

    def joined(start, length) -> Column:
        return F.array_join(F.slice("words", start, length), " ")

    cuts = longer.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("width") - 1)))
    parts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", joined(1, F.col("k")).alias("first"), joined(F.col("k") + 1, F.col("width")).alias("rest"))
    counts = known.select(F.col("lang").alias("p_lang"), F.col("phrase").alias("part"), "f")
    for part, name in (("first", "l"), ("rest", "r")):
        same = (F.col("lang") == F.col("p_lang")) & (F.col(part) == F.col("part"))
        parts = parts.join(counts.withColumnRenamed("f", name), same).drop("p_lang", "part", part)
    scored = parts.join(totals, "lang").withColumn("score", score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    weakest = F.min_by(F.struct("score", "l", "r"), F.struct("score", "k")).alias("cut")
    scored = scored.groupBy("lang", "phrase", "a", "n").agg(weakest).select("lang", "phrase", "a", "n", "cut.*")

    inner = longer.where("width > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("width") - 1)))
    inner = inner.withColumn("start", F.explode(F.expr("sequence(1, width - size + 1)")))
    holders = inner.groupBy("lang", joined(F.col("start"), F.col("size")).alias("phrase")).agg(F.max("f").alias("held"))
    alone = F.col("held").isNull() | (100 * F.col("held") < absorb_percent * F.col("a"))
    kept = scored.join(holders, ["lang", "phrase"], "left").where(alone)
    order = F.desc("score"), F.desc("a"), F.col("phrase")
    deal = F.pmod(F.xxhash64("phrase"), F.lit(DEALT)).alias("deal")  # one language may have nearly all phrases
    kept = kept.select("*", deal)
    for names in (["lang", "deal"], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*names).orderBy(*order))
        kept = kept.withColumn("rank", place).where(F.col("rank") <= most)
    return kept.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
