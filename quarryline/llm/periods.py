"""Runs of words that repeat with a period, by tiles of each octave of periods, stitched by document and period.

A run is a stretch of words with smallest period q, at least four periods and six words long, which no neighbouring
word carries on. Periods are looked for by octaves P to 2 P. In an octave the words are cut into tiles with boundaries
every P words; whatever the run, one of its boundaries c has two more periods of it behind the first. There the Z value
of the boundary, the number of words from c on that agree with those from c + q on, is 2 q or more. Of the periods of an
octave at most one that is no multiple of a shorter period can have that, and neighbouring boundaries of the same period lie
in one run. A tile knows its own words only: what touches its end is a fragment, and fragments of a document and
period that share a period's length are one run.

Words are compared as 64-bit hashes, and prefix sums only choose what is then compared word for word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.words import mix, slices, word_hashes
from quarryline.session import workspace

#: Least length of a run in periods and in words; words of a tile between its first and last boundary.
PERIODS, LEAST, TILE = 4, 6, 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _factors(n: int) -> list[int]:
    out, d = [], 2
    while d * d <= n:
        if n % d == 0:
            out.append(d)
            while n % d == 0:
                n //= d
        d += 1
    return out + [n] if n > 1 else out


def _primitive(words: np.ndarray, period: int) -> bool:
    """Whether the first ``period`` words are no shorter stretch repeated."""
    return not any(np.array_equal(words[: period - d], words[d:period]) for d in (period // f for f in _factors(period)))


def _boundaries(words: np.ndarray, sums: np.ndarray, power: np.ndarray, octave: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """The boundaries between ``first`` and ``last`` and the periods of the octave whose Z value there is two periods: the
    least period of each. ``sums`` are prefix sums of the words times powers, so equal stretches are a multiplication apart."""
    n = len(words)
    first, last = -(-first // octave), min(-(-last // octave), (n - 3 * octave) // octave + 1)
    if last <= first:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    held = words[first * octave : (last + 1) * octave + octave]
    if len(held) < (last - first + 1) * octave:
        held = np.concatenate((held, np.zeros((last - first + 1) * octave - len(held), np.uint64)))
    own = held[: (last - first) * octave : octave]
    ahead = held[octave : (last - first + 1) * octave].reshape(last - first, octave)
    at, step = np.nonzero(ahead == own[:, None])
    c, p = (at + first) * octave, step + octave
    inside = c + 3 * p <= n
    c, p = c[inside], p[inside]
    alike = (sums[c + 2 * p] - sums[c]) * power[p] == sums[c + 3 * p] - sums[c + p]
    c, p = c[alike], p[alike]
    keep = np.append(True, c[1:] != c[:-1]) if len(c) else np.empty(0, bool)
    return c[keep], p[keep]


def fragments(words: np.ndarray, tile: int = TILE) -> Iterator[tuple[int, int, int]]:
    """``period, start, end`` of every run, or piece of a run at the end of a tile, in the words (as 64-bit hashes)."""
    octave, least = 1, max(LEAST, PERIODS)
    while PERIODS * octave <= len(words) and least <= len(words):
        core = max(tile // octave, 16) * octave
        for begin in range(0, len(words), core):
            low = max(0, begin - 2 * octave)
            low -= low % octave
            view = words[low : begin + core + 8 * octave]
            power = np.full(min(len(view), 2 * octave) + 1, _BASE, np.uint64)
            power[0] = 1
            power = np.cumprod(power)
            # Powers of an odd base repeat far beyond any tile, so one sum serves all lengths.
            weights = np.full(len(view), _BASE, np.uint64)
            if len(view):
                weights[0] = 1
            sums = np.zeros(len(view) + 1, np.uint64)
            np.cumsum(view * np.cumprod(weights), out=sums[1:])
            found, periods = _boundaries(view, sums, power, octave, begin - low, begin - low + core)
            yield from ((p, s + low, e + low) for p, s, e in _solved(view, found, periods, octave, begin - low, begin - low + core))
        octave *= 2


def _solved(view: np.ndarray, found: np.ndarray, periods: np.ndarray, octave: int, first: int, last: int) -> Iterator[tuple[int, int, int]]:
    if not len(found):
        return
    cuts = np.flatnonzero((np.diff(found) != octave) | (np.diff(periods) != 0)) + 1
    for chain in np.split(np.arange(len(found)), cuts):
        p, low, high = int(periods[chain[0]]), int(found[chain[0]]), int(found[chain[-1]]) + 3 * int(periods[chain[0]])
        cut_off = low == -(-first // octave) * octave and first > 0 or int(found[chain[-1]]) + octave >= last
        if not _primitive(view[low:], p):
            continue
        start, end = max(0, low - octave), min(len(view), high + octave)
        equal = np.concatenate(([False], view[start : end - p] == view[start + p : end], [False]))
        turns = np.flatnonzero(equal[1:] != equal[:-1])
        for a, b in zip(turns[::2].tolist(), turns[1::2].tolist()):
            if b - a + p >= (2 * p if cut_off else max(LEAST, PERIODS * p)):
                yield p, start + a, start + b + p


def _scan(batches: Iterator[pa.RecordBatch], tile: int) -> Iterator[pa.RecordBatch]:
    """Each document's words joined by one space, and its fragments."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
        texts = [b" ".join((t or b"").split()) for t in texts]
        for low, high in slices(texts):
            part, part_ids = texts[low:high], ids[low:high]
            hashes, offsets = word_hashes(part)
            ends = np.arange(1 << 40, (1 << 40) + len(part), dtype=np.uint64)  # a word of its own behind each text
            joined = np.insert(hashes, offsets[1:], mix(ends))
            begins = offsets[:-1] + np.arange(len(part))
            own: list[list[dict]] = [[] for _ in part]
            for p, s, e in fragments(joined, tile):
                i = int(np.searchsorted(begins, s, "right")) - 1
                own[i].append({"period": p, "start": s - int(begins[i]), "end": e - int(begins[i])})
            names = [hashlib.blake2b(f"{i}\n".encode() + t, digest_size=16).digest() for i, t in zip(part_ids, part)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part_ids, pa.int64()),
                    pa.array(names, pa.binary()),
                    pa.array([t.decode() for t in part], pa.string()),
                    pa.array(own, pa.list_(pa.struct([("period", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))),
                ],
                ["doc_id", "name", "words", "fragments"],
            )


def stitched(pieces: DataFrame) -> DataFrame:
    """``name, period, start, end`` with pieces of one name and period joined where they share a period's length."""
    ordered = Window.partitionBy("name", "period").orderBy("start", "end")
    reach = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("start") > reach - F.col("period"), F.lit(True)).cast("int")
    return (
        pieces.distinct()
        .withColumn("fresh", fresh)
        .withColumn("run", F.sum("fresh").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("name", "period", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("run")
    )


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words but those that a run contains behind its first period."""
    for batch in batches:
        ids, texts, runs = (batch.column(i).to_pylist() for i in range(3))
        left = []
        for text, found in zip(texts, runs):
            words = text.split(" ")
            turns = np.zeros(len(words) + 1, np.int64)
            for r in found or ():
                turns[r["start"] + r["period"]] += 1
                turns[r["start"] + r["length"]] -= 1
            left.append(" ".join([w for w, inside in zip(words, np.cumsum(turns).tolist()) if not inside]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(left, pa.string())], ["doc_id", "runs", "collapsed"])


_RUNS = "array<struct<start:long,length:long,period:long>>"


def periodic_runs(documents: DataFrame, tile: int = TILE) -> DataFrame:
    """One row per row of ``documents`` (columns ``doc_id``, a long, and ``text``; others are ignored): ``doc_id,
    runs, collapsed``: the runs as an array of ``start, length, period`` in words, by start and then period, and the
    words that are left when of each run only the first period stays, joined by one space.

    Texts may be of any length; ``tile`` words of one are searched at a time. Null and empty texts have no runs and no
    words. A null ``doc_id`` is carried along, repeated rows have a result each, an empty table gives an empty table.
    """
    spark = documents.sparkSession
    path = workspace(spark, "periods")
    schema = "doc_id long, name binary, words string, fragments array<struct<period:long,start:long,end:long>>"
    scan = documents.select("doc_id", "text").mapInArrow(lambda batches: _scan(batches, tile), schema)
    scan.write.option("compression", "zstd").parquet(path)
    scanned = spark.read.parquet(path)
    whole = F.size("fragments") == 0
    pieces = scanned.where(~whole).select("name", F.explode("fragments").alias("f")).select("name", "f.*")
    run = F.struct("start", (F.col("end") - F.col("start")).alias("length"), "period")
    long_enough = F.expr(f"end - start >= greatest({LEAST}, {PERIODS} * period)")
    runs = stitched(pieces).where(long_enough).groupBy("name").agg(F.sort_array(F.collect_list(run)).alias("runs"))
    none = F.array().cast(_RUNS)
    held = scanned.where(~whole).join(runs, "name", "left").select("doc_id", "words", F.coalesce("runs", none).alias("runs"))
    collapsed = held.mapInArrow(_collapse, f"doc_id long, runs {_RUNS}, collapsed string")
    return scanned.where(whole).select("doc_id", none.alias("runs"), F.col("words").alias("collapsed")).union(collapsed)


def with_planted_tails(documents: DataFrame) -> DataFrame:
    """``doc_id, text`` in which every tenth document, by h = crc32 of its id, ends in a period: each word i from
    a = g % n on becomes word a + (i - a) % p, with n words, g = h div 10 and p = 1 + (n - a) div (3 + g % 8). Rows without
    id or words stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, words = F.floor(h / 10), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    cut = documents.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), g.alias("g"))
    cut = cut.withColumn("a", F.when(F.size("w") > 0, F.col("g") % F.size("w")))
    cut = cut.withColumn("p", F.expr("1 + (size(w) - a) div (3 + g % 8)"))
    tail = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[cast(a + (i - a) % p as int)])), ' ')")
    return cut.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(tail).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """The rows of ``periodic_runs`` as counts, the run of greatest exact exponent and digests."""
    # Lengths and periods are below 2^31, so their products are exact.
    best = F.expr(
        "aggregate(slice(runs, 2, size(runs)), try_element_at(runs, 1), "
        "(b, x) -> if(x.length * b.period > b.length * x.period, x, b))"
    )
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
