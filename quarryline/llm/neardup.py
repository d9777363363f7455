"""Near-duplicate documents: SuperMinHash signatures, bands, exact verification and union-find.

Documents of the same words are one class, and only classes are compared. In a signature each shingle brings a random
permutation of the slots together with its ranks; slot values are least ranks, so slots depend on each other and vary
less than independent hashes would. Ranks are dealt one after the other, and a document is done as soon as no further
rank can lower a slot: usually after one or two.

Classes that share a band are candidates. Large buckets are not paired out: each member is compared with the hub of its
bucket, its most shared member, and what it has otherwise than the hub is kept. Two members of a bucket that are not
both linked to the hub can only be similar if they share enough of these differences, so the rest is a set join on
differences with a prefix and a position filter, the rarest difference first. It drops no similar pair: with o shared
differences, d missing and a added ones of each, and h shingles of the hub, similarity 0.75 means
7 o >= (4 d + 3 a) + (4 d' + 3 a') - h, and a member is not linked to the hub when its own 4 d + 3 a is over h.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from quarryline.llm.components import components
from quarryline.llm.words import mix, normal, pieces, shingle_set, shingles, slices
from quarryline.session import workspace

#: Slots of a signature, and how many of them make a band: two texts of similarity 0.75 share no band five times in a
#: million.
SLOTS, ROWS = 128, 4
BANDS = SLOTS // ROWS
PERCENT = 75

_GOLDEN = 0x9E3779B97F4A7C15


def signatures(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """One row of SLOTS values for each of ``n`` texts; ``owner`` says whose each shingle is. Texts without shingles keep
    the largest value. A value is its rank in the upper byte and the shingle's random number for that rank below."""
    out = np.full(n * SLOTS, np.iinfo(np.uint64).max, np.uint64)
    drawn: list[np.ndarray] = []
    for rank in range(SLOTS):
        if not len(hashes):
            break
        z = mix(hashes + np.uint64((rank + 1) * _GOLDEN & 0xFFFFFFFFFFFFFFFF))
        pick = (rank + ((z >> np.uint64(32)) * np.uint64(SLOTS - rank) >> np.uint64(32)).astype(np.int64)).astype(np.int16)
        slot = pick
        for t in range(rank - 1, -1, -1):  # what the earlier swaps of this shingle's permutation have put there
            slot = np.where(drawn[t] == slot, np.int16(t), slot)
        value = np.uint64(rank << 56) | (mix(z) >> np.uint64(8))
        np.minimum.at(out, owner * SLOTS + slot, value)
        going = (out.reshape(n, SLOTS).max(axis=1) >> np.uint64(56)) > np.uint64(rank)
        keep = going[owner]
        drawn = [d[keep] for d in drawn] + [pick[keep]]
        hashes, owner = hashes[keep], owner[keep]
    return out.reshape(n, SLOTS)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One key per band, different bands never meeting but by chance."""
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(signature), BANDS)).copy()
    for i in range(ROWS):
        key = mix(key * np.uint64(_GOLDEN) + signature[:, i::ROWS])
    return key.view(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [normal(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        for start, end in slices(texts):
            part = texts[start:end]
            hashes, begins = shingles(part)
            sizes = np.diff(begins)
            keys = band_keys(signatures(hashes, np.repeat(np.arange(len(part)), sizes), len(part)))
            distinct = [len(np.unique(hashes[a:b])) for a, b in zip(begins[:-1], begins[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(start, end - start),
                    pa.array(distinct, pa.int64()),
                    pa.array([hashlib.blake2b(t, digest_size=16).digest() if t else None for t in part], pa.binary()),
                    pa.array([k if t else None for t, k in zip(part, keys)], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "digest", "bands"],
            )


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b, similar`` for pairs with both texts, on the full shingle sets; ``size_a``, and 4 missing + 3 added and the
    differences of b from a as hashes."""
    held: dict[int, tuple[set, np.ndarray]] = {}
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    for batch in batches:
        rows = []
        for a, b, text_a, text_b in zip(*(column.to_pylist() for column in batch.columns)):
            if a not in held:  # hubs repeat
                if len(held) >= 16:
                    held.clear()
                held[a] = shingle_set(text_a), np.unique(shingles([text_a])[0])
            one, hashes = held[a]
            two, others = shingle_set(text_b), np.unique(shingles([text_b])[0])
            shared = len(one & two)
            similar = 100 * shared >= PERCENT * (len(one) + len(two) - shared)
            weight = 4 * (len(one) - shared) + 3 * (len(two) - shared)
            rows.append((a, b, similar, len(one), weight, np.setxor1d(hashes, others, assume_unique=True).view(np.int64)))
        columns = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], ["a", "b", "similar", "size_a", "weight", "differences"]
        )


def _stored(frame: DataFrame, label: str) -> DataFrame:
    path = workspace(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def near_duplicates(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents`` (columns ``doc_id`` and ``text``; others are ignored): ``doc_id, n_shingles,
    component_id, kept``.

    Documents whose sets of five-word shingles have a similarity of 0.75 or more are linked. Texts that are null, empty
    or all white space have no shingles, are linked with nothing and kept. Repeated rows share one fate. A null
    ``doc_id`` names no document: such rows are kept, with a null component. An empty table gives an empty table.
    """
    features, rooted = _rooted(documents)
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = rooted.join(least, "root").select("digest", "component_id")
    return (
        features.select("doc_id", "n_shingles", "digest")
        .join(named, "digest", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _rooted(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The features of each row, and of each class its least ``doc_id`` and its component's root."""
    docs = documents.select("doc_id", "text")
    schema = "doc_id long, n_shingles long, digest binary, bands array<long>"
    features = _stored(docs.mapInArrow(_features, schema), "features")
    classes = _stored(
        features.where("digest IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("doc_id"), F.any_value("bands").alias("bands"))
        .select(F.monotonically_increasing_id().alias("id"), "digest", "doc_id", "bands"),
        "classes",
    )
    members = _stored(_shared_bands(classes), "members")
    candidates = members.select("id").distinct().join(classes.select("id", "digest", "doc_id"), "id")
    texts = _stored(
        docs.join(candidates, "doc_id")
        .mapInArrow(_class_texts, "id long, words binary")
        .dropDuplicates(["id"]),
        "texts",
    )
    links = _links(members, texts)
    found = components(links).select(F.col("node").alias("id"), "root")
    rooted = classes.select("id", "digest", "doc_id").join(found, "id", "left").withColumn("root", F.coalesce("root", "id"))
    return features, rooted


def _shared_bands(classes: DataFrame) -> DataFrame:
    """``key, id`` of the buckets with two classes or more."""
    postings = classes.select("id", F.explode("bands").alias("key"))
    shared = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return postings.join(shared, "key", "left_semi").select("key", "id")


def _class_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the rows that belong to the class asked for; a repeated doc_id may bring other texts."""
    for batch in (part for whole in batches for part in pieces(whole, whole.schema.get_field_index("text"))):
        ids, words = [], []
        for text, id_, digest in zip(
            batch.column("text").cast(pa.binary()).to_pylist(), batch.column("id").to_pylist(), batch.column("digest").to_pylist()
        ):
            text = normal(text)
            if hashlib.blake2b(text, digest_size=16).digest() == digest:
                ids.append(id_)
                words.append(text)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.binary())], ["id", "words"])


def _compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b, similar`` and b's differences from a, for distinct pairs of class ids."""
    b_text = texts.select(F.col("id").alias("b"), F.col("words").alias("text_b"))
    a_text = texts.select(F.col("id").alias("a"), F.col("words").alias("text_a"))
    both = pairs.join(b_text, "b").join(a_text, "a").select("a", "b", "text_a", "text_b")
    schema = "a long, b long, similar boolean, size_a long, weight long, differences array<long>"
    return _stored(both.mapInArrow(_similar, schema), "compared")


def _links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between classes that give the same components as all similar pairs which share a band."""
    # the hub of a bucket is the member that shares most bands with others: near the middle, so differences from it are few
    sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    degrees = members.join(sizes, "key").groupBy("id").agg(F.sum("n").alias("degree"))
    hubs = members.join(degrees, "id").groupBy("key").agg(F.max_by("id", F.struct("degree", "id")).alias("a"))
    stars = _compare(members.join(hubs, "key").where("id <> a").select("a", F.col("id").alias("b")).distinct(), texts)
    links = stars.where("similar").select("a", "b")
    others = _compare(_by_differences(stars, components(links)), texts)
    return links.union(others.where("similar").select("a", "b"))


def _by_differences(stars: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs ``a < b`` around one hub, in different components so far, which may be similar."""
    label = found.select(F.col("node").alias("b"), "root")
    around = stars.join(label, "b", "left").withColumn("root", F.coalesce("root", "b"))
    open_hubs = around.groupBy("a").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.bool_and("similar").alias("all")).where("low < high AND NOT all")
    # pairs without their differences meet their hub's verdict; differences are dealt by pair, then by hub and difference
    open_pairs = around.select("a", "b").join(open_hubs.select("a"), "a", "left_semi")
    around = around.join(open_pairs, ["a", "b"], "left_semi")
    each = around.select("a", "b", "root", "similar", "size_a", "weight", F.explode("differences").alias("e"))
    seen = each.groupBy("a", "e").agg(F.count("*").alias("k")).where("k > 1")  # what stands once is shared by none
    order = Window.partitionBy("a", "b").orderBy("k", "e")
    ranked = _stored(
        each.join(seen, ["a", "e"])
        .withColumn("i", F.row_number().over(order))
        .withColumn("n", F.count("*").over(Window.partitionBy("a", "b"))),
        "differences",
    )
    # one of the two is not linked to the hub; the other's overlap must be over a seventh of its own weight
    apart = ranked.where("NOT similar").where("i <= n - greatest(1, ceil((weight - size_a) / 4)) + 1")
    other = ranked.where("i <= n - floor(weight / 7)").select(
        "a", "e", F.col("b").alias("b2"), F.col("root").alias("root2"), F.col("weight").alias("weight2"), F.col("i").alias("i2"), F.col("n").alias("n2")
    )
    enough = "7 * (1 + least(n - i, n2 - i2)) >= weight + weight2 - size_a"
    return (
        apart.join(other, ["a", "e"])
        .where(f"b <> b2 AND root <> root2 AND {enough}")
        .select(F.least("b", "b2").alias("a"), F.greatest("b", "b2").alias("b"))
        .distinct()
        .join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the digest of their words, or with the text itself where it has none."""
    for batch in (part for whole in batches for part in pieces(whole, 2)):
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        words = [normal(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array([None if w else t for t, w in zip(texts, words)], pa.binary()),
                pa.array([hashlib.blake2b(w, digest_size=16).digest() if w else None for w in words], pa.binary()),
            ],
            ["_row", "_id", "_blank", "_digest"],
        )


def keep_one(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` without all but one document of each group, with all their columns. A document is a
    ``doc_id`` with the words of a text, so a repeated ``doc_id`` may bring texts of several groups; of a group stays the
    least ``doc_id``, and under that one text. Of rows that repeat a ``doc_id`` and its words one stays; rows without
    ``doc_id`` all stay."""
    features, rooted = _rooted(documents)
    rooted = _stored(rooted, "rooted")
    first = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    kept = rooted.join(first, "root").where("digest = first.digest").select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest"))
    known = features.where("doc_id IS NOT NULL AND digest IS NOT NULL").select("doc_id", "digest").distinct()
    dropped = _stored(known.join(kept, (known["doc_id"] == kept["kept_id"]) & (known["digest"] == kept["kept_digest"]), "left_anti"), "dropped")
    row = documents.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), "text")
    schema = StructType([row.schema["_row"], row.schema["_id"], StructField("_blank", BinaryType()), StructField("_digest", BinaryType())])
    rows = row.mapInArrow(_digests, schema)
    left = rows.join(dropped, (rows["_id"] == dropped["doc_id"]) & (rows["_digest"] == dropped["digest"]), "left_anti")
    named = left.where("_id IS NOT NULL").dropDuplicates(["_id", "_blank", "_digest"])
    return named.union(left.where("_id IS NULL")).select("_row.*")
