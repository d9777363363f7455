"""Shared helpers: word hashes, components, packed numbers."""

import random

import numpy as np

from quarryline.llm.blocks import pack, pack_words, unpack, unpack_words, unvarints, varints
from quarryline.llm.components import components
from quarryline.llm.neardup import signatures
from quarryline.llm.words import normal, shingle_set, shingles


def test_normal_lowers_ascii_only():
    assert normal("\tÀ B\x0bC\x85d \n".encode()) == "À b c\x85d".encode()
    assert normal(None) == b""


def test_shingles_match_their_sets():
    texts = [normal(t.encode()) for t in ("a b c d e f a b c d e", "", "one two", "x", "a a a a a a a", "é b c d e f")]
    hashes, begins = shingles(texts)
    for text, a, b in zip(texts, begins, begins[1:]):
        assert len(set(hashes[a:b].tolist())) == len(shingle_set(text))
    assert len(hashes) == 7 + 0 + 1 + 1 + 3 + 2


def test_equal_shingles_have_equal_hashes_anywhere():
    one, _ = shingles([normal(b"p q r s t u")])
    two, begins = shingles([normal(b"z z z z z z"), normal(b"y p q r s t")])
    assert one[0] in two[begins[1] :].tolist()


def test_signature_is_the_least_rank_of_each_slot_and_estimates_similarity():
    rnd = np.random.default_rng(1)
    shared, a, b = (rnd.integers(0, 1 << 63, n, dtype=np.uint64) for n in (600, 200, 200))
    rows = signatures(np.concatenate([shared, a, shared, b]), np.repeat([0, 1], 800), 2)
    assert abs((rows[0] == rows[1]).mean() - 0.6) < 0.15
    assert (signatures(np.concatenate([shared, shared]), np.zeros(1200, int), 1) == signatures(shared, np.zeros(600, int), 1)).all()
    few = signatures(shared[:2], np.zeros(2, int), 1)
    assert (few >> np.uint64(56)).max() < 128  # every slot is filled, however few the shingles


def test_varints_and_words_round_trip():
    values = np.array([0, 1, 127, 128, 300, 1 << 20, (1 << 40) + 5])
    assert unvarints(varints(values)).tolist() == values.tolist()
    assert unvarints(b"").tolist() == []
    assert unpack(pack(b"a", b"", b"xyz")) == [b"a", b"", b"xyz"]
    assert unpack_words(pack_words([b"ab", b"", "é".encode()])) == [b"ab", b"", "é".encode()]


def test_components_equal_a_search(spark):
    rnd = random.Random(5)
    links = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7)]
    links += [(200, 200 + i) for i in range(1, 30)]
    near: dict[int, set] = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            for other in near[todo.pop()] - seen:
                seen.add(other)
                todo.append(other)
        if min(seen) != node:
            want[node] = min(seen)
    found = components(spark.createDataFrame(links, "a long, b long").repartition(5))
    assert {r.node: r.root for r in found.collect()} == want


def test_no_links_no_components(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
