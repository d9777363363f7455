"""Source mixes, collocations and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import collocations, mixing, periods
from quarryline.llm.words import mix

EXTRA = "doc_id long, text string, source string, lang string, size string, taken string, key string, f string, runs string"


def table(spark, rows):
    """Rows of doc_id, text, source and lang, among columns with the operators' own names."""
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], EXTRA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---- mix -------------------------------------------------------------------------------------------------------------


def wanted_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Sizes by source; targets by sharing out again until none is above its ceiling."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, target, still = Fraction(share) * sum(sizes.values()), {}, set(order)
    while still:
        unit = left / sum(weight[s] for s in still)
        full = {s for s in still if unit * weight[s] >= most * sizes[s]}
        if not full:
            target |= {s: unit * weight[s] for s in still}
            break
        target |= {s: Fraction(most * sizes[s]) for s in full}
        left -= sum(target[s] for s in full)
        still -= full
    return target


@pytest.fixture(scope="module")
def mixed():
    rnd = random.Random(5)
    rows = []
    for i in range(400):
        source = rnd.choice(["a", "a", "a", "B", "é", "zz", None, f"s{rnd.randrange(12)}"])
        rows.append((i, " ".join("w" * rnd.randint(1, 3) for _ in range(rnd.choice([0, 1, 5, 60, 900]))), source, "en"))
    return rows + [(None, "x y z", "a", None), (None, None, None, None), (7, "no source", None, "en"), (3, rows[3][1], rows[3][2], "en")]


def check_mix(rows, found, **options):
    sizes, taken, largest = Counter(), Counter(), Counter()
    by_row = {(r.doc_id, r.size): r for r in found}
    for i, text, source, _ in rows:
        n = len(words_of(text))
        r = by_row[i, n]
        sizes[source] += n
        taken[source] += r.taken
        largest[source] = max(largest[source], n)
        assert r.taken in (0, n, 2 * n) and r.taken == r.times * n
    targets = wanted_targets(sizes, **options)
    for i, text, source, _ in rows:
        r = by_row[i, len(words_of(text))]
        assert r.source_size == sizes[source] and r.target == pytest.approx(float(targets[source]))
    for source, target in targets.items():
        assert abs(taken[source] - target) <= largest[source] / 2
    return targets


def test_mix_meets_its_targets(spark, mixed):
    found = mixing.mix(table(spark, mixed)).collect()
    assert len(found) == len(mixed)
    check_mix(mixed, found)
    for share, weights in ((0.3, (1,)), (1.9, (5, 1)), (2.0, (3, 1, 2)), (2.5, (1, 2))):
        check_mix(mixed, mixing.mix(table(spark, mixed), weights, share).collect(), weights=weights, share=share)


def test_mix_agrees_in_any_order_and_is_nested(spark, mixed):
    def times(share, docs):
        return sorted((r.doc_id or -1, r.size, r.times) for r in mixing.mix(docs, (1, 1, 1), share).collect())

    docs = table(spark, mixed)
    low = times(0.5, docs)
    assert low == times(0.5, docs.repartition(7, "text").orderBy(F.desc("doc_id")))
    high = times(0.9, docs)
    assert all(a[:2] == b[:2] and a[2] <= b[2] for a, b in zip(low, high))


def test_mix_of_equal_rows_takes_as_many_as_fit(spark):
    rows = [(1, "a b c d", "x", "en")] * 1000 + [(i, "a b", "y", "en") for i in range(2, 20)]
    found = mixing.mix(table(spark, rows), (1, 3), 0.75).collect()
    want = wanted_targets({"x": 4000, "y": 36}, (1, 3), 0.75)
    assert abs(sum(r.taken for r in found if r.doc_id == 1) - want["x"]) <= 2
    assert {r.times for r in found if r.doc_id == 1} <= {0, 1, 2}


def test_mix_without_words_or_rows(spark):
    assert mixing.mix(table(spark, [(1, "", None, None)]).limit(0)).count() == 0
    rows = [(1, "", "a", "en"), (2, None, "b", "en"), (3, " \n\t", None, "en")]
    assert [(r.size, r.source_size, r.target, r.taken) for r in mixing.mix(table(spark, rows)).collect()] == [(0, 0, 0.0, 0)] * 3


def test_many_sources_are_ranked_by_code_point(spark):
    names = [f"{a}{i}" for i in range(150) for a in ("Z", "a", "é", "😀", "ﬀ")] + [None, ""]
    sources = spark.createDataFrame([(n, 10) for n in names], "source string, source_size long").repartition(5)
    ranks = {r.source: r["rank"] for r in mixing._ranked(sources).collect()}
    assert [ranks[n] for n in sorted(filter(None, names), key=lambda n: n.encode())] == list(range(1, len(names) - 1))
    assert ranks[""] == 0 and ranks[None] == len(names) - 1


# ---- collocations ----------------------------------------------------------------------------------------------------


def brute_phrases(rows, least, most=2000):
    counts, totals = Counter(), Counter()
    for _, text, _, lang in rows:
        lang = lang if lang is not None else "und"
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, 6):
                for i in range(len(words) - n + 1):
                    counts[lang, tuple(words[i : i + n])] += 1
    out = []
    for (lang, p), a in counts.items():
        if len(p) < 2 or a < least:
            continue
        cuts = [(1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]], p))
    longer = {}
    for lang, _, a, _, _, _, p in out:
        for n in range(2, len(p)):
            for i in range(len(p) - n + 1):
                longer[lang, p[i : i + n]] = max(longer.get((lang, p[i : i + n]), 0), -a)
    kept = sorted(o for o in out if longer.get((o[0], o[6]), 0) < -o[2])
    ranks, result = Counter(), []
    for lang, score, a, phrase, l, r, _ in kept:
        ranks[lang] += 1
        if ranks[lang] <= most:
            result.append((lang, ranks[lang], phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(result)


@pytest.fixture(scope="module")
def prose():
    rnd = random.Random(8)
    vocabulary = ["The", "of", "new", "York", "times", "é", "É", "a-b", "x", "ﬀ", "\xa0", "w\x85"]
    rows = []
    for i in range(150):
        text = "".join(rnd.choice(vocabulary) + rnd.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "; "]) for _ in range(rnd.randint(0, 90)))
        rows.append((i, text + "New York times daily " * rnd.randint(0, 2), None, rnd.choice(["en", "en", "de", None])))
    return rows + [(900, "same words here again " * 2000, None, "en"), (901, "same words here again " * 2000, None, "en"),
                   (902, "same " * 5000, None, "fr"), (903, None, None, "en"), (904, "", None, "xx"), (905, "...,\n", None, "en"), (5, "York", None, "en")]


@pytest.mark.parametrize("least, most, work", [(3, 2000, 8 << 20), (20, 7, 300)])
def test_collocations_equal_brute_force(spark, prose, least, most, work, monkeypatch):
    monkeypatch.setattr(collocations, "WORK_BYTES", work)
    found = collocations.collocations(table(spark, prose), least, most).collect()
    assert sorted(tuple(r) for r in found) == brute_phrases(prose, least, most)


def test_chunks_hold_every_word_once(spark, prose):
    found = collocations.parse(table(spark, prose)).collect()
    totals = Counter()
    for r in found:
        totals[r.lang] += r.n_words * r.freq
    want = Counter()
    for _, text, _, lang in prose:
        want[lang if lang is not None else "und"] += sum(len(re.findall(r"[^\x20\x09]+", p)) for p in re.split(r"[.,;:!?\x0A-\x0D]", text or ""))
    assert {k: v for k, v in totals.items() if v} == {k: v for k, v in want.items() if v}
    repeated = [r for r in found if b"same words here" in bytes(r.chunk)]
    assert sum(r.n_words for r in repeated) < 16_000  # copies and repeats are in the dictionary once


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(10**12 + 7, 3 * 10**13 + 1, 10**12 + 9, 2 * 10**12 + 1), (100, 10**14, 100, 100), (3 * 10**9, 7 * 10**9, 5 * 10**9 + 1, 6 * 10**9 - 1)]
    found = spark.createDataFrame(rows, "a long, n long, l long, r long")
    scores = found.select("*", collocations.score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("s")).collect()
    assert [r.s for r in scores] == [1000 * a * n // (l * r) for a, n, l, r in rows]


def test_collocations_of_nothing(spark):
    assert collocations.collocations(table(spark, [(1, "a b", None, "en")])).count() == 0
    assert collocations.collocations(table(spark, [(1, "a b", None, "en")]).limit(0)).count() == 0


# ---- periodic runs ---------------------------------------------------------------------------------------------------


def brute_runs(words):
    n, out = len(words), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            own = words[i : j + p]
            if j > i and len(own) >= max(6, 4 * p) and not any(own[q:] == own[:-q] for q in range(1, p)):
                out.append((i, len(own), p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rnd, most=170):
    n, k = rnd.randint(0, most), rnd.choice([1, 2, 3, 4, 50])
    words = [f"w{rnd.randrange(k)}" for _ in range(n)]
    for _ in range(rnd.randint(0, 3)):
        if n > 8:
            p, s = rnd.randint(1, n // 4), rnd.randrange(n)
            for i in range(s + p, min(n, s + rnd.randint(p, 10 * p))):
                words[i] = words[i - p]
    return words


def test_fragments_cover_every_run():
    rnd = random.Random(3)
    for _ in range(600):
        words, tile = random_words(rnd), rnd.choice([1, 16, 32, 1 << 16])
        hashes = mix(np.array([int(w[1:]) + 9 for w in words], np.uint64))
        joined = []
        for p, s, e in sorted(set(periods.fragments(hashes, tile))):
            if joined and joined[-1][2] == p and s <= joined[-1][0] + joined[-1][1] - p:
                joined[-1][1] = max(joined[-1][1], e - joined[-1][0])
            else:
                joined.append([s, e - s, p])
        found = sorted((tuple(r) for r in joined if r[1] >= max(6, 4 * r[2])), key=lambda r: (r[0], r[2]))
        assert found == brute_runs(words)


def brute_digest(words):
    runs = brute_runs(words)
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    left = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (len(runs), *first, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def planted(i, words):
    h, n = zlib.crc32(str(i).encode()), len(words)
    if i is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]


@pytest.mark.parametrize("tile", [16, periods.TILE])
def test_periodic_runs_equal_brute_force(spark, tile):
    rnd = random.Random(6)
    texts = {i: rnd.choice([" ", "\n", " \t "]).join(random_words(rnd)) for i in range(300)}
    texts |= {300: None, 301: "", 302: " \n", 303: "a b " * 700, 304: "é" + " é" * 5, 305: "x\x85y " * 6, 306: "z " * 5}
    rows = [(i, t, None, None) for i, t in texts.items()] + [(3, texts[3], None, None), (3, "q q q q q q q", None, None)]
    docs = periods.with_planted_tails(table(spark, [*rows, (None, "k l " * 5, None, None), (None, None, None, None)]))
    found = periods.run_digests(periods.periodic_runs(docs, tile)).collect()
    want = [(i, *brute_digest(planted(i, words_of(t)))) for i, t, _, _ in rows]
    want += [(None, *brute_digest(words_of("k l " * 5))), (None, *brute_digest([]))]
    assert sorted(map(repr, (tuple(r) for r in found))) == sorted(map(repr, want))


def test_a_long_text_is_one_run(spark):
    rows = [(1, "a b c " * 100_000, None, None), (2, " ".join(map(str, range(120_000))), None, None)]
    found = {r.doc_id: r for r in periods.periodic_runs(table(spark, rows)).collect()}
    assert [tuple(r) for r in found[1].runs] == [(0, 300_000, 3)] and found[1].collapsed == "a b c"
    assert found[2].runs == [] and found[2].collapsed == rows[1][1]
    assert periods.periodic_runs(table(spark, rows).limit(0)).count() == 0
