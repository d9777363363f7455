"""Byte-level BPE by replaying merges over all distinct words of a corpus at once, and decoding.

The words are byte sequences in one array. An index holds, for each pair of neighbouring tokens that merges, the places
where it stands; merges are applied in the order of their ranks, each at all its places, and only the neighbours of
merged places are looked up again. A place that has changed since it was indexed is passed over.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quarryline.llm.blocks import BLOCK_BYTES, pack, per_distinct_word, unpack, unvarints, varints

_NONE = np.iinfo(np.int32).max
_PIECE = 1 << 19  # bytes of words whose pairs are first looked up at a time
# Letters, numbers and white space below U+0100, where the common pattern is matched by the faster engine.
_LETTERS, _NUMBERS, _SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"


class Splitter:
    """Cuts a text by a pattern of the kind ``public_tokenizers.PATTERN``; white space is Unicode's property."""

    def __init__(self, pattern: str):
        wide = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        narrow = pattern
        for name, inside in ((r"\p{L}", _LETTERS), (r"\p{N}", _NUMBERS), (r"\s", _SPACE)):
            narrow = re.sub(r"(\[[^\]]*)" + re.escape(name), lambda m, inside=inside: m.group(1) + inside, narrow)
            narrow = narrow.replace(name, f"[{inside}]")
        narrow = narrow.replace(r"\S", f"[^{_SPACE}]")
        self._wide, self._narrow = regex.compile(wide), re.compile(narrow)

    def __call__(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._wide.findall(text)
        return self._narrow.findall(text)


class Merges:
    """The ranks of a vocabulary, and of each pair of its tokens that merges."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self._shift = max(self.tokens).bit_length()
        found = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    found[left << self._shift | right] = rank
        self._keys = np.array(sorted(found), np.int64)
        self._values = np.array([found[k] for k in self._keys.tolist()], np.int32)
        self._bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the token that each pair makes, or _NONE."""
        keys = left.astype(np.int64) << self._shift | right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._values[at], np.int32(_NONE))

    def one(self, word: bytes) -> list[int]:
        """A single word, the least rank first and of equal ones the leftmost."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b, _NONE) for a, b in zip(parts, parts[1:])]
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (none of them empty) one behind the other, and how many each has. A word that is a token itself
        is that token."""
        if not words:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        token = self._bytes[np.frombuffer(b"".join(words), np.uint8)]
        n = len(token)
        after = np.arange(1, n + 1, dtype=np.int32)
        after[starts[1:] - 1] = -1
        after[n - 1] = -1
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[starts] = -1
        rank = np.full(n, _NONE, np.int32)
        for low in range(0, n, _PIECE):
            inside = np.flatnonzero(after[low : low + _PIECE] >= 0) + low
            rank[inside] = self.pair_ranks(token[inside], token[inside + 1])
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def note(places: np.ndarray) -> None:
            """Puts places into the index by the rank of the pair that begins there."""
            found = rank[places]
            places, found = places[found != _NONE], found[found != _NONE]
            if not len(places):
                return
            order = np.argsort(found, kind="stable")
            places, found = places[order], found[order]
            cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
            for r, part in zip(found[np.concatenate(([0], cuts))].tolist(), np.split(places, cuts)):
                if r not in index:
                    index[r] = []
                    heapq.heappush(queue, r)
                index[r].append(part)

        for low in range(0, n, _PIECE):
            note(np.arange(low, min(n, low + _PIECE), dtype=np.int32))
        odd = []  # words in which a merge gave a pair of lower rank: their equal pairs may not be merged at once
        while queue:
            r = heapq.heappop(queue)
            places = index.pop(r)
            places = np.unique(np.concatenate(places)) if len(places) > 1 else np.sort(places[0])
            places = places[rank[places] == r]
            if not len(places):
                continue
            follows = np.concatenate(([False], after[places[:-1]] == places[1:]))
            if follows.any():  # runs such as aaaa: every other pair, from the left
                at = np.arange(len(places))
                places = places[(at - np.maximum.accumulate(np.where(follows, 0, at))) % 2 == 0]
            right = after[places]
            beyond = after[right]
            token[places], token[right], rank[right] = r, -1, _NONE
            after[places] = beyond
            has = beyond >= 0
            before[beyond[has]] = places[has]
            rank[places] = _NONE
            rank[places[has]] = self.pair_ranks(token[places[has]], token[beyond[has]])
            left = before[places]
            left = left[left >= 0]
            rank[left] = self.pair_ranks(token[left], token[after[left]])
            touched = np.concatenate((places, left))
            if (rank[touched] < r).any():
                odd.append(touched[rank[touched] < r])
            note(np.unique(touched))
        left_over = token >= 0
        ids, counts = token[left_over], np.add.reduceat(left_over.astype(np.int8), starts, dtype=np.int64)
        begins = np.cumsum(counts) - counts
        other = {i: [self.ranks[words[i]]] for i in np.flatnonzero(counts > 1).tolist() if words[i] in self.ranks}
        for place in np.unique(np.concatenate(odd)).tolist() if odd else []:
            at = int(np.searchsorted(starts, place, "right")) - 1
            if at not in other and words[at] not in self.ranks:
                other[at] = self.one(words[at])
        if other:  # put in place of what the merges gave
            parts, done = [], 0
            for at in sorted(other):
                parts += [ids[done : begins[at]], np.array(other[at], np.int32)]
                done = begins[at] + counts[at]
                counts[at] = len(other[at])
            ids = np.concatenate([*parts, ids[done:]])
        return ids, counts


def _places(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where stretches stand that begin at ``begins`` and are ``sizes`` long, place by place."""
    ahead = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(begins - ahead, sizes)


def _answers_of(ids: np.ndarray, counts: np.ndarray) -> Callable[[np.ndarray], bytes]:
    """Packs the ids of the words of some numbers."""
    begins = np.cumsum(counts) - counts

    def take(numbers: np.ndarray) -> bytes:
        return pack(varints(counts[numbers]), varints(ids[_places(begins[numbers], counts[numbers])]))

    return take


def _unpack_ids(payload: bytes) -> list[np.ndarray]:
    sizes, ids = unpack(payload)
    return np.split(unvarints(ids), np.cumsum(unvarints(sizes))[:-1])


class _Once:
    """A vocabulary in bytes that each worker process reads when it first needs it."""

    _read: dict[bytes, Merges] = {}

    def __init__(self, rank_file: bytes):
        self._file, self._name = rank_file, hashlib.blake2b(rank_file).digest()

    def __call__(self) -> Merges:
        if self._name not in _Once._read:
            _Once._read[self._name] = Merges(self._file)
        return _Once._read[self._name]


def encode(
    documents: DataFrame, rank_file: str, pattern: str, with_ids: bool = False, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per row of ``documents`` (columns ``doc_id`` and ``text``; others are ignored): ``doc_id, n_tokens,
    ids_sha256, decoded_sha256``, with ``ids`` as an array behind them when asked for.

    ``rank_file`` is a file of ranks in the form of the tiktoken library and ``pattern`` cuts words; the driver reads the
    file and the tasks get its bytes. ``ids_sha256`` is of the decimal ids joined by commas, ``decoded_sha256`` of the
    bytes that the ids stand for. Documents are kept in blocks of ``block_bytes``: larger ones send fewer words twice, smaller
    ones need less memory. Null and empty texts have no tokens; special strings are plain text; a null ``doc_id``
    is carried along, repeated rows are encoded each, and an empty table gives an empty table.
    """
    with open(rank_file, "rb") as file:
        merges = _Once(file.read())
    splitter = Splitter(pattern)

    def assemble(ids, sizes, sequences, by_number):
        tokens = merges().tokens
        texts = [b",".join(b"%d" % i for i in a.tolist()) for a in by_number]
        decoded = [b"".join([tokens[i] for i in a.tolist()]) for a in by_number]
        lengths = np.array([len(a) for a in by_number], np.int64)
        numbers = [s.tolist() for s in sequences]
        columns = [
            pa.array(ids, pa.int64()),
            pa.array([int(lengths[s].sum()) for s in sequences], pa.int64()),
            pa.array([hashlib.sha256(b",".join([texts[i] for i in s])).hexdigest() for s in numbers], pa.string()),
            pa.array([hashlib.sha256(b"".join([decoded[i] for i in s])).hexdigest() for s in numbers], pa.string()),
        ]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            flat, begins = np.concatenate([*by_number, np.empty(0, np.int64)]).astype(np.int32), np.cumsum(lengths) - lengths
            places = [_places(begins[s], lengths[s]) for s in sequences]
            ends = np.concatenate(([0], np.cumsum([len(p) for p in places]))).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(ends, flat[np.concatenate([*places, np.empty(0, np.int64)]).astype(np.int64)]))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    return per_distinct_word(
        documents,
        splitter,
        lambda words: _answers_of(*merges().replay(words)),
        _unpack_ids,
        assemble,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""),
        block_bytes=block_bytes,
    )


def decode(encoded: DataFrame, rank_file: str) -> DataFrame:
    """``doc_id, bytes`` from ``doc_id`` and ``ids``. Null ids are no tokens; an id the vocabulary lacks stops the job."""
    with open(rank_file, "rb") as file:
        merges = _Once(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = merges().tokens
        for batch in batches:
            texts = [b"".join([tokens[i] for i in ids or ()]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")
