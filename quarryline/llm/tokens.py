"""Token counts by a sentencepiece vocabulary, from the pieces of each distinct pre-token.

A pre-token is a run of spaces with the word behind it. That cuts nothing a piece could span as long as no piece of the
vocabulary holds a space behind another character, or a line end; the vocabulary is looked through for that first. Pieces
are counted once for each distinct pre-token (and batch of them), and a document's count is the sum over its own
pre-tokens of frequency times pieces. No ids are made.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarryline.llm.blocks import per_distinct_word, unvarints, varints

#: Tokens beyond which a document is over the limit.
LIMIT = 4096

_PRE_TOKEN = re.compile(r" *[^ \n]+| +|\n")


def pre_tokens(text: str) -> list[str]:
    """The vocabulary puts a space before every text that is not empty, and writes spaces as the sign replaced here."""
    return _PRE_TOKEN.findall(" " + text.replace("▁", " ")) if text else []


class _Pieces:
    _read: dict[bytes, object] = {}

    def __init__(self, model: bytes):
        self._model, self._name = model, hashlib.blake2b(model).digest()

    def processor(self):
        import sentencepiece

        if self._name not in _Pieces._read:
            _Pieces._read[self._name] = sentencepiece.SentencePieceProcessor(model_proto=self._model)
        return _Pieces._read[self._name]

    def check(self) -> None:
        """Raises where counting by pre-tokens would differ from the library."""
        sp = self.processor()
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError("a piece spans pre-tokens")
        if sp.normalize("a  b\n c Ａ") != "▁a▁▁b\n▁c▁Ａ":
            raise ValueError("the vocabulary changes texts before it cuts them")

    def count(self, words: list[bytes]) -> list[int]:
        """Those that begin with a space stand for the text behind it; others get a line end, and lose it and the space
        before it again."""
        texts = [w.decode() for w in words]
        asked = [t[1:] if t[0] == " " else "\n" + t for t in texts]
        counts = [len(ids) for ids in self.processor().encode(asked, num_threads=1)]
        return [1 if t == " " else n if t[0] == " " else n - 2 for t, n in zip(texts, counts)]


def token_counts(documents: DataFrame, model_file: str, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``documents`` (columns ``doc_id`` and ``text``; others are ignored): ``doc_id, n_bytes,
    n_tokens, over_limit``.

    ``model_file`` is a sentencepiece model; the driver reads it and the tasks get its bytes. A null text counts as an
    empty one, of no bytes and no tokens. Special strings are plain text. A null ``doc_id`` is carried along, repeated rows
    are counted each, and an empty table gives an empty table.
    """
    with open(model_file, "rb") as file:
        pieces = _Pieces(file.read())
    pieces.check()

    def solve(words):
        counts = np.array(pieces.count(words), np.int64)
        return lambda numbers: varints(counts[numbers])

    def assemble(ids, sizes, frequencies, by_number):
        counts = np.array(by_number, np.int64)
        totals = [int((counts[numbers] * times).sum()) for numbers, times in frequencies]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array(totals, pa.int64()),
                pa.array([n > limit for n in totals], pa.bool_()),
            ],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    return per_distinct_word(
        documents,
        pre_tokens,
        solve,
        lambda payload: unvarints(payload).tolist(),
        assemble,
        "doc_id long, n_bytes long, n_tokens long, over_limit boolean",
        frequencies=True,
    )
