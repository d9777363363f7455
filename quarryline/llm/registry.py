"""The queries of this subpackage, and the same in SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers

from quarryline.llm import sqls
from quarryline.llm.bpe import encode
from quarryline.llm.collocations import collocations
from quarryline.llm.leaks import leaks
from quarryline.llm.mixing import mix
from quarryline.llm.neardup import near_duplicates
from quarryline.llm.pages import extract
from quarryline.llm.periods import periodic_runs, run_digests, with_planted_tails
from quarryline.llm.quality import quality_scores
from quarryline.llm.repeats import remove_repeats
from quarryline.llm.rules import quality_rules
from quarryline.llm.secrets import secret_scan
from quarryline.llm.tokens import token_counts
from quarryline.llm.toxicity import toxicity_scores
from quarryline.registry.base import Check, table


def _op1(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def _op2(spark, sf_dir):
    return secret_scan(table(spark, sf_dir, "documents"))


def _op3(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))


def _op4(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def _op5(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op6(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


def _op7(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))


def _op8(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def _op9(spark, sf_dir):
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op10(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _op11(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).drop("times")


def _op12(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


def _op13(spark, sf_dir):
    return run_digests(periodic_runs(with_planted_tails(table(spark, sf_dir, "documents"))))


CHECKS: dict[str, Check] = {
    "op1_token_counts": Check(_op1),
    "op2_secret_scan": Check(_op2),
    "op3_quality_rules": Check(_op3, sqls.QUALITY_RULES),
    "op4_near_duplicates": Check(_op4, sqls.NEAR_DUPLICATES),
    "op5_quality_classifier": Check(_op5),
    "op6_html_text": Check(_op6),
    "op7_repeated_passages": Check(_op7),
    "op8_byte_bpe": Check(_op8),
    "op9_toxicity": Check(_op9),
    "op10_benchmark_leaks": Check(_op10, sqls.LEAKS),
    "op11_source_mix": Check(_op11, sqls.MIX),
    "op12_collocations": Check(_op12, sqls.COLLOCATIONS),
    "op13_periodic_runs": Check(_op13),
}
