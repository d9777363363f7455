"""Registered queries: against their SQL, and the pipeline stage by stage against brute force."""

import hashlib

import corpus_pipeline
import pytest
from quarryline.llm import registry, secrets
from tests.llm.test_operators import groups, measures, secrets_words
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, c in registry.CHECKS.items() if c.sql])
def test_query_equals_sql(spark, name):
    assert compare(registry.CHECKS[name].run(spark, SF), connect(SF), registry.CHECKS[name].sql) is None


@pytest.mark.parametrize("name", [n for n, c in registry.CHECKS.items() if not c.sql])
def test_query_has_a_row_per_row(spark, name):
    source = "pages" if name.startswith("op6") else "documents"
    assert registry.CHECKS[name].run(spark, SF).count() == spark.read.parquet(f"{SF}/{source}.parquet").count()


def test_pipeline_equals_brute_force(spark):
    import base64

    import public_tokenizers
    import tiktoken

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = {}
    for i, text in sorted(docs.items()):
        n, _, _, _, repeated = measures(text)
        if n >= 50 and 100 * repeated <= 50 * n:
            good[i] = text
    single = {i: text for (i, text), (_, low) in zip(good.items(), groups(list(good.values()))) if list(good)[low] == i}
    items = []
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        words = secrets_words(r.text)
        items.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)})
    clean = {}
    for i, text in single.items():
        words = secrets_words(text)
        own = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        if not any(100 * len(item & own) >= 75 * len(item) for item in items):
            clean[i] = secrets.redact(text, secrets.scan(text))
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(rows) == set(clean)
    for i, text in clean.items():
        ids = library.encode_ordinary(text)
        assert rows[i].n_tokens == len(ids) and rows[i].ids == ids
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(20), SF).columns == docs.columns
