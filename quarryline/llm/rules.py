"""Quality rules: what a text fails, how often its host fails, and the verdict of both.

Everything is made of built-in columns. Windows of three words are compared inside their own row: each is hashed,
hash and position are packed into one long, the longs are sorted, and neighbours of equal hash are compared word by
word. No text is shuffled; the only exchanges carry counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.session import workspace

#: The ASCII white space that ends words, and the characters counted as symbols.
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"


@dataclass(frozen=True)
class Rules:
    """Limits; ratios are integers over 100 so that no rule depends on rounding."""

    min_words: int = 50
    repeat_pct: int = 50
    symbol_pct: int = 10
    dup_line_pct: int = 30
    host_rate: float = 0.5


# Words found twice or more in windows of three: `z` holds hash << s | position in order, `q` the repeated positions.
# Neighbours of equal hash differ below 1 << s only; `m` is that bound.
_NEAR = "((v ^ get(z, k + {d})) >= 0 AND (v ^ get(z, k + {d})) < x.m AND {words})"
_WORDS = " AND ".join(
    f"get(x.w, CAST(v & (x.m - 1) AS INT) + {i}) = get(x.w, CAST(get(z, k + {{d}}) & (x.m - 1) AS INT) + {i})"
    for i in range(3)
)
_AFTER, _BEFORE = (_NEAR.format(d=d, words=_WORDS.format(d=d)) for d in ("1", "-1"))
_REPEATED = f"""
CASE WHEN size(words) < 3 THEN 0L ELSE
transform(array(struct(words AS w, CAST(ceil(log2(size(words) + 1)) AS INT) AS s,
                       shiftleft(1L, CAST(ceil(log2(size(words) + 1)) AS INT)) AS m)), x ->
  transform(array(sort_array(transform(slice(x.w, 1, size(x.w) - 2),
      (a, i) -> shiftleft(xxhash64(a, get(x.w, i + 1), get(x.w, i + 2)), x.s) | i))), z ->
    transform(array(sort_array(transform(filter(z, (v, k) -> {_AFTER} OR {_BEFORE}), v -> v & (x.m - 1)))), q ->
      aggregate(transform(q, (p, k) -> least(3L, coalesce(get(q, k + 1) - p, 3L))), 0L, (a, b) -> a + b)
    )[0]
  )[0]
)[0] END
"""


def words_of(text: Column) -> Column:
    """The words of a text: runs of anything but ASCII white space."""
    return F.array_remove(F.split(text, SPACES), "")


def measure(documents: DataFrame, *carry: str) -> DataFrame:
    """The columns ``carry`` and what the rules look at, one row per row. A null text has no words."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return (
        documents.select(*carry, text.alias("_text"))
        .select("*", words_of(F.col("_text")).alias("words"), lines.alias("_lines"))
        .select(
            *carry,
            F.size("words").cast("long").alias("n_words"),
            F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
            (F.length("_text") - F.length(F.regexp_replace("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            F.size("_lines").cast("long").alias("n_lines"),
            F.expr(_REPEATED).alias("n_repeat_words"),
        )
    )


def base_failed(rules: Rules) -> Column:
    return (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.repeat_pct * F.col("n_words")
    )


def any_failed(rules: Rules) -> Column:
    """What counts against a host: the base rules, too many symbols, too many repeated lines."""
    return (
        base_failed(rules)
        | (100 * F.col("n_symbols") > rules.symbol_pct * F.col("word_chars"))
        | (100 * F.col("n_dup_lines") > rules.dup_line_pct * F.col("n_lines"))
    )


def host_verdicts(measured: DataFrame, host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """One row per host: ``host, n_docs, n_failed, rate, host_ok``.

    ``rate`` is the host's failure rate drawn towards the rate of all documents by a beta prior. Its strength, within 1 and
    1000 documents, is fitted by the moments of beta-binomial counts: the spread of the hosts' rates less what documents drawn at
    random would give hosts of these sizes, so that many small hosts do not look like many different ones. Hosts that differ
    no more than by chance, or of one document each, are drawn to the common rate as strongly as can be. A host is turned
    down when its rate is over ``rules.host_rate``. Rows without a host count for no host.
    """
    hosts = (
        measured.where(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("host"))
        .agg(F.count("*").alias("n_docs"), F.sum(any_failed(rules).cast("long")).alias("n_failed"))
    )
    # one row: sums over hosts from which mean, correlation and strength follow
    prior = (
        hosts.agg(
            F.sum("n_docs").cast("double").alias("n"),
            F.sum("n_failed").cast("double").alias("f"),
            F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("ff"),
            F.sum(F.col("n_docs").cast("double") * F.col("n_docs")).alias("nn"),
            F.count("*").cast("double").alias("k"),
        )
        .select("*", (F.col("f") / F.col("n")).alias("mean"))
        .select(
            "mean",
            # what is between hosts beyond the k - 1 that chance alone gives, over the most that there could be
            F.when(F.col("mean") * (1 - F.col("mean")) > 0, F.expr("(ff - n * mean * mean) / (mean * (1 - mean)) - (k - 1)")).alias("excess"),
            F.expr("n - nn / n - (k - 1)").alias("room"),
        )
    )
    strength = F.when((F.col("excess") > 0) & (F.col("room") > 0), F.greatest(F.lit(1.0), F.least(F.lit(1000.0), F.col("room") / F.col("excess") - 1))).otherwise(1000.0)
    fitted = prior.select(F.struct("mean", strength.alias("strength")).alias("prior"))
    return (
        hosts.withColumn("_prior", fitted.scalar())
        .withColumn(
            "rate",
            (F.col("n_failed") + F.col("_prior.mean") * F.col("_prior.strength"))
            / (F.col("n_docs") + F.col("_prior.strength")),
        )
        .withColumn("host_ok", F.col("rate") <= rules.host_rate)
        .drop("_prior")
    )


def quality_rules(documents: DataFrame, host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """One row per row of ``documents`` (columns ``doc_id``, ``text`` and ``host``; others are ignored): ``doc_id``, the
    measures, ``base_failed`` and ``kept``, which is false when the base rules or the host's verdict say so.

    Null and empty texts have no words and fail. A null host has no verdict of its own: the base rules decide. Repeated
    rows are judged one by one. An empty table gives an empty table. Measures are written once as a table of counts below
    ``spark.checkpoint.dir``, since hosts and documents both read them.
    """
    spark = documents.sparkSession
    path = workspace(spark, "rules")
    rows = documents.select("doc_id", F.col(host).alias("_host"), "text")
    measure(rows, "doc_id", "_host").write.parquet(path)
    measured = spark.read.parquet(path)
    verdicts = host_verdicts(measured, "_host", rules).select(F.col("host").alias("_host"), "host_ok")
    failed = base_failed(rules)
    return measured.join(verdicts, "_host", "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & F.coalesce("host_ok", F.lit(True))).alias("kept"),
    )


def keep_good(documents: DataFrame, host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``documents`` that pass, with all their columns.

    Only hosts turned down are written and read back; Spark knows the size of that table when it plans the join.
    """
    spark = documents.sparkSession
    path = workspace(spark, "hosts")
    verdicts = host_verdicts(measure(documents.select(F.col(host).alias("_host"), "text"), "_host"), "_host", rules)
    verdicts.where(~F.col("host_ok")).select(F.col("host").alias("_bad")).write.parquet(path)
    bad = spark.read.parquet(path)
    row = documents.select(F.struct("*").alias("_row"), "text", F.col(host).alias("_host"))
    passed = measure(row, "_row", "_host").where(~base_failed(rules))
    return passed.join(bad, passed["_host"] == bad["_bad"], "left_anti").select("_row.*")
