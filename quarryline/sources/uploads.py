"""What to do with files and requests as they come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import whole_word

# The parts of an exported file's name that do not belong to the table's name.
NAME_CLEANUP = (
    (r"\.(csv|pdf)\z", ""),
    (r"[^a-z0-9]+", "_"),
    (r"^(\d{4,8}|\d{4}_?q[1-4]|\d{2}_\d{2}_\d{2,4})_", ""),
    (r"^(export|extract|report|copy_of|final|raw|data|dump)_", ""),
    (r"_(export|extract|final|raw|copy|latest|\d{4,8})\z", ""),
    (r"_v\d+\z", ""),
    (r"_{2,}", "_"),
    (r"^_+|_+\z", ""),
)
FALLBACK_NAME = "my_table"
NAME_LENGTH = 40

# Words that ask for invented and for real figures.
INVENTED = (
    r"fake|synthetic|dummy|sample|mock|random|test data|made[- ]?up|placeholder|generate \d+ (fake|random)"
)
REAL = (
    r"real|actual|current|latest|today|this year|202\d|statistics|stats|by (gdp|population|country|region)"
    r"|top \d+ countries|official"
)


def suggest_table_name(file_name: Column) -> Column:
    name = F.lower(file_name)
    for pattern, replacement in NAME_CLEANUP:
        name = F.regexp_replace(name, pattern, replacement)
    usable = (name != "") & ~name.rlike(r"^\d")
    return F.substring(F.when(usable, name).otherwise(FALLBACK_NAME), 1, NAME_LENGTH)


def plan_uploads(files: DataFrame, file_name: str = "file_name") -> DataFrame:
    """Each file with the table name suggested for it, and whether other files got the same name.

    Counting names first keeps a name that many files share from gathering them in one task.
    """
    named = files.withColumn("table_name", suggest_table_name(F.col(file_name)))
    uses = named.groupBy("table_name").agg(F.count("*").alias("n_files"))
    return named.join(uses, "table_name").withColumn("clash", F.col("n_files") > 1)


def label_source(df: DataFrame, text: str, label: str = "source_label") -> DataFrame:
    """Whether a request asks for real or for invented data; ``ask`` when it says neither or both."""
    lowered = F.lower(F.col(text))
    invented, real = lowered.rlike(whole_word(INVENTED)), lowered.rlike(whole_word(REAL))
    return df.withColumn(
        label, F.when(invented & ~real, "synthetic").when(real & ~invented, "real").otherwise("ask")
    )
