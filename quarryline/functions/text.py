"""Text expressions, all of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\r\f\x0b"


def strip(text: Column) -> Column:
    """Without blanks, tabs or line ends at either side."""
    return F.trim(text, F.lit(BLANKS))


def whole_word(alternatives: str) -> str:
    """Pattern for any of the alternatives as a whole ASCII word.

    Java's ``\\b`` counts accented letters as word characters, so ``é`` before a word would hide it.
    """
    return rf"(?<![A-Za-z0-9_])(?:{alternatives})(?![A-Za-z0-9_])"


def count_of(text: Column, mark: str) -> Column:
    """How often a single character occurs."""
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def unfence(text: Column, labels: str) -> Column:
    """Without the three-backtick fences of a quoted code block and their language label."""
    return strip(F.regexp_replace(text, f"```(?:{labels})?", ""))


def with_object(df: DataFrame, text: Column, fields: list[str], into: str) -> DataFrame:
    """Adds the text's JSON object as a struct of texts, null when it is anything but one object.

    A field that holds a list or an object keeps its JSON. Parsing the text as the only element of
    a list is what makes Spark refuse text that goes on after the object. Exploding the one result
    keeps the optimizer from repeating the parse for every field read and filter set later.
    """
    schema = f"array<struct<{', '.join(f'`{name}`: string' for name in fields)}>>"
    parsed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), schema)
    one = F.transform(F.array(parsed), lambda objects: F.when(F.size(objects) == 1, objects[0]))
    return df.select("*", F.explode(one).alias(into))


def with_quoted_object(df: DataFrame, text: Column, fields: list[str], into: str) -> DataFrame:
    """As ``with_object``, for an object in a reply: from its first ``{`` to its last ``}``."""

    def quoted(t: Column) -> Column:
        first, last = F.instr(t, "{"), F.length(t) - F.instr(F.reverse(t), "}") + 1
        return F.when((first > 0) & (last > first), F.substr(t, first, last - first + 1)).otherwise(t)

    return with_object(df, F.transform(F.array(text), quoted)[0], fields, into)  # the text is worked out once, not for each use
