"""Judging tables of SQL statements before any of them is run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.periods import period
from ..functions.text import count_of, strip, unfence, whole_word, with_quoted_object

# What statements start with, by what they do.
READ_VERBS = ("select", "show", "describe", "desc", "explain", "with", "use")
DESTRUCTIVE_VERBS = (
    "drop", "delete", "truncate", "alter", "update", "rename", "replace",
    "grant", "revoke", "merge", "copy", "vacuum", "optimize",
)
CREATABLE = ("catalog", "schema", "database", "table", "index", "view")
# A read must not hold any of these, unless as a function's name. INSERT may hide behind a WITH.
SMUGGLED_VERBS = (*DESTRUCTIVE_VERBS, "insert")

# Functions that run code by its name, or take any name as text, and formats that read a file named as a table.
RUNNING_FUNCTIONS = ("java_method", "reflect", "try_reflect", "identifier")
FILE_FORMATS = ("avro", "binaryfile", "csv", "delta", "image", "json", "libsvm", "orc", "parquet", "text", "xml")

# Literals and comments as Spark reads them, whichever starts first: raw literals have no escapes, a carriage return ends a
# comment and a backslash before the line end carries it on. A doubled quote reads as two literals side by side.
# Possessive loops keep the matcher from recursing, however long the literal is.
_LITERALS = (
    r"(?<![A-Za-z0-9_])[rR](?:'[^']*+'|\"[^\"]*+\")"
    r"|'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+'"
    r'|"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"'
    r"|/\*[\s\S]*?\*/|--(?:[^\r\n\\]|\\\n|\\)*+|#[^\r\n]*"
)
# What one pattern cannot follow, and is refused: a comment opened inside another, a hint or a quoted name with quotes or
# comment signs in it.
_UNFOLLOWED = (
    r"/\*[^*/]*+(?:(?:\*(?!/)|/(?!\*))[^*/]*+)*+/\*"
    r"|/\*\+[^*'\"`]*+['\"`]"
    r"|`[^`]*?(?:['\"]|--|/\*|#)[^`]*`"
)
# Fixed value: literals without content where a condition needs one.
_EMPTY_LITERAL = rf"(?i)(?:{whole_word('in')}\s*\(|=\s*|,\s*)''(?:\s*[,)]|\s*\z)"


def strip_literals(sql: Column) -> Column:
    """The statement without comments and quoted text, blanks run together."""
    return strip(F.regexp_replace(F.regexp_replace(sql, _LITERALS, " "), r"\s+", " "))


def split_statements(sql: Column) -> Column:
    """The non-empty statements of a text, none of them split inside a literal."""
    return F.filter(F.transform(F.split(strip_literals(sql), ";"), strip), lambda s: s != "")


def _starts(statement: Column, words: str) -> Column:
    return statement.rlike(rf"(?i)^{words}(?![A-Za-z0-9_])")


def _kind(statement: Column, verb: Column) -> Column:
    creates = _starts(statement, rf"create\s+(?:temporary\s+)?(?:{'|'.join(CREATABLE)})")
    return (
        F.when(verb.isin(*DESTRUCTIVE_VERBS), "destructive")
        .when(
            verb == "create",
            F.when(_starts(statement, r"create\s+or\s+replace"), "destructive").when(creates, "create").otherwise("unknown"),
        )
        .when(verb == "insert", F.when(_starts(statement, r"insert\s+overwrite"), "destructive").otherwise("create"))
        .when(verb.isin(*READ_VERBS), "read")
        .otherwise("unknown")
    )


def _first_smuggled(statement: Column) -> Column:
    """The first forbidden verb, in the order of the list, that is not called as a function."""
    pattern = F.lit(rf"(?i)({whole_word('|'.join(SMUGGLED_VERBS))})(?!\s*\()")
    found = F.transform(F.regexp_extract_all(statement, pattern, F.lit(1)), F.lower)
    listed = F.array(*[F.lit(verb) for verb in SMUGGLED_VERBS])
    return F.try_element_at(F.array_intersect(listed, found), F.lit(1))


_RUNNING = rf"(?i)\b({'|'.join(RUNNING_FUNCTIONS)})`?\s*\("
_FILE = rf"(?i)(?:\b(?:from|join|into|table|describe|desc)\s+|,\s*)`?(?:{'|'.join(FILE_FORMATS)})`?\s*\.\s*`|`[^`]*/[^`]*`"


def classify_statements(df: DataFrame, sql: str) -> DataFrame:
    """Whether each text is one statement of a known kind, and whether it needs confirmation or write access.

    Adds ``ok``, ``kind`` (read, create, destructive, unknown), ``reason`` (empty when ok),
    ``needs_confirmation`` and ``needs_write``. Only built-in expressions; no row leaves its task.
    """
    text = F.col(sql)
    blank = text.isNull() | (strip(text) == "")
    split = df.withColumn("_statements", split_statements(text))
    statement = F.coalesce(F.try_element_at("_statements", F.lit(1)), F.lit(""))
    named = split.withColumn("_n", F.coalesce(F.size("_statements"), F.lit(0))).withColumn("_s", statement)
    verbed = named.withColumn("_verb", F.lower(F.regexp_extract("_s", r"(?i)^([a-z_]+)", 1)))
    judged = verbed.withColumn(
        "_kind", F.when(F.col("_n") == 1, _kind(F.col("_s"), F.col("_verb"))).otherwise("unknown")
    )
    judged = judged.withColumn("_hidden", F.when(F.col("_kind") == "read", _first_smuggled(F.col("_s"))))
    unfollowed = text.rlike(_UNFOLLOWED)
    running = F.nullif(F.lower(F.regexp_extract("_s", _RUNNING, 1)), F.lit(""))
    by_path = F.col("_s").rlike(_FILE)
    into_file = (F.col("_kind") == "read") & F.col("_s").rlike(
        "(?i)" + whole_word(r"into\s+(?:outfile|dumpfile)")
    )
    reason = (
        F.when(blank, "empty SQL")
        .when(unfollowed, "comments or names that may hide code")
        .when(F.col("_n") == 0, "no executable statement")
        .when(F.col("_n") > 1, F.format_string("%s statements at once; send one", "_n"))
        .when(F.col("_kind") == "unknown", F.format_string('unrecognised statement type: "%s"', "_verb"))
        .when(F.col("_hidden").isNotNull(), F.format_string('read statement contains "%s"', F.upper("_hidden")))
        .when(into_file, "read statement writes to a file")
        .when(running.isNotNull(), F.format_string('statement calls "%s"', running))
        .when(by_path, "statement names a file as a table")
        .otherwise("")
    )
    kind = F.when(unfollowed | (F.col("reason").startswith("statement ")), "unknown").when(F.col("_hidden").isNotNull() | into_file, "destructive").otherwise(F.col("_kind"))
    return (
        judged.withColumn("reason", reason)
        .withColumn("kind", kind)
        .withColumn("ok", F.col("reason") == "")
        .withColumn("needs_confirmation", F.col("kind") == "destructive")
        .withColumn("needs_write", F.col("kind") != "read")
        .select(*df.columns, "ok", "kind", "reason", "needs_confirmation", "needs_write")
    )


def degenerate_reason(sql: Column) -> Column:
    """Why a statement is plainly malformed, or null. Looks at the text as written."""
    return (
        F.when(sql.isNull() | (strip(sql) == ""), "empty SQL")
        .when(sql.rlike(_EMPTY_LITERAL), "contains empty string literals")
        .when(count_of(sql, "`") % 2 != 0, "unbalanced backticks")
        .when(count_of(sql, "'") % 2 != 0, "unbalanced single quotes")
    )


def degenerate_sql(df: DataFrame, sql: str) -> DataFrame:
    return df.withColumn("degenerate", degenerate_reason(F.col(sql)))


def review_replies(df: DataFrame, reply: str) -> DataFrame:
    """Replies holding ``{"sql", "explanation"}`` as JSON, judged for running.

    The kept ``sql`` is the text as written, without closing semicolons: running the stripped form
    would change what its literals match.
    """
    bodies = with_quoted_object(df, unfence(F.col(reply), "json|sql"), ["sql", "explanation"], "_body")
    parsed = bodies.withColumn("_sql", F.coalesce(F.col("_body.sql"), F.lit("")))
    flawed = F.transform(F.array(degenerate_reason(F.col("_sql"))), lambda flaw: flaw)  # explode: tested once, read often
    judged = classify_statements(parsed.select("*", F.explode(flawed).alias("_malformed")), "_sql")
    malformed = F.col("_malformed")
    unanswered = F.coalesce(F.nullif(F.col("_body.explanation"), F.lit("")), F.lit("cannot answer from the schema"))
    reason = (
        F.when(F.col("_body").isNull(), "reply is not JSON")
        .when(F.col("_sql") == "", unanswered)
        .when(malformed.isNotNull(), F.concat(F.lit("malformed SQL: "), malformed))
        .otherwise(F.col("reason"))
    )
    readable = F.col("_body").isNotNull() & (F.col("_sql") != "") & malformed.isNull()
    return judged.select(
        *df.columns,
        (readable & F.col("ok")).alias("ok"),
        F.when(readable, F.col("kind")).otherwise("unknown").alias("kind"),
        reason.alias("reason"),
        F.regexp_replace(strip(F.col("_sql")), r"(?<!;);++\s*\z", "").alias("sql"),
        F.coalesce(F.col("_body.explanation"), F.lit("")).alias("explanation"),
        (readable & F.col("ok") & F.col("needs_confirmation")).alias("needs_confirmation"),
    )


def audit_rollup(judged: DataFrame, user: str, at: str) -> DataFrame:
    """Statements per user, day and kind, and how many of them were refused."""
    return judged.groupBy(user, period(F.col(at)).alias("day"), "kind").agg(
        F.count("*").alias("n_statements"), F.count_if(~F.col("ok")).alias("n_refused")
    )
