"""Filter commands sent to a dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import with_object

# What a command means where it does not say.
ACTION = "set_filter"
WORKSHEET = "Stages"
FIELD = "Stage"

_NAMED = ["action", "worksheet", "field", "value"]


def _given(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def normalize_commands(df: DataFrame, body: str = "body") -> DataFrame:
    """Commands of three JSON shapes as ``status, action, worksheet, field, value``.

    A typed command value comes before a named action, and that before nested parameters. A body that is not JSON has
    the status ``not json`` and no action; all others are ``ok``. Works on a stream as on a table.
    """
    sent = with_object(df, F.col(body), ["command_type", "command_value", *_NAMED, "parameters"], "_body")
    parsed = with_object(sent, F.col("_body.parameters"), _NAMED, "_nested")
    b, nested = F.col("_body"), F.col("_nested")
    typed = _given(b["command_type"]) & _given(b["command_value"])
    named = _given(b["action"])

    def pick(name: str, default: str | None) -> Column:
        said = F.when(typed, b["command_value"] if name == "value" else F.lit(None)).when(named, b[name]).otherwise(
            nested[name]
        )
        filled = F.when(_given(said), said).otherwise(default) if default else said
        return F.when(b.isNotNull(), filled).alias(name)

    status = F.when(b.isNull(), "not json").otherwise("ok").alias("status")

    kept = [c for c in df.columns if c != body]
    return parsed.select(
        *kept, status, pick("action", ACTION), pick("worksheet", WORKSHEET), pick("field", FIELD), pick("value", None)
    )


def commands_since(commands: DataFrame, command_id: str, seq: str = "seq") -> DataFrame:
    """Commands after the one last seen, in the order they came; all of them when it is not known.

    A command without ``seq`` stands behind all others, so it comes after any cursor.
    """
    seen = commands.filter(F.col("command_id") == command_id).agg(F.min(seq))
    return commands.filter(seen.scalar().isNull() | F.col(seq).isNull() | (F.col(seq) > seen.scalar()))


def filters_in_force(commands: DataFrame, seq: str = "seq") -> DataFrame:
    """``worksheet, field, value, seq`` of the last command per worksheet and field, names of fields in lower case.

    Commands may come late, out of order or twice: the greatest ``seq`` decides, and of one ``seq`` the greatest value.
    Works on a stream as on a table, with a state of one row per worksheet and field.
    """
    last = F.max(F.struct(F.col(seq).alias("seq"), "value")).alias("last")
    return (
        commands.filter(F.col("action") == ACTION)
        .groupBy("worksheet", F.lower("field").alias("field"))
        .agg(last)
        .select("worksheet", "field", "last.value", "last.seq")
    )


def apply_in_force(df: DataFrame, filters: DataFrame, worksheet: str = WORKSHEET, fields: list[str] | None = None) -> DataFrame:
    """The rows that pass a worksheet's filters in force (``filters_in_force``).

    There is at most one filter in force per field; they are fetched and become
    conditions on the columns, their values cast to the column's type, so that the scan can leave out what does not
    pass. A filter without value asks for rows without value; a value that the type cannot hold matches no row.
    """
    names = {name.lower(): name for name in fields or df.columns}
    types = {f.name.lower(): f.dataType for f in df.schema.fields}
    wanted = filters.filter((F.col("worksheet") == worksheet) & F.col("field").isin(*names))
    for row in wanted.select("field", "value").collect():  # a row per field at most
        column = F.col(f"`{names[row['field']]}`")
        value = F.lit(row["value"]).try_cast(types[row["field"]])
        df = df.filter(column.isNull() if row["value"] is None else column == value)
    return df


def apply_filters(
    df: DataFrame, commands: DataFrame, worksheet: str = WORKSHEET, fields: list[str] | None = None, seq: str = "seq"
) -> DataFrame:
    """The rows that pass a worksheet's filters, the last command per field being the one in force.

    Field names are compared without case; see ``apply_in_force``.
    """
    return apply_in_force(df, filters_in_force(commands.filter(F.col("worksheet") == worksheet), seq), worksheet, fields)
