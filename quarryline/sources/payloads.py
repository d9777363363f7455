"""Tables that arrive as JSON text or as one extraction per scanned page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import fit_cells
from ..functions.text import strip, unfence, with_quoted_object


def unnest_json_tables(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """Rectangular rows out of JSON table payloads: ``keep``, row number, columns, cells, status.

    A payload without a usable table gives one row without cells whose status says why.
    """
    table = F.col("_table")
    none = F.array().cast("array<string>")

    def items(text):
        """A JSON list as texts; anything else as an empty one."""
        return F.when(text.startswith("["), F.coalesce(F.from_json(text, "array<string>"), none)).otherwise(none)

    names = F.transform(items(table["columns"]), lambda name: F.coalesce(strip(name), F.lit("null")))
    rows = F.transform(items(table["rows"]), items)
    filled = F.filter(rows, lambda row: F.size(row) > 0)
    parsed = with_quoted_object(
        df.select(*keep, payload), unfence(F.col(payload), "(?i:json)"), ["columns", "rows"], "_table"
    ).select(
        *keep,
        F.when(table.isNull(), "not json")
        .when((F.size(names) == 0) | (F.size(filled) == 0), "no tabular data")
        .otherwise("ok")
        .alias("status"),
        names.alias("columns"),
        filled.alias("_rows"),
    )
    usable = F.when(F.col("status") == "ok", F.col("_rows"))
    return parsed.select(*keep, "status", "columns", F.posexplode_outer(usable).alias("row_no", "_row")).select(
        *keep,
        "status",
        "row_no",
        "columns",
        F.when(F.col("_row").isNotNull(), fit_cells(F.col("_row"), F.size("columns"))).alias("cells"),
    )


def _headers(pages: DataFrame) -> DataFrame:
    """Per document its first page and the columns of the first page that has any."""
    titled = F.when(F.size("columns") > 0, F.col("page"))
    return pages.groupBy("doc_id").agg(
        F.min("page").alias("first_page"), F.min_by(F.col("columns"), titled).alias("header")
    )


def stitch_pages(pages: DataFrame) -> DataFrame:
    """One table per document from its pages ``(doc_id, page, columns, rows)``.

    The first non-empty header stands for all pages; every page's rows follow in ``(page, row_no)``
    order, cut or filled to that header. Pages are never gathered per document: only headers are
    grouped, and the join back lets Spark split a document that holds many pages.
    """
    joined = pages.join(_headers(pages).filter(F.col("header").isNotNull()), "doc_id")
    return joined.select("doc_id", "page", "header", F.posexplode("rows").alias("row_no", "_row")).select(
        "doc_id",
        "page",
        "row_no",
        F.col("header").alias("columns"),
        fit_cells(F.col("_row"), F.size("header")).alias("cells"),
    )


def page_warnings(pages: DataFrame) -> DataFrame:
    """Pages of another width than their document's header, and documents without any table."""
    headers = _headers(pages)
    other_width = (
        pages.filter(F.size("columns") > 0)
        .select("doc_id", "page", F.size("columns").alias("width"))
        .join(headers, "doc_id")
        .filter((F.col("page") > F.col("first_page")) & (F.col("width") != F.size("header")))
        .select(
            "doc_id",
            F.col("page").cast("bigint").alias("page"),
            F.format_string("page %s had %s columns vs %s", "page", "width", F.size("header")).alias("warning"),
        )
    )
    tableless = headers.filter(F.col("header").isNull()).select(
        "doc_id", F.lit(0).cast("bigint").alias("page"), F.lit("no table found on any page").alias("warning")
    )
    return other_width.unionByName(tableless)
