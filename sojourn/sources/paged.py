"""Tables that arrive as pages of cells, with a header on the first page and maybe on later ones."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.session import materialize

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def stitch_pages(cells: DataFrame, columns: Mapping[str, str], number_header: str = "STT", every_page: bool = False) -> DataFrame:
    """Rows of all pages under one set of columns.

    ``cells`` has (file, page, row_no, cells array<string>); ``columns`` maps header text to output
    names. The first row of a file is its header. A later page whose first cell repeats the row-number
    header brings its own header, otherwise the file's header applies; with ``every_page`` the first row of
    each page is its header, whatever it holds. Case and outer spaces of headers
    do not matter. Rows whose row number is no number are dropped. Headers are found by aggregates that combine inside the input tasks and joined
    to the rows per page, so a file of any number of pages spreads over the cluster.
    """
    first_rows = cells.groupBy("file", "page").agg(
        F.min_by("cells", "row_no").alias("first_cells"), F.min("row_no").alias("first_no")
    )
    first_rows = materialize(first_rows, "first-rows")
    file_headers = first_rows.groupBy("file").agg(
        F.min_by("first_cells", "page").alias("file_header"), F.min("page").alias("first_page")
    )
    file_headers = materialize(file_headers, "file-headers")
    repeats = F.upper(F.trim(F.get("first_cells", 0))) == number_header.upper()
    own = F.lit(every_page) | (F.col("page") == F.col("first_page")) | F.coalesce(repeats, F.lit(False))
    headers = first_rows.join(file_headers, "file").select(
        "file", "page",
        F.transform(
            F.when(own, F.col("first_cells")).otherwise(F.col("file_header")), lambda h: F.upper(F.trim(h))
        ).alias("header"),
        F.when(own, F.col("first_no")).alias("header_no"),
    )
    rows = cells.join(headers, ["file", "page"]).filter(
        F.col("header_no").isNull() | (F.col("row_no") != F.col("header_no"))
    )

    def cell(header: str) -> Column:
        return F.get("cells", F.array_position("header", header.upper()).cast("int") - 1)

    number = cell(number_header)
    has_numbers = F.array_contains("header", number_header.upper())
    kept = rows.filter(~has_numbers | F.coalesce(number.rlike(_NUMBER), F.lit(False)))
    return kept.select("file", "page", "row_no", *[cell(h).alias(n) for h, n in columns.items()])
