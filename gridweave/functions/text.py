"""String helpers matching Python ``str`` semantics, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.isspace() set is Unicode White_Space plus the four ASCII
# separators U+001C..U+001F, which Java's (?U)\s leaves out.
_WS = r"[\s\x{1c}-\x{1f}]"
STRIP_PATTERN = r"(?U)^" + _WS + r"+|" + _WS + r"+$"


def py_strip(x: str | Column) -> Column:
    """``str.strip()`` (all Unicode whitespace, both ends)."""
    c = F.col(x) if isinstance(x, str) else x
    return F.regexp_replace(c, STRIP_PATTERN, "")


def is_blank(x: str | Column) -> Column:
    """``not x.strip()``; null counts as blank."""
    return F.coalesce(py_strip(x) == F.lit(""), F.lit(True))


def cell_label(row: str | Column, col: str | Column, row_span=None, col_span=None) -> Column:
    """F8: ``"R,C : RS,CS"`` when spans are given, else ``"row, col"``."""
    if row_span is None:
        return F.format_string("%d, %d", row, col)
    return F.format_string("%d,%d : %d,%d", row, col, row_span, col_span)


def page_file_name(page_no: str | Column, prefix: str = "table_struct_page_") -> Column:
    """zero-padded overlay file name, e.g. ``table_struct_page_00001.png``."""
    return F.format_string(prefix + "%05d.png", page_no)


def md_escape(x: str | Column) -> Column:
    """Escape ``|`` so a cell value cannot break a Markdown row."""
    c = F.col(x) if isinstance(x, str) else x
    return F.replace(c, F.lit("|"), F.lit("\\|"))
