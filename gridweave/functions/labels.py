"""Class-id lookups as literal map expressions.

The maps are tiny and fixed, so they are evaluated inside the projection
(``element_at(map, id)``) instead of a join: no exchange, no broadcast.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: must equal the reference's label tables -----------------
# Table classifier classes.
TABLE_CLASSES = {0: "wired", 1: "wireless"}

# Layout detector classes (P9), id -> name.
LAYOUT_CLASSES = {
    0: "abstract",
    1: "algorithm",
    2: "aside_text",
    3: "chart",
    4: "content",
    5: "display_formula",
    6: "doc_title",
    7: "figure_title",
    8: "footer",
    9: "footer_image",
    10: "footnote",
    11: "formula_number",
    12: "header",
    13: "header_image",
    14: "image",
    15: "inline_formula",
    16: "number",
    17: "paragraph_title",
    18: "reference",
    19: "reference_content",
    20: "seal",
    21: "table",
    22: "text",
    23: "vertical_text",
    24: "vision_footnote",
}

# Layout class id -> document item label (P10).
LAYOUT_DOC_LABELS = {
    0: "text",
    1: "code",
    2: "text",
    3: "picture",
    4: "text",
    5: "formula",
    6: "title",
    7: "caption",
    8: "page_footer",
    9: "page_footer",
    10: "footnote",
    11: "text",
    12: "page_header",
    13: "page_header",
    14: "picture",
    15: "formula",
    16: "text",
    17: "section_header",
    18: "text",
    19: "text",
    20: "picture",
    21: "table",
    22: "text",
    23: "text",
    24: "footnote",
}

# Document labels that carry a table structure.
TABLE_LIKE_LABELS = ("table", "document_index")
# ---------------------------------------------------------------------------


def literal_map(d: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in d.items()))


def lookup(d: dict, key: str | Column) -> Column:
    """``d.get(key)`` as an expression; unknown keys give null."""
    k = F.col(key) if isinstance(key, str) else key
    return F.element_at(literal_map(d), k.cast("int"))


def table_class_label(class_id="class_id") -> Column:
    return lookup(TABLE_CLASSES, class_id)


def layout_class_label(class_id="class_id") -> Column:
    return lookup(LAYOUT_CLASSES, class_id)


def layout_doc_label(class_id="class_id") -> Column:
    return lookup(LAYOUT_DOC_LABELS, class_id)


def sql_case(d: dict, key: str) -> str:
    """The same lookup as a portable SQL ``CASE`` (used by oracles and SQL users)."""
    arms = " ".join(f"WHEN {k} THEN '{v}'" for k, v in d.items())
    return f"CASE {key} {arms} END"
