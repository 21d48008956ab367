"""Text-to-cell spatial join and ordered text concatenation.

A text box matches a cell when its area is positive, the two intersect, and
``intersection / area(text) > overlap`` (strict). Matched texts are stripped
and joined with one space in text order; a cell without text gets ``""``.

Join strategy. Joining on the image key alone would test every cell against
every text of the image. Instead both sides are bucketed into square tiles
of side ``tile`` (each box lists the tiles it touches, an ``explode`` of a
small ``sequence``) and joined on ``(key, tile_x, tile_y)``. A pair is kept
only in the tile holding the top-left corner of its intersection, which both
boxes cover, so each pair appears exactly once and no pair is lost. A tile is
about as large as a table cell: the rows sent to the join are then few for each
box, and the pairs that meet in a tile are bounded by what stands there, even
when one image holds most of the boxes. The pairs are tested inside the join;
only matches, and one row for each cell, go on to the grouping.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.functions.text import py_strip

from gridweave.constants import TEXT_OVERLAP as DEFAULT_OVERLAP  # noqa: E402

BACKEND_OVERLAP = 0.5  # page-text lookup under a box (fallback)
DEFAULT_TILE = 256.0  # no result depends on it; at 64 a cell touches about seven tiles


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _tiles(df: DataFrame, tile: float, prefix: str, active: Column | None = None, spread: Column | None = None) -> DataFrame:
    """One row for each tile that a box touches, with ``_first`` on one of them.

    Inactive rows get one tile that no text has, spread by ``spread`` so that
    they do not meet in one task.
    """
    t = F.lit(float(tile))
    at = {e: F.floor(F.col(prefix + e).cast("double") / t) for e in "ltrb"}

    def rng(lo: str, hi: str, apart: Column | None) -> Column:
        seq = F.sequence(at[lo], F.greatest(at[lo], at[hi]))
        return seq if apart is None else F.when(active, seq).otherwise(F.array(apart))

    apart = (None, None) if active is None else (F.lit(-(2**62)).cast("bigint"), F.abs(F.xxhash64(spread)))
    out = df.withColumn("_tx", F.explode(rng("l", "r", apart[0]))).withColumn("_ty", F.explode(rng("t", "b", apart[1])))
    first = (F.col("_tx") == at["l"]) & (F.col("_ty") == at["t"])
    return out.withColumn("_first", first if active is None else first | ~active)


def concat_ordered(pairs: DataFrame, keys: list[str], cell_id: str, text_id: str, strip: bool = True) -> DataFrame:
    """A5 + O2: texts of a cell in ascending ``text_id``, joined with one space."""
    t = py_strip("text") if strip else F.col("text")
    g = pairs.groupBy(*keys, cell_id).agg(F.sort_array(F.collect_list(F.struct(F.col(text_id).alias("i"), t.alias("s")))).alias("_m"))
    return g.select(*keys, cell_id, F.array_join(F.transform("_m", lambda m: m["s"]), " ").alias("text"))


def _tile_join_group(
    cells: DataFrame,
    texts: DataFrame,
    keys: list[str],
    overlap: float,
    tile: float | None,
    cell_id: str,
    text_id: str,
    strip: bool,
    active: Column | None = None,
) -> DataFrame:
    """Every cell once, with ``_m``: its qualifying texts as sorted ``(text_id, text)`` structs.

    Cell tiles are left-joined to text tiles and grouped by cell, so ``cells``
    is read once and cells without texts survive; the first tile row of a cell
    carries its other columns and stays whether it meets a text or not, other rows
    only with their match. Cells where ``active`` is false meet no text.
    """
    payload = [c for c in cells.columns if c not in keys and c != cell_id]
    rest = [c for c in payload if c not in "ltrb"]
    c = cells.select(
        *keys, cell_id, F.struct(*rest).alias("_rest") if rest else F.lit(None).alias("_rest"), *[F.col(e).alias("c_" + e) for e in "ltrb"],
        F.lit(True).alias("_active") if active is None else F.coalesce(active, F.lit(False)).alias("_active"),
    )
    x = texts.select(*keys, text_id, "text", *[F.col(e).cast("double").alias("x_" + e) for e in "ltrb"])
    x = x.filter((F.col("x_r") - F.col("x_l")) * (F.col("x_b") - F.col("x_t")) > 0)  # zero area never matches
    x = x.withColumnsRenamed({k: f"_x{i}" for i, k in enumerate(keys)})
    meet = [F.col(k) == F.col(f"_x{i}") for i, k in enumerate(keys)]
    if tile:
        c = _tiles(c, tile, "c_", F.col("_active"), F.struct(cell_id))
        c = c.withColumn("_rest", F.when(F.col("_first"), F.col("_rest"))).drop("_active")
        x = _tiles(x, tile, "x_").drop("_first")
        t = F.lit(float(tile))
        x = x.withColumnsRenamed({"_tx": "_xx", "_ty": "_xy"})
        meet += [F.col("_tx") == F.col("_xx"), F.col("_ty") == F.col("_xy")]
        corner = {e: F.greatest(*[F.col(p + e).cast("double") for p in ("c_", "x_")]) for e in "lt"}
        own_tile = (F.col("_tx") == F.floor(corner["l"] / t)) & (F.col("_ty") == F.floor(corner["t"] / t))
    else:
        c = c.withColumn("_first", F.lit(True))
        own_tile = F.col("_active")
    cl, ct, cr, cb, xl, xt, xr, xb = (F.col(n).cast("double") for n in ["c_l", "c_t", "c_r", "c_b", "x_l", "x_t", "x_r", "x_b"])
    hits = (cl < xr) & (xl < cr) & (ct < xb) & (xt < cb)
    iw = F.least(cr, xr) - F.greatest(cl, xl)
    ih = F.least(cb, xb) - F.greatest(ct, xt)
    ok = hits & own_tile & ((iw * ih) / ((xr - xl) * (xb - xt)) > F.lit(float(overlap)))
    hit = F.col("_x0").isNotNull()  # a key that met another
    j = c.join(x, [*meet, ok], "left").filter(F.col("_first") | hit)
    txt = py_strip("text") if strip else F.col("text")
    piece = F.when(hit, F.struct(F.col(text_id).alias("i"), txt.alias("s")))
    whole = F.when(F.col("_first"), F.struct(*[F.col("c_" + p if p in "ltrb" else "_rest." + p).alias(p) for p in payload]))
    g = j.groupBy(*keys, cell_id).agg(F.first(whole, ignorenulls=True).alias("_payload"), F.sort_array(F.collect_list(piece)).alias("_m"))
    return g.select(*keys, cell_id, *[F.col("_payload." + p).alias(p) for p in payload], "_m")


def _joined(m: str = "_m") -> Column:
    return F.array_join(F.transform(m, lambda x: x["s"]), " ")


def match_texts(
    cells: DataFrame,
    texts: DataFrame,
    key: str | Sequence[str] = "image_id",
    overlap: float = DEFAULT_OVERLAP,
    tile: float | None = DEFAULT_TILE,
    cell_id: str = "det_idx",
    text_id: str = "text_idx",
) -> DataFrame:
    """J3 + A5: every cell with its matched ``text`` (``""`` when none), in one pass over ``cells``."""
    keys = _keys(key)
    base = cells.drop("text") if "text" in cells.columns else cells
    g = _tile_join_group(base, texts, keys, overlap, tile, cell_id, text_id, strip=True)
    return g.withColumn("text", _joined()).drop("_m")


def match_text_one(texts: DataFrame, box: tuple[float, float, float, float], overlap: float = DEFAULT_OVERLAP,
                   key: str | Sequence[str] = "image_id", text_id: str = "text_idx") -> DataFrame:
    """The single-box form: one literal box as a filter, no join. One row per key with matches."""
    keys = _keys(key)
    bl, bt, br, bb = (F.lit(float(v)) for v in box)
    xl, xt, xr, xb = (F.col(e).cast("double") for e in "ltrb")
    area = (xr - xl) * (xb - xt)
    iw = F.least(br, xr) - F.greatest(bl, xl)
    ih = F.least(bb, xb) - F.greatest(bt, xt)
    hit = (area > 0) & (bl < xr) & (xl < br) & (bt < xb) & (xt < bb) & ((iw * ih) / area > F.lit(float(overlap)))
    return concat_ordered(texts.filter(hit).withColumn("_cell", F.lit(0)), keys, "_cell", text_id).drop("_cell")


def with_fallback_text(
    matched: DataFrame,
    page_words: DataFrame,
    key: str | Sequence[str] = "image_id",
    overlap: float = BACKEND_OVERLAP,
    tile: float | None = DEFAULT_TILE,
    cell_id: str = "det_idx",
    word_id: str = "word_idx",
) -> DataFrame:
    """A cell whose matched text is blank takes the page text under its box.

    The page lookup keeps words covering more than ``overlap`` of their own
    area and joins their raw text with one space in page order. One pass over
    ``matched``: only blank cells are tiled against the words; the others
    pass through with their text.
    """
    keys = _keys(key)
    blank = py_strip("text") == ""
    g = _tile_join_group(matched, page_words, keys, overlap, tile, cell_id, word_id, strip=False, active=blank)
    return g.withColumn("text", F.when(py_strip("text") == "", _joined()).otherwise(F.col("text"))).drop("_m")
