"""Operator 11: sources mixed to target weights by Sainte-Laguë apportionment.

Every source has a target in words. The mix is a row of blocks of
``block_words`` words, and the next block always goes to the source with the
highest quotient ``target / (2 * blocks so far + 1)`` (ties: the source that
comes first). ``shard_blocks`` consecutive blocks are a shard, so that every
shard has an integer quota of blocks of each source, and the shards together
keep the targets at any length of the mix.

The blocks are never made one by one. After ``m`` blocks a source has, but for
the last few, ``round(target * m / all targets)``: with ``s`` sources the row
of divisors that gives ``m - s / 2`` is below ``m`` blocks in all and the one
for ``m + s / 2`` above it, so ranking the quotients between the two (about
four for each source) gives the exact count at every shard's end.

Which blocks a source gives follows a seed: its documents stand in the order
of a keyed digest, their words one behind the other are its stream, block
``b`` is words ``b * block_words`` onwards, and a shard takes its quota from
where the last shard stopped. A source that must give more than it has starts
over. Places in a stream are prefix sums in two levels (a digest's first digits, then inside
them), so that a source with a third of all rows is spread over thousands of
groups. DataFrame functions only.

A null text has no words, a null source is a source of its own, behind all
others; a null id is an ordinary value. Rows equal in id and text are rows of
their own and follow each other. An empty table, or one without a word, gives
zero targets and no quotas. The table of sources (one row each) is ordered in
one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2  # sources' weights in turn; words of the mix to those there are; times a source may be used
BLOCK_WORDS, SHARD_BLOCKS, CELL_DIGITS = 16, 1 << 20, 3
SOURCE = ["src", "no_src"]  # a source's name, and whether it is null


def measured(docs: DataFrame, seed: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, src, no_src, size, digest`` of every row: its words, and where the seed puts it."""
    text, ident = F.col(text_col).cast("string"), F.col(id_col)
    return docs.select(
        ident.alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src"), F.col(source_col).isNull().alias("no_src"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), ident.cast("string"), text)).alias("digest"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``src, no_src, place, source_size, weight, target`` from rows with ``src, no_src, size``.

    Sources share ``share`` times all words by weight, none above ``most``
    times its own. In the order of ``most * size / weight`` the full ones come
    first, and the others share by weight what those leave.
    """
    found = sizes.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"))
    found = found.withColumn("place", F.row_number().over(Window.orderBy("no_src", "src")))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int") + 1)
    found = found.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    behind, every = by_room.rowsBetween(0, Window.unboundedFollowing), by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spare = F.sum("source_size").over(every) * F.lit(float(share)) - F.sum("cap").over(every) + F.sum("cap").over(behind)
    found = found.withColumn("level", spare / F.sum("weight").over(behind))
    level = F.first(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")), ignorenulls=True).over(every)
    target = F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("weight"), F.col("cap")))
    return found.select(*SOURCE, "place", "source_size", "weight", target.alias("target"))


def quotas(sources: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """``shard, src, no_src, before, quota``: blocks of each source before a shard and in it, by highest quotients."""
    live = sources.filter("target > 0")
    every = Window.partitionBy()
    live = live.withColumn("words", F.sum("target").over(every)).withColumn("half", F.count("*").over(every) / 2)
    live = live.withColumn("blocks", F.floor(F.col("words") / block_words + 0.5))
    ends = live.withColumn("shard", F.explode(F.expr(f"filter(sequence(0L, blocks div {shard_blocks}), k -> k * {shard_blocks} < blocks)")))
    ends = ends.withColumn("house", F.least((F.col("shard") + 1) * shard_blocks, F.col("blocks")))

    def near(house: Column) -> Column:
        return F.floor(F.col("target") * house / F.col("words") + 0.5)

    ends = ends.withColumn("sure", F.greatest(F.lit(0), near(F.col("house") - F.col("half")) - 1))
    tried = ends.withColumn("k", F.explode(F.sequence("sure", near(F.col("house") + F.col("half")) + 1)))
    one_shard = Window.partitionBy("shard")
    first = F.col("k") == F.col("sure")  # a source's first quotient stands for the blocks that are sure
    free = F.col("house") - F.sum(F.when(first, F.col("sure"))).over(one_shard)
    rank = F.row_number().over(one_shard.orderBy((F.col("target") / (2 * F.col("k") + 1)).desc(), "place"))
    won = tried.withColumn("won", (rank <= free).cast("bigint"))
    at_end = won.groupBy("shard", *SOURCE).agg((F.first("sure") + F.sum("won")).alias("n"))
    both = at_end.select(F.explode(F.array(F.struct("shard", F.lit(0).alias("b"), F.col("n")), F.struct((F.col("shard") + 1).alias("shard"), F.col("n").alias("b"), F.lit(0).alias("n")))).alias("x"), *SOURCE)
    met = both.groupBy("x.shard", *SOURCE).agg(F.sum("x.b").alias("before"), F.sum("x.n").alias("n"))
    return met.filter("n > 0").select("shard", *SOURCE, "before", (F.col("n") - F.col("before")).alias("quota"))


def streams(sizes: DataFrame) -> DataFrame:
    """``doc_id, src, no_src, size, start``: where each row's words begin in its source's stream."""
    cell = F.substring("digest", 1, CELL_DIGITS)
    line = Window.partitionBy(*SOURCE).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = sizes.groupBy(*SOURCE, cell.alias("cell")).agg(F.sum("size").alias("held"))
    cells = cells.select(*SOURCE, "cell", F.coalesce(F.sum("held").over(line), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*SOURCE, "cell").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = sizes.withColumn("cell", cell).join(cells, [*SOURCE, "cell"])
    return placed.select("doc_id", *SOURCE, "size", (F.col("base") + F.sum("size").over(inside) - F.col("size")).alias("start"))


def _source(back: str) -> Column:
    return F.when(~F.col("no_src"), F.col("src")).alias(back)


class Mixture:
    """A planned mix of ``docs``: ``sources`` (targets), ``quotas`` by shard, ``rows`` (places in the streams)."""

    def __init__(
        self, docs: DataFrame, seed: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS,
    ):
        sizes = stage(measured(docs, seed, id_col, text_col, source_col), "sizes")
        self.most, self.block_words = most, block_words
        self.sources = stage(targets(sizes, weights, share, most), "sources")
        self.quotas = stage(quotas(self.sources, block_words, shard_blocks), "quotas")
        self.rows = streams(sizes)

    def documents(self) -> DataFrame:
        """``doc_id, source, size, source_size, target, taken`` of every row: the words that all shards take of it."""
        given = self.quotas.groupBy(*SOURCE).agg(F.sum("quota").alias("blocks"))
        words = F.least(F.coalesce("blocks", F.lit(0)) * self.block_words, F.col("source_size") * self.most)
        size = F.greatest("source_size", F.lit(1))
        plan = self.sources.join(given, SOURCE, "left").select(
            *SOURCE, "source_size", "target", F.floor(words / size).alias("rounds"), F.pmod(words, size).alias("rest")
        )
        taken = F.col("rounds") * F.col("size") + F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("start")))
        return self.rows.join(plan, SOURCE).select(
            "doc_id", _source("source"), "size", "source_size", "target", taken.cast("bigint").alias("taken")
        )

    def pieces(self) -> DataFrame:
        """``shard, source, doc_id, round, first_word, n_words``: what each shard takes from which row, in no order.

        Rows and shards meet on stretches of a stream about as wide as a
        shard's quota, so a source of any size is dealt out by its stream.
        """
        sizes = self.sources.select(*SOURCE, "source_size")
        spans = self.quotas.filter("quota > 0").join(sizes, SOURCE)
        room = F.col("source_size") * self.most
        spans = spans.select(
            "shard", *SOURCE, F.least(F.col("before") * self.block_words, room).alias("a"),
            F.least((F.col("before") + F.col("quota")) * self.block_words, room).alias("z"),
        )
        wide = spans.groupBy(*SOURCE).agg(F.max(F.col("z") - F.col("a")).alias("width"), F.max("z").alias("end")).join(sizes, SOURCE)
        spans = spans.join(wide.select(*SOURCE, "width"), SOURCE).filter("z > a")
        spans = spans.withColumn("stretch", F.explode(F.expr("sequence(a div width, (z - 1) div width)")))
        rows = self.rows.filter("size > 0").join(wide, SOURCE).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(self.most - 1))))
        rows = rows.withColumn("from", F.col("start") + F.col("round") * F.col("source_size")).filter("from < end")
        rows = rows.withColumn("stretch", F.explode(F.expr("sequence(from div width, (from + size - 1) div width)")))
        met = rows.drop("width", "end").join(spans.drop("width"), [*SOURCE, "stretch"])
        a, z = F.greatest("from", "a"), F.least(F.col("from") + F.col("size"), F.col("z"))
        met = met.withColumn("lo", a).withColumn("hi", z).filter("hi > lo")
        once = met.join(wide.select(*SOURCE, "width"), SOURCE).filter("lo div width = stretch")  # where the piece begins
        return once.select(
            "shard", _source("source"), "doc_id", "round", (F.col("lo") - F.col("from")).alias("first_word"), (F.col("hi") - F.col("lo")).alias("n_words")
        )


def mix(docs: DataFrame, seed: int, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row of ``docs``."""
    return Mixture(docs, seed, **options).documents().drop("source")
