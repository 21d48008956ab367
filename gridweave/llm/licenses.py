"""Operator 6: license scans by diagonal voting, in DataFrame operations only.

Templates are short license texts as word lists. Every pair of neighbouring
words of a text is joined, by its hash, with the places of that pair in the
templates; a hit at word ``p`` of the text and ``q`` of a template votes for
the diagonal ``p - q``. Votes are counted by text, template and diagonal. A
base phrase stands where a diagonal has a vote for each of its pairs, and the
words of the pairs are compared besides their hashes, so places are exact.
For the longer templates neighbouring diagonals (up to ``SLACK`` words apart)
are merged, so that an inserted or dropped word does not split a hit, and the
span is verified by the share of the template's pairs that it holds.

The templates are a fixed list of a few hundred rows, which Spark may
broadcast; texts are not shuffled, only votes are.

Null and empty texts have no words. Repeated rows give one result row each.
A text without a place has null ``first_word`` and ``last_word`` and empty
labels. Very long texts stay whole; a word pair that is very common in the
corpus meets at most the few template places it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import text_key, text_rows

# Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Sentences by which a license is known, in words.
SENTENCES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "lgpl": "you can redistribute it and or modify it under the terms of the gnu lesser general public license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl": "this source code form is subject to the terms of the mozilla public license",
    "cc-by": "licensed under a creative commons attribution 4 0 international license",
    "public-domain": "this is free and unencumbered software released into the public domain",
    "all-rights-reserved": "copyright all rights reserved",
}
SLACK, ENOUGH = 3, 0.6
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words in lower case; what is not a letter, a digit or beyond ASCII stands between them.

    ``lower`` changes letters beyond A-Z too. That makes no word of them equal
    to a template's: only the Kelvin sign turns into an ASCII letter (k), and
    no template has a k.
    """
    return F.array_remove(F.split(F.lower(text), _BETWEEN), "")


def templates(docs: DataFrame) -> DataFrame:
    """``template, label, base, size, at, first, second``: the word pairs of all templates."""
    rows = [
        (t, label, base, len(w) - 1, q, w[q], w[q + 1])
        for t, (label, text, base) in enumerate(
            [(label, phrase, True) for phrase, label in PHRASES.items()] + [(label, s, False) for label, s in SENTENCES.items()]
        )
        for w in [text.split()]
        for q in range(len(w) - 1)
    ]
    return docs.sparkSession.createDataFrame(
        rows, "template int, label string, base boolean, size int, at int, first string, second string"
    ).withColumn("hash", F.xxhash64("first", "second"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, key, label, base, first_word, last_word, coverage`` of every verified span.

    ``first_word`` is where the template begins, ``last_word`` the last word
    that votes for it; ``coverage`` the share of the template's pairs found.
    ``key`` names the text.
    """
    rows = text_rows(docs, id_col, text_col).select("doc_id", text_key(F.col("text")).alias("key"), words(F.col("text")).alias("w"))
    pairs = rows.filter(F.size("w") > 1).select(
        "doc_id", "key", F.posexplode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.size("w")).alias("b"))).alias("p", "x")
    ).select("doc_id", "key", "p", F.col("x.a"), F.col("x.b")).filter(F.col("b").isNotNull())
    t = templates(docs)
    hits = pairs.withColumn("hash", F.xxhash64("a", "b")).join(F.broadcast(t), "hash").filter((F.col("a") == F.col("first")) & (F.col("b") == F.col("second")))
    by = ["doc_id", "key", "template", "label", "base", "size"]
    voted = hits.groupBy(*by, (F.col("p") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("places"), F.max("p").alias("last")
    )  # a set of at most the template's places
    near = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    parted = F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(near) > SLACK)  # a phrase stands on one diagonal
    runs = voted.withColumn("parted", F.coalesce(parted, F.lit(False)).cast("int")).withColumn("run", F.sum("parted").over(near))
    merged = runs.groupBy(*by, "run").agg(
        F.min("diagonal").alias("first"), F.max("last").alias("last"), F.array_distinct(F.flatten(F.collect_set("places"))).alias("places")
    )  # at most SLACK + 1 diagonals a word of the span, and a set of places each
    share = F.size("places") / F.col("size")
    return merged.filter(share >= F.when(F.col("base"), 1.0).otherwise(ENOUGH)).select(
        "doc_id", "key", "label", "base", F.greatest("first", F.lit(0)).alias("first_word"), (F.col("last") + 1).alias("last_word"), share.alias("coverage")
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every row.

    ``first_word`` and ``last_word`` are the smallest and largest start of a
    base phrase; ``score`` the largest coverage of a span.
    """
    distinct = spans(docs, id_col, text_col).distinct()  # repeated rows bring the same spans
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    base = F.col("base")
    found = distinct.groupBy("doc_id", "key").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first_word"))).cast("bigint").alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).cast("bigint").alias("last_word"), listed(F.when(base, F.col("label"))).alias("base_labels"),
        listed("label").alias("labels"), F.max("coverage").alias("score"),
    ).withColumnsRenamed({"doc_id": "of", "key": "of_key"})
    rows = text_rows(docs, id_col, text_col).select(
        "doc_id", text_key(F.col("text")).alias("key"), F.size(words(F.col("text"))).cast("bigint").alias("n_words")
    )
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
