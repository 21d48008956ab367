"""Table classification results.

Scores are ``ARRAY<FLOAT>`` per image; arg-max, softmax and labels are
higher-order expressions, so classification adds no exchange of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.functions import labels as L
from gridweave.functions.scores import argmax, max_score, softmax


def classify(scores: DataFrame, col: str = "scores", probabilities: bool = False) -> DataFrame:
    """A1: ``class_id`` = first arg-max, ``score`` = its value (after A2 when ``probabilities``)."""
    s = softmax(col) if probabilities else F.col(col)
    return scores.withColumn("_s", s).withColumn("class_id", argmax("_s")).withColumn(
        "score", max_score("_s")
    ).drop("_s")


def with_table_label(df: DataFrame, class_id: str = "class_id") -> DataFrame:
    """``label`` (wired / wireless)."""
    return df.withColumn("label", L.table_class_label(class_id))


def class_histogram(classified: DataFrame) -> DataFrame:
    """Images per class and mean score (the classification log as a table)."""
    return classified.groupBy("class_id").agg(
        F.count(F.lit(1)).alias("n_images"), F.avg(F.col("score").cast("double")).alias("mean_score")
    )


def class_ordinal(
    classified: DataFrame, model_idx: str = "model_idx", key: str = "image_id", bucket_width: int = 1 << 16
) -> DataFrame:
    """0-based ordinal of an image within its class, in key order.

    A window over the class alone would put every image of a class into one
    task. Instead keys are cut into ranges of ``bucket_width`` ids (so a
    bucket holds at most that many images): a small table of counts per
    ``(class, bucket)`` gives each bucket its offset by a prefix sum, and the
    rank inside a bucket is a bounded window.
    """
    from gridweave.operators.ranking import bucketed_row_number

    bucket = F.floor(F.col(key) / F.lit(bucket_width)).cast("bigint")
    return bucketed_row_number(classified, [model_idx], [F.col(key)], bucket, "ordinal")
