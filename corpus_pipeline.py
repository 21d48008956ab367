"""The training-text pipeline: five stages over ``documents``, each calling one operator.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``.

1. ``toxicity``: documents that the factorization machine rejects go.
2. ``near_duplicates``: of every group of linked documents one stays, the one
   with the smallest id.
3. ``decontamination``: documents that hold a benchmark passage go.
4. ``personal_data``: personal data and terms that reveal it are masked.
5. ``bpe``: every text is encoded and decoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm.common import stage
from gridweave.llm.queries import TOKENIZER


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from gridweave.llm.toxicity import drop_toxic, fit

    return drop_toxic(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from gridweave.llm.near_dup import drop_near_duplicates

    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from gridweave.llm.decontaminate import drop_contaminated

    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from gridweave.llm.pii import sanitise

    clean = sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from gridweave.llm.bpe_tree import encode_texts

    return encode_texts(docs, TOKENIZER)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("bpe", bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over ``documents``; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # models, sketches and the tokenizer are beyond SQL; tests/llm has the brute-force version
