"""The registered queries of the operators: thin calls over the driver tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER, PIECE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TRAINING_KEY = 20_240_229
MIXTURE_SEED, WHITENING_SEED = 41, 12


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridweave.llm.bpe_tree import encode_texts

    return encode_texts(_table(spark, sf_dir, "documents"), TOKENIZER, digest=True)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridweave.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridweave.llm.pii import find

    return find(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridweave.llm.token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), TOKENIZER)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridweave.llm.suffix_dedup import repeated_spans

    return repeated_spans(_table(spark, sf_dir, "documents")).drop("kept").withColumn("has_repeat", F.col("n_removed") > 0)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridweave.llm.licenses import scan

    return scan(_table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridweave.llm.near_dup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridweave.llm.ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridweave.llm.toxicity import fit, scored

    docs = _table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridweave.llm.training_order import training_order

    return training_order(_table(spark, sf_dir, "documents"), TOKENIZER, TRAINING_KEY, pad_id=49407)


def op11_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridweave.llm.mixture import mix

    return mix(_table(spark, sf_dir, "documents"), MIXTURE_SEED)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridweave.llm.whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"), WHITENING_SEED)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridweave.llm.alignment import align

    return align(_table(spark, sf_dir, "documents"), BYTE_TOKENIZER, PIECE_TOKENIZER)


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_decontamination": op2_decontamination,
    "op3_pii": op3_pii,
    "op4_token_counts": op4_token_counts,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_licenses": op6_licenses,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_nearest": op8_nearest,
    "op9_toxicity": op9_toxicity,
    "op10_training_order": op10_training_order,
    "op11_mixture": op11_mixture,
    "op12_whitening": op12_whitening,
    "op13_alignment": op13_alignment,
}

# The mix from its definition: every quotient of every source is made and the highest are kept.
_MIXTURE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat_ws(':', '{seed}', doc_id::VARCHAR, text)) AS digest
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, [3, 1, 2][((place - 1) % 3 + 1)::INT] AS weight, 2 * source_size AS cap,
         sum(source_size) OVER () AS words FROM sources
), levels AS (
  SELECT *, (words * 1.5::DOUBLE - sum(cap) OVER () + sum(cap) OVER behind) / sum(weight) OVER behind AS level
  FROM weighed
  WINDOW behind AS (ORDER BY cap::DOUBLE / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), found AS (
  SELECT *, least(cap::DOUBLE, coalesce((SELECT level FROM levels l WHERE l.level * l.weight <= l.cap
                                 ORDER BY l.cap::DOUBLE / l.weight, l.place LIMIT 1) * weight, cap)) AS target
  FROM levels
), quotients AS (
  SELECT source, place, target / (2 * k + 1) AS quotient
  FROM (SELECT source, place, target, unnest(range(0, (target / {block} + 100)::BIGINT)) AS k FROM found WHERE target > 0)
), given AS (
  SELECT source, count(*) AS blocks
  FROM (SELECT source, row_number() OVER (ORDER BY quotient DESC, place) AS n FROM quotients)
  WHERE n <= (SELECT floor(sum(target) / {block} + 0.5) FROM found)
  GROUP BY source
), placed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY digest, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS start
  FROM sized
), planned AS (
  SELECT f.source, source_size, target, least(coalesce(blocks, 0) * {block}, cap) AS got
  FROM found f LEFT JOIN given g ON f.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, got - start)) + greatest(0, least(size, got - source_size - start)))::BIGINT AS taken
FROM placed p JOIN planned q ON p.source IS NOT DISTINCT FROM q.source
"""
ORACLES: dict[str, str] = {"op11_mixture": _MIXTURE_SQL.format(seed=MIXTURE_SEED, block=16)}
