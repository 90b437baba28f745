"""The corpus pipeline: language ID, near-duplicates, decontamination, personal data, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontaminate, langid, packing, pii, simhash
from skein.llm.common import materialize, release, scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text evidence of a language, or in none of the known ones with confidence, go."""
    model = langid.fit(docs.select("text", F.col("lang").alias("language")))
    return langid.keep_identified(docs, langid.identify(docs, model, declared=F.col("lang"), address=F.col("source")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a ten-word window of a benchmark item go."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers are masked and terms that disclose them generalised; no document goes."""
    return pii.sanitise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language), ("simhash_near_dedup", near_dedup), ("decontamination", decontaminated), ("pii", sanitised), ("packing", packed)]

#: SimHash, masking and tokenisation are beyond SQL; tests/llm holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage written as Parquet and reread; a stage's own tables and its input go once it is written."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with scratch(lambda: held[-1:]):
            docs = materialize(stage(spark, docs, sf_dir), name)
            held.append(docs)
        release(*held[:-1])
    return STAGES[-1][1](spark, docs, sf_dir)
