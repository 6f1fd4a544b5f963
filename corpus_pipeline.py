"""From documents to packed training sequences, in five stages.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet in the
shared folder and read again as the next stage's documents.

    language_id   documents whose language the model rejects go
    near_dedup    one document of each group of near copies stays
    secrets       secrets are masked in the text; no document goes
    mixing        a document appears as often as the mix takes it; whole words of a source near its target
    packing       the documents, tokenised, in sequences of 2048

Nulls, empty texts and repeated rows are handled as the operators say. Packing returns pieces; all
other stages return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profila.llm import langid, mixing, neardup, packing, secrets
from profila.llm.common import settled, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

# Models and hashes of the stages have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
