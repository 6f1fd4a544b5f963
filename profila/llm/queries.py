"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profila.llm import (
    ann, hamming, langid, lexical, licenses, merkle, mixing, neardup, packing, pii, repeats, secrets, tokencount,
)
from profila.llm.common import table
from profila.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def op1_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.train(docs.where(~langid.held_out()).where("doc_id is not null"))
    return langid.identify(docs, model).withColumn("held_out", langid.held_out())


def op3_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"), "vec_id % 50 = 0")


def op4_hamming(spark: SparkSession, folder: str) -> DataFrame:
    codes = table(spark, folder, "embeddings").select("vec_id", hamming.sign_code(F.col("embedding")).alias("code"))
    return hamming.nearest_codes(codes, codes.where("vec_id % 100 = 0"))


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs))
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in secrets.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(secrets.written(base), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"))


def op6_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"), words=2)


def op8_pack(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"))
    return pieces.select(
        "doc_id", "start", F.floor(F.length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, folder, "documents"))


def op10_repeats(spark: SparkSession, folder: str) -> DataFrame:
    left = repeats.without_repeats(table(spark, folder, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_manifest(spark: SparkSession, folder: str) -> DataFrame:
    lowered = F.translate("text", lexical.UPPER, lexical.LOWER)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.audited(table(spark, folder, "documents"), F.when(tampered, lowered).otherwise(F.col("text")))


def op12_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.scan(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in pii.BASE]
    return found.select(
        "doc_id", *counts, F.sha2(pii.written(base), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_language_id": op2_language_id,
    "op3_nearest": op3_nearest,
    "op4_hamming": op4_hamming,
    "op5_secrets": op5_secrets,
    "op6_mix_sources": op6_mix_sources,
    "op7_near_dedup": op7_near_dedup,
    "op8_pack": op8_pack,
    "op9_token_counts": op9_token_counts,
    "op10_repeats": op10_repeats,
    "op11_manifest": op11_manifest,
    "op12_search": op12_search,
    "op13_pii": op13_pii,
}
