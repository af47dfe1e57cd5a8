"""The registered queries of this package, each over its whole table, with production parameters."""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import (alignment, ann, bpe, fingerprints, jaccard_join, license_scan, line_dedup, packing, phrase_dedup, spelling, sql,
               token_files, toxicity, url_filter)
from .common import documents


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _digests(ids: pa.Array, digest) -> list:
    """Of each list's numbers as little-endian 32-bit bytes."""
    ends = [4 * e for e in ids.offsets.to_pylist()]
    raw = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<i4").tobytes())
    return [digest(raw[a:b]) for a, b in zip(ends[:-1], ends[1:])]


def ids_crc32(ids: str) -> Column:
    return F.arrow_udf(lambda a: pa.array(_digests(a, zlib.crc32), pa.int64()), "long")(F.col(ids))


def ids_sha256(ids: str) -> Column:
    return F.arrow_udf(lambda a: pa.array(_digests(a, lambda raw: hashlib.sha256(raw).hexdigest()), pa.string()),
                       "string")(F.col(ids))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_and_compare(documents(spark, sf_dir)).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        "near_edited", "near_next")


URL_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"),
             ("com/de/", "block"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    judged = url_filter.judge_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), outcomes, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("rate", 6).alias("rate"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = toxicity.score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir)).select(
        "doc_id", F.array_join("licenses", ",").alias("licenses"), "n_templates", "containment")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.expr("vec_id % 20 = 0"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(documents(spark, sf_dir), tokenizer_path())
    return packed.select("doc_id", "start", "length", ids_crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_documents(documents(spark, sf_dir), tokenizer_path())
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_sha256("ids").alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return phrase_dedup.remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, sf_dir))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(documents(spark, sf_dir))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write_tokens(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
    return token_files.read_documents(spark, folder, raw=True).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def _groups_sha256(aligned: alignment.Aligned) -> list[str]:
    return [hashlib.sha256(s).hexdigest() if s else "" for s in alignment.group_strings(aligned)]


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.score_links(documents(spark, sf_dir), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"),
                                 {"groups_sha256": ("string", _groups_sha256)})


def queries() -> dict:
    return {"op1_fingerprints": op1_fingerprints, "op2_url_filter": op2_url_filter, "op3_toxicity": op3_toxicity,
            "op4_license_scan": op4_license_scan,
            "op5_line_dedup": op5_line_dedup, "op6_ann": op6_ann,
            "op7_packing": op7_packing, "op8_bpe": op8_bpe,
            "op9_substring_dedup": op9_substring_dedup, "op10_jaccard_join": op10_jaccard_join,
            "op11_spelling": op11_spelling, "op12_token_files": op12_token_files, "op13_alignment": op13_alignment}


def statements() -> dict:
    return {"op2_url_filter": sql.URL_FILTER, "op4_license_scan": sql.license_scan(license_scan.TEMPLATES),
            "op5_line_dedup": sql.LINE_DEDUP,
            "op9_substring_dedup": sql.SUBSTRING_DEDUP, "op10_jaccard_join": sql.JACCARD_JOIN}
