"""A corpus from raw documents to packed training sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept.  All but the last
return the columns of documents.  SQL can express neither the network nor the tokenizer, so there is no statement;
the tests hold every stage against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from redactory.llm import jaccard_join, line_dedup, packing, phrase_dedup, queries, toxicity
from redactory.plans.shared import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC = 0.5
# Near-duplicate stages on word shingles: five words, similarity of 0.8.
SHINGLE, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose worst window scores below ``TOXIC`` stay, unchanged."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score_documents(docs.select(*COLUMNS), labels).where(F.col("score") < TOXIC).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, without their repeated lines."""
    lines = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return _resized(lines)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; rows without id stay."""
    found = jaccard_join.jaccard_components(docs, percent=PERCENT, shingle=SHINGLE)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, without passages that an earlier document has; untouched texts keep their white space."""
    kept = phrase_dedup.remove_repeats(docs.select(*COLUMNS))
    return _resized(kept.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences with their ids, and a checksum of each piece."""
    return packing.pack_documents(docs, queries.tokenizer_path()).withColumn("ids_crc32", queries.ids_crc32("ids"))


def _resized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("jaccard_join", drop_near_copies),
          ("substring_dedup", drop_passages), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
