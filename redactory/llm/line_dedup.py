"""Line dedup: lines found in several documents stay only in the document with the largest id.

Explode normalised lines, hash, count distinct documents per hash, drop, reassemble by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.shared import written
from ..plans.unnest import explode_rows
from .common import LOWER, UPPER

MIN_CHARS = 20
MIN_DOCUMENTS = 3
WHITE = " \t\n\x0b\x0c\r"
# Parts of a document's lost lines, so that a line is compared with few of them.
PARTS = 1024


def lines_of(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def line_hash(key: Column) -> Column:
    """128 bits: two different keys do not meet in practice."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(key, F.lit("line")).alias("b"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``docs`` with ``text`` deduplicated and the columns ``n_lines`` and ``n_dropped`` after it.

    A key is counted once per document; a key of at least ``min_chars`` code points found in at
    least ``min_documents`` documents loses all its lines except in the largest doc_id holding it.
    Null or empty text is one empty line, and its text becomes empty.  Rows with a null doc_id keep
    all their lines and count nowhere.  Repeated rows with one doc_id are one document: a key is
    counted once and each row is reassembled by itself.  Other columns are passed on; an empty
    table gives no rows.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # Distinct keys of a document are found in the row, so the shuffle gets each once and
    # partial aggregates take a frequent line down to one row a task.
    # Strings are made distinct, as Spark compares an array's structs all with each other.
    hashes = F.transform(F.array_distinct(
        F.filter(F.transform(lines_of("text"), line_key), lambda k: F.char_length(k) >= min_chars)), line_hash)
    # Both tables are written: the join below then shuffles both sides itself, and Spark may split a frequent key.
    rows = explode_rows(docs.where("doc_id IS NOT NULL"), [F.col("doc_id").cast("long").alias("doc_id")], hashes, "h")
    held = written(rows.select("doc_id", "h.a", "h.b"), "lines")
    repeated = written(held.distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
                       .where(F.col("n") >= min_documents).select("a", "b", "last"), "repeated-lines")
    lost = (held.join(repeated, ["a", "b"]).where("doc_id <> last")
            .groupBy("doc_id", F.pmod("a", F.lit(PARTS)).alias("_part")).agg(F.collect_set(F.struct("a", "b")).alias("_keys"))
            .groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("_part", "_keys"))).alias("_lost"))
            .withColumnRenamed("doc_id", "_id"))
    joined = docs.select(F.struct(*own).alias("_own"), "text", F.col("doc_id").cast("long").alias("_doc")).join(
        lost, F.col("_doc") == F.col("_id"), "left")
    lines = lines_of("text")
    is_lost = lambda h: F.coalesce(F.array_contains(
        F.try_element_at(F.col("_lost"), F.pmod(h["a"], F.lit(PARTS))), h), F.lit(False))
    stays = F.filter(lines, lambda x: ~(
        (F.char_length(x) >= min_chars) & (F.char_length(line_key(x)) >= min_chars) & is_lost(line_hash(line_key(x)))))
    kept = F.when(F.col("_lost").isNull(), lines).otherwise(stays)
    return (joined.withColumn("n_lines", F.size(lines).cast("long")).withColumn("_kept", kept)
            .withColumn("n_dropped", F.col("n_lines") - F.size("_kept"))
            .withColumn("text", F.array_join("_kept", "\n"))
            .select(*[F.col("text") if c == "text" else F.col("_own")[c].alias(c) for c in own], "n_lines", "n_dropped"))

