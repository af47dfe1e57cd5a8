"""Attestation digests: canonical JSON and SHA-256."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv

ISO = "yyyy-MM-dd'T'HH:mm:ss"


def normal_labels(labels: Column) -> Column:
    """Trimmed, without blanks, distinct, sorted."""
    trimmed = F.transform(F.coalesce(labels, F.array().cast("array<string>")), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(trimmed, lambda x: x != "")))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _iso(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType.simpleString()
    value = F.date_format(c, ISO) if kind.startswith("timestamp") else F.col(c).cast("string")
    return F.coalesce(value, F.lit(""))


def payload_json(df: DataFrame, note: Column | None = None, actor: dict[str, Column] | None = None,
                 schema: str = fv.ATTESTATION_SCHEMA) -> Column:
    """Canonical payload: keys in sorted order, no spaces, nothing left out."""
    actor = actor or {}
    actor_part = F.struct(*[actor.get(k, F.lit("")).alias(k) for k in ("email", "name", "sub")])
    card = F.struct(
        _text("description").alias("description"), _text("id").alias("id"), _text("job_id").alias("job_id"),
        normal_labels(F.col("labels")).alias("labels"), _text("priority").alias("priority"),
        _text("scenario_id").alias("scenario_id"), _text("session_id").alias("session_id"),
        _text("status").alias("status"), _text("title").alias("title"),
        _iso(df, "updated_at").alias("updated_at"))
    return F.to_json(F.struct(
        actor_part.alias("actor"), (note if note is not None else F.lit("")).alias("attestation_note"),
        _iso(df, "attested_at").alias("attested_at"), _text("attested_by").alias("attested_by"),
        card.alias("card"), F.lit(schema).alias("schema")))


def attestation_digest(cards: DataFrame, **kwargs) -> DataFrame:
    """Cards with ``payload`` and its SHA-256 ``payload_hash``."""
    return (cards.withColumn("payload", payload_json(cards, **kwargs))
            .withColumn("payload_hash", F.sha2("payload", 256)))


def attestation_check(cards: DataFrame, stored_hash: str, **kwargs) -> DataFrame:
    """Recompute and compare: ``intact`` is false when a card changed since it was attested."""
    return (attestation_digest(cards, **kwargs)
            .withColumn("intact", F.coalesce(F.col("payload_hash") == F.col(stored_hash), F.lit(False))))
