"""Filters and counts over record tables.  Predicates and keys are Columns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions.columns import require
from ..functions.when import as_moment, in_window, ntz
from ..plans.sizing import small_side
from ..plans.unnest import explode_rows


def all_or(value: str | None) -> bool:
    """True when a filter value means "no filter"."""
    return not value or value.lower() == "all"


def domain_counts(df: DataFrame, column: Column, domain: list[str], name: str) -> DataFrame:
    """Rows per domain value, zeros kept, in domain order; strangers are dropped.

    One aggregate with a conditional count per value: a map-side combine, no join.
    """
    low = F.lower(column)
    one = df.agg(*[F.count_if(low == v).alias(f"n{i}") for i, v in enumerate(domain)])
    rows = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(v).alias(name), F.col(f"n{i}").alias("n"))
                     for i, v in enumerate(domain)])
    return one.select(F.inline(rows))


def filter_audit(audit: DataFrame, severity: str | None = None, text: str | None = None,
                 window: str = "all", resource_type: str | None = None, resource_id: str | None = None,
                 as_of: datetime | str | None = None) -> DataFrame:
    out = audit
    if not all_or(severity):
        out = out.where(F.lower("severity") == severity.lower())
    if text:
        needle = text.lower()
        out = out.where(F.lower(F.coalesce("action", F.lit(""))).contains(needle)
                        | F.lower(F.coalesce("details", F.lit(""))).contains(needle))
    if not all_or(window):
        if as_of is None:
            raise ValueError("a time window needs as_of")
        out = out.where(in_window(F.col("timestamp"), window, as_of))
    if not all_or(resource_type):
        out = out.where(F.col("resource_type") == resource_type)
    if resource_id:
        out = out.where(F.col("resource_id") == resource_id)
    return out


def count_by_severity(audit: DataFrame) -> DataFrame:
    return domain_counts(audit, F.col("severity"), fv.SEVERITIES, "severity")


def appointments_by_status(appts: DataFrame, status: str | None) -> DataFrame:
    return appts if all_or(status) else appts.where(F.lower("status") == status.lower())


def appointments_between(appts: DataFrame, start: datetime | str | None = None,
                         end: datetime | str | None = None) -> DataFrame:
    """Closed range, either end may be open; appointments without a time are left out."""
    out = appts.where(F.col("scheduled_for").isNotNull())
    if start is not None:
        out = out.where(F.col("scheduled_for") >= ntz(as_moment(start)))
    if end is not None:
        out = out.where(F.col("scheduled_for") <= ntz(as_moment(end)))
    return out


def scheduled_appointments(appts: DataFrame) -> DataFrame:
    return appointments_by_status(appts, "scheduled")


def cards_by_priority(cards: DataFrame, priority: str | None) -> DataFrame:
    return cards if all_or(priority) else cards.where(F.lower("priority") == priority.lower())


def count_by_priority(cards: DataFrame) -> DataFrame:
    return domain_counts(cards, F.col("priority"), fv.PRIORITIES, "priority")


def cards_with_status(cards: DataFrame, status: str | None) -> DataFrame:
    """Cards of one status; an unknown status is an error."""
    return cards if all_or(status) else cards.where(
        F.col("status") == require(status, fv.CARD_STATUSES, "card status"))


def attested_cards(cards: DataFrame) -> DataFrame:
    return cards.where(F.coalesce("attested", F.lit(False)))


def sessions_in_window(sessions: DataFrame, window: str, as_of: datetime | str) -> DataFrame:
    return sessions.where(in_window(F.col("created_at"), window, as_of))


def sessions_with_entities(sessions: DataFrame, types: list[str]) -> DataFrame:
    """Sessions that have any of the types; an empty list keeps all."""
    if not types:
        return sessions
    wanted = F.array(*[F.lit(t) for t in types])
    return sessions.where(F.coalesce(F.arrays_overlap(F.map_keys("entity_counts"), wanted), F.lit(False)))


def sessions_with_listed_entities(sessions: DataFrame, types: DataFrame, key: str = "id") -> DataFrame:
    """The same for a long type table: the keys that qualify, then a left-semi join."""
    keys = (explode_rows(sessions, [key], F.map_keys("entity_counts"), "entity_type")
            .join(small_side(types.select("entity_type").distinct()), "entity_type", "left_semi")
            .select(key).distinct())
    return sessions.join(keys, key, "left_semi")


def count_by_operator(sessions: DataFrame) -> DataFrame:
    op = F.coalesce(F.nullif(F.trim("operator"), F.lit("")), F.lit("replace"))
    return sessions.groupBy(op.alias("operator")).agg(F.count(F.lit(1)).alias("n"))


def filter_by(df: DataFrame, predicate: Column) -> DataFrame:
    return df.where(predicate)


def count_by(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def group_by(df: DataFrame, key: Column, member: str, name: str = "key", chunk_rows: int = 10_000) -> DataFrame:
    """Members per key as arrays of bounded size; ``member`` is a unique id.

    A key with many rows comes back as several rows (key, part, members), so no
    task ever holds a whole hot group.  Members are spread over the parts by hash
    and sorted inside a part; all parts together are the group.
    """
    sized = df.select(key.alias(name), F.col(member).alias("_m"))
    counts = sized.groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
    parts = counts.select(name, F.ceil(F.col("_n") / F.lit(chunk_rows)).cast("int").alias("_parts"))
    hot = parts.where("_parts > 1").withColumnRenamed(name, "_k")
    joined = sized.join(small_side(hot), F.col(name).eqNullSafe(F.col("_k")), "left").select(
        name, "_m", F.coalesce("_parts", F.lit(1)).alias("n_parts"))
    part = F.pmod(F.xxhash64("_m"), F.col("n_parts")).cast("int")
    return (joined.groupBy(name, part.alias("part"), "n_parts")
            .agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("_m")).alias("members")))
