"""Record tables: current state and audit rows from an append-only change feed.

A feed row is (id, seq, ts, op, payload).  ``put`` carries a whole record,
``patch`` only the named fields (a JSON null clears a field), ``delete`` none.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .. import fixed_values as fv
from ..functions.columns import ordinal, positive
from ..functions.when import as_moment, ntz
from ..plans.salting import lookup_join
from ..plans.shared import written
from ..plans.unnest import explode_map, inline_rows
from ..plans.windows import previous_values
from .filters import cards_with_status, domain_counts
from .job import priority_severity

STATE_BUCKETS = 256  # folders of a snapshot


def _with_fields(feed: DataFrame) -> DataFrame:
    return feed.withColumn("fields", F.from_json("payload", "map<string,string>"))


def _is_unreadable() -> Column:
    return F.col("fields").isNull() & F.coalesce(F.col("op") != "delete", F.lit(True))


def unreadable_changes(feed: DataFrame) -> DataFrame:
    """Feed rows other than deletes whose payload is no JSON object: for quarantine, they change nothing."""
    return _with_fields(feed).where(_is_unreadable()).drop("fields")


def read_feed(feed: DataFrame) -> DataFrame:
    """Readable feed rows with the payload as a map, so that absent and null stay apart."""
    return _with_fields(feed).where(~_is_unreadable()).withColumn(
        "fields", F.coalesce("fields", F.create_map().cast("map<string,string>")))


def current_state(feed: DataFrame, fields: list[str]) -> DataFrame:
    """Last value of each field per live id.

    A put sets every field, so the newest row that sets a field is the answer;
    patches of ids that were never put, and deleted ids, drop out.  One aggregate
    with partial combine: a hot id sends one row per task, not its history.
    """
    return live_records(feed_state(feed, fields), fields)


def feed_state(feed: DataFrame, fields: list[str]) -> DataFrame:
    """What a feed says of each id: the newest put, delete and row, and the newest row that sets each field.

    States of parts of a feed, in any order, overlapping or not, give that of the whole by ``merged_states``.
    """
    rows = read_feed(feed)
    is_put, is_delete = F.col("op") == "put", F.col("op") == "delete"
    aggs = [F.max(F.when(is_put, F.col("seq"))).alias("_put"),
            F.max(F.when(is_delete, F.col("seq"))).alias("_del"),
            F.max(F.when(~is_delete, F.struct("seq", "ts"))).alias("_last")]
    for f in fields:
        sets = is_put | ((F.col("op") == "patch") & F.map_contains_key("fields", F.lit(f)))
        aggs.append(F.max(F.when(sets, F.struct("seq", F.element_at("fields", F.lit(f)).alias("v")))).alias(f"_f_{f}"))
    return rows.groupBy("id").agg(*aggs)


def merged_states(states: DataFrame) -> DataFrame:
    return states.groupBy("id").agg(*[F.max(c).alias(c) for c in states.columns if c != "id"])


def live_records(state: DataFrame, fields: list[str]) -> DataFrame:
    return (state.where(F.col("_put") > F.coalesce("_del", F.lit(-1)))
            .select("id", *[F.col(f"_f_{f}.v").alias(f) for f in fields], F.col("_last.ts").alias("updated_at")))


def apply_changes(path: str, delta: DataFrame, fields: list[str], buckets: int = STATE_BUCKETS) -> None:
    """Merge a part of a feed into the snapshot kept at ``path``, which is made if absent.

    The snapshot is a Parquet table of states in ``buckets`` folders by a hash of the id, a number that stays as it
    was first.  Only folders in which an id has changes are read and written again.  Parts may come late, overlap or
    come again: after a failure, apply the same part once more.  Null ids are one id.  One writer at a time; a reader
    may see some folders before and some after a part.  ``read_snapshot`` gives the state.
    """
    spark = delta.sparkSession
    in_bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
    new = written(feed_state(delta, fields).withColumn("_bucket", in_bucket), "delta")
    changed = [r[0] for r in new.select("_bucket").distinct().collect()]  # ``buckets`` numbers at most
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    if not changed:
        if not exists:  # an empty snapshot, which can be read
            new.drop("_bucket").write.parquet(f"{path}/_bucket=0")
        return
    if exists:
        old = spark.read.schema(new.schema).parquet(path).where(F.col("_bucket").isin(changed))
        new = old.unionByName(new)
    states = written(merged_states(new.drop("_bucket")).withColumn("_bucket", in_bucket), "states")
    (states.repartition("_bucket").write.partitionBy("_bucket").mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").parquet(path))


def read_snapshot(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Current records of a snapshot that ``apply_changes`` keeps; the answer of ``current_state`` over all its parts."""
    return live_records(spark.read.parquet(path), fields)


def upsert(feed: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Last whole row per key."""
    rest = [c for c in feed.columns if c != key]
    return (feed.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r"))
            .select(key, *[F.col(f"_r.{c}").alias(c) for c in rest]))


def status_changes(feed: DataFrame) -> DataFrame:
    """Feed rows with the state just before them: ``prev_status``, ``prev_title``, ``prev_alive``."""
    rows = read_feed(feed)
    has = lambda f: F.map_contains_key("fields", F.lit(f))
    get = lambda f: F.element_at("fields", F.lit(f))
    is_put, is_delete = F.col("op") == "put", F.col("op") == "delete"
    known = rows.select(
        "id", "seq", "ts", "op", "fields",
        F.when(is_put, F.coalesce(get("status"), F.lit("backlog"))).when(is_delete, F.lit(""))
        .when(has("status"), F.coalesce(get("status"), F.lit(""))).alias("status"),
        F.when(is_put, F.coalesce(get("title"), F.lit(""))).when(is_delete, F.lit(""))
        .when(has("title"), F.coalesce(get("title"), F.lit(""))).alias("title"),
        F.when(is_put, F.lit(1)).when(is_delete, F.lit(0)).alias("alive"))
    return previous_values(known, "id", "seq", ["status", "title", "alive"])


def done_times(feed: DataFrame) -> DataFrame:
    """``done_at`` of live cards that are done: supplied, or the time of the last entry into done."""
    ch = status_changes(feed).where(F.col("status").isNotNull())
    live_before = F.coalesce(F.col("prev_alive"), F.lit(0)) == 1
    enters = (F.col("status") == "done") & (
        (F.col("op") == "put") | (live_before & (F.coalesce("prev_status", F.lit("")) != "done")))
    supplied = F.element_at("fields", F.lit("done_at")).try_cast("timestamp_ntz")
    fallback = F.when(F.col("op") == "put", F.coalesce(
        F.element_at("fields", F.lit("updated_at")).try_cast("timestamp_ntz"), F.col("ts"))).otherwise(F.col("ts"))
    per_id = ch.groupBy("id").agg(
        F.max(F.when(F.col("op") == "put", F.col("seq"))).alias("_put"),
        F.max(F.when(F.col("op") == "delete", F.col("seq"))).alias("_del"),
        F.max(F.struct("seq", "status")).alias("_last"),
        F.max(F.when(enters, F.struct("seq", F.coalesce(supplied, fallback).alias("at")))).alias("_done"))
    return (per_id.where(F.col("_put") > F.coalesce("_del", F.lit(-1)))
            .select("id", F.col("_last.status").alias("status"),
                    F.when(F.col("_last.status") == "done", F.col("_done.at")).alias("done_at")))


def _entry(when: Column, action: str, details: Column, severity: str | Column = "info") -> Column:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(when, F.struct(F.lit(action).alias("action"), details.alias("details"), sev.alias("severity")))


def audit_from_feed(feed: DataFrame, kind: str = "card") -> DataFrame:
    """Audit rows implied by a change feed; one pass, each change yields zero to two rows."""
    ch = status_changes(feed)
    get = lambda f, default="": F.coalesce(F.element_at("fields", F.lit(f)), F.lit(default))
    alive = F.coalesce("prev_alive", F.lit(0)) == 1
    is_put = F.col("op") == "put"
    patched = (F.col("op") == "patch") & alive
    deleted = (F.col("op") == "delete") & alive
    title = F.coalesce("title", "prev_title", F.lit(""))
    keys = F.array_join(F.array_sort(F.map_keys("fields")), ", ")
    text = lambda fmt, *a: F.format_string(fmt, *a)
    if kind == "card":
        moved = patched & F.col("status").isNotNull() & (F.col("status") != F.col("prev_status"))
        attested = patched & (F.lower(get("attested")) == "true")
        entries = [
            _entry(is_put, "pipeline.create", text("Created card '%s' in '%s'", title, F.col("status"))),
            _entry(moved, "pipeline.move", text("Moved '%s' from '%s' → '%s'", title, "prev_status", "status")),
            _entry(attested, "compliance.attest", text("Attested by '%s'", get("attested_by"))),
            _entry(deleted, "pipeline.delete", text("Deleted '%s'", F.coalesce("prev_title", F.lit(""))), "warning")]
    elif kind == "session":
        entries = [
            _entry(is_put, "pii.anonymize", text("Anonymized %s entities using '%s'",
                                                 get("entities", "0"), get("operator", "replace"))),
            _entry(patched, "session.update", text("Updated session: %s", keys))]
    elif kind == "appointment":
        entries = [
            _entry(is_put, "schedule.create", text("Scheduled '%s' for %s", title, get("scheduled_for"))),
            _entry(patched, "schedule.update", text("Updated '%s': %s", title, keys)),
            _entry(deleted, "schedule.delete", text("Deleted '%s'", F.coalesce("prev_title", F.lit(""))), "warning")]
    else:
        raise ValueError(f"unknown record kind: {kind}")
    found = F.filter(F.array(*entries), lambda e: e.isNotNull())
    return inline_rows(ch, ["seq", "ts", "id"], found, "action").select(
        "seq", F.col("ts").alias("timestamp"), F.lit("system").alias("actor"), "action",
        F.lit(kind).alias("resource_type"), F.col("id").alias("resource_id"), "details", "severity")


def normal_severity(severity: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(severity, F.lit(""))))
    return F.when(low.isin(fv.SEVERITIES), low).otherwise(F.lit("info"))


def with_severity(df: DataFrame) -> DataFrame:
    """Known severities kept, others "info"; priorities mapped to a severity."""
    out = df
    if "severity" in df.columns:
        out = out.withColumn("severity", normal_severity(F.col("severity")))
    if "priority" in df.columns:
        out = out.withColumn("priority_severity", priority_severity(F.col("priority")))
    return out


def sessions_newest_first(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.col("created_at").desc(), "id")


def cards_latest_first(cards: DataFrame, status: str | None = None) -> DataFrame:
    return cards_with_status(cards, status).orderBy(F.col("updated_at").desc(), "id")


def appointments_by_time(appts: DataFrame) -> DataFrame:
    return appts.orderBy("scheduled_for", "id")


def sessions_of_card(sessions: DataFrame, card_id: str) -> DataFrame:
    return sessions_newest_first(sessions.where(F.col("pipeline_card_id") == card_id))


def sessions_per_card(sessions: DataFrame, cards: DataFrame) -> DataFrame:
    """The same for every card at once; a card that holds many of the sessions is split over several tasks."""
    linked = sessions.select(F.col("pipeline_card_id").alias("card_id"), F.col("id").alias("session_id"), "created_at")
    return lookup_join(linked, cards.select(F.col("id").alias("card_id")), "card_id", "session_id")


def entity_breakdown(sessions: DataFrame) -> DataFrame:
    return (explode_map(sessions, [], "entity_counts", "entity_type", "c")
            .groupBy("entity_type").agg(F.sum("c").alias("n")))


def global_stats(sessions: DataFrame, cards: DataFrame, appts: DataFrame, audit: DataFrame) -> DataFrame:
    """One row of totals; each table is read once and contributes one aggregate row."""
    size = F.aggregate(F.map_values("entity_counts"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    base = sessions.agg(F.count(F.lit(1)).alias("total_sessions"),
                        F.coalesce(F.sum(size), F.lit(0)).alias("total_entities"))
    by_status = [F.count_if(F.col("status") == s).alias(s) for s in fv.CARD_STATUSES]
    c = cards.agg(F.struct(*by_status, F.count_if(F.coalesce("attested", F.lit(False))).alias("attested")))
    count = lambda d: d.agg(F.count(F.lit(1))).scalar()
    wide = base.withColumn("_c", c.scalar())
    return wide.select(
        "total_sessions", "total_entities", *[F.col(f"_c.{s}").alias(f"cards_{s}") for s in fv.CARD_STATUSES],
        count(appts).alias("total_appointments"), count(audit).alias("total_audit_entries"),
        F.col("_c.attested").alias("attested_cards"))


def count_cards_by_status(cards: DataFrame) -> DataFrame:
    """All four buckets, also the empty ones."""
    return domain_counts(cards, F.col("status"), fv.CARD_STATUSES, "status")


def upcoming(appts: DataFrame, as_of: datetime | str, limit: int = 5) -> DataFrame:
    return (appts.where((F.col("status") == "scheduled") & (F.col("scheduled_for") >= ntz(as_moment(as_of))))
            .orderBy("scheduled_for", "id").limit(positive(limit)))


def latest_audit(audit: DataFrame, limit: int = 200) -> DataFrame:
    return audit.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(positive(limit))


RETAINED_SLICES = 4096


def retain_newest(audit: DataFrame, rows: int | None = fv.AUDIT_RETENTION_ROWS, max_bytes: int | None = None,
                  size: Column | None = None) -> DataFrame:
    """Retention caps on the audit table: the newest entries within ``rows`` and ``max_bytes``, in no order.

    ``size`` gives a row's bytes (default: those of its JSON form).  Entries go by time and then id; the first that
    does not fit ends what is kept.  Counts and bytes per day, then per slice of the day on which a cap falls, and
    so on with ever shorter slices, tell where the cut is; the driver gets one row a day or slice.  Only entries of one
    microsecond are ordered by id, their ids taking part as they are.  Rows without a time are the oldest.
    """
    limits = {name: positive(cap) for name, cap in (("n", rows), ("b", max_bytes)) if cap is not None}
    if not limits:
        return audit
    if size is None:
        size = F.octet_length(F.to_json(F.struct(*audit.columns)))
    micros = F.unix_micros(F.col("timestamp").cast("timestamp"))
    sized = audit.select(F.struct(*audit.columns).alias("_row"), micros.alias("_at"),
                         F.coalesce(size, F.lit(0)).cast("long").alias("_size"))
    day = 86_400_000_000

    def cut_in(part: DataFrame, key: Column, spent: dict):
        """The newest first: the key at which a cap falls and what is spent before it, or None."""
        groups = part.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("b")).collect()
        for g in sorted(groups, key=lambda g: (g["k"] is not None, g["k"]), reverse=True):
            after = {c: spent[c] + g[c] for c in limits}
            if any(after[c] > limits[c] for c in limits):
                return g["k"], spent
            spent = after
        return None

    found = cut_in(sized, F.floor(F.col("_at") / day), dict.fromkeys(limits, 0))
    if found is None:
        return audit
    at, spent = found
    if at is None:
        newer, tied = sized.where("_at IS NOT NULL"), sized.where("_at IS NULL")
    else:
        low, high = at * day, (at + 1) * day
        while high - low > 1:
            width = -(-(high - low) // RETAINED_SLICES)
            inside = sized.where((F.col("_at") >= low) & (F.col("_at") < high))
            at, spent = cut_in(inside, F.floor((F.col("_at") - low) / width), spent)
            low, high = low + at * width, min(low + (at + 1) * width, high)
        newer, tied = sized.where(F.col("_at") >= high), sized.where(F.col("_at") == low)
    # Entries of one moment: ranges of ids, each cut by its own sums and those of the ranges after it.
    kept = _newest_ids(tied, {c: limits[c] - spent[c] for c in limits})
    return newer.select("_row").unionByName(kept.select("_row")).select("_row.*")


def _newest_ids(tied: DataFrame, left: dict) -> DataFrame:
    """Rows of one moment by descending id while they fit; sums over slices of a hash order would not be by id, so
    slices are ranges of ids that Spark's range partitioning makes."""
    ranged = tied.repartitionByRange(F.col("_row.id").desc(), "_size").withColumn("_part", F.spark_partition_id())
    totals = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_b"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    before = totals.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
                           F.coalesce(F.sum("_b").over(earlier), F.lit(0)).alias("_b0"))
    within = W.partitionBy("_part").orderBy(F.col("_row.id").desc(), "_size").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = ranged.withColumns({"_n1": F.count(F.lit(1)).over(within), "_b1": F.sum("_size").over(within)}).join(
        F.broadcast(before), "_part")
    fits = [F.col(f"_{c}0") + F.col(f"_{c}1") <= left[c] for c in left]
    return summed.where(fits[0] if len(fits) == 1 else fits[0] & fits[1])


def session_link_violations(cards: DataFrame) -> DataFrame:
    """Sessions that hang on more than one card."""
    return (cards.where(F.coalesce("session_id", F.lit("")) != "").groupBy("session_id")
            .agg(F.count(F.lit(1)).alias("n_cards"), F.min("id").alias("first_card")).where("n_cards > 1"))


def stage_after(status: Column) -> Column:
    return _stage(status, 1)


def stage_before(status: Column) -> Column:
    return _stage(status, -1)


def _stage(status: Column, by: int) -> Column:
    at = ordinal(status, fv.CARD_STATUSES)
    stages = F.array(*[F.lit(s) for s in fv.CARD_STATUSES])
    to = F.least(F.greatest(at + by, F.lit(1)), F.lit(len(fv.CARD_STATUSES)))
    return F.when(at > 0, F.element_at(stages, to))
