"""Table-wide jobs: redaction, accounting, quarantine, progress, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from .. import fixed_values as fv
from ..functions.columns import by_rules, safe_ratio, shortened
from ..functions.expr import let
from ..plans.salting import lookup_join
from ..plans.spread import spread
from ..plans.unnest import explode_rows, inline_rows
from ..policy import Policy
from .detect import spans_sql
from .profile import string_columns
from .resolve import keep_best
from .rewrite import rewrite_sql


class NoTextColumns(ValueError):
    """The table has no column to treat."""


def _checked(df: DataFrame, columns: list[str]) -> list[str]:
    strings = set(string_columns(df))
    wrong = [c for c in columns if c not in strings]
    if wrong:
        raise ValueError(f"not string columns: {', '.join(wrong)}")
    if not columns:
        raise NoTextColumns("no text columns to treat")
    return columns


def deidentify(df: DataFrame, columns: list[str], policy: Policy) -> DataFrame:
    """Redact the chosen string columns; every other column and every row stays.

    A projection: no shuffle, no Python in the tasks.
    """
    columns = _checked(df, columns)
    fast = policy.but(explain=False)

    def rewritten(c: str) -> Column:
        text = f"`{c}`"
        return F.expr(let(spans_sql(text, fast), lambda s: (
            f"IF(size({s}) = 0, {text}, {let(keep_best(s), lambda k: rewrite_sql(text, k, fast))})")))

    return df.withColumns({c: rewritten(c) for c in columns})


def cell_spans(df: DataFrame, columns: list[str], policy: Policy) -> DataFrame:
    """(column, entity_type) of every span in the chosen columns, one row per span."""
    columns = _checked(df, columns)
    fast = policy.but(explain=False)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.expr(
        f"transform({spans_sql(f'`{c}`', fast)}, s -> s.entity_type)").alias("types")) for c in columns])
    listed = inline_rows(spread(df.select(*columns)), [], cells, "column")
    return explode_rows(listed, ["column"], "types", "entity_type")


def column_totals(df: DataFrame, columns: list[str], policy: Policy) -> DataFrame:
    """Spans per column and entity type."""
    return cell_spans(df, columns, policy).groupBy("column", "entity_type").agg(F.count(F.lit(1)).alias("n"))


def entity_totals(df: DataFrame, columns: list[str], policy: Policy) -> DataFrame:
    """Spans per entity type over all cells."""
    return cell_spans(df, columns, policy).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


def observed(df: DataFrame, columns: list[str], policy: Policy, job_id: str) -> tuple[DataFrame, Observation]:
    """The rewritten table, with counts gathered while it is written.

    Read ``observation.get`` after the write; no second pass over the data.
    """
    watch = Observation(job_id)
    fast = policy.but(explain=False)
    columns = _checked(df, columns)
    with_spans = df.withColumns({f"_spans_{c}": F.expr(spans_sql(f"`{c}`", fast)) for c in columns})
    measured = [F.count(F.lit(1)).alias("rows")]
    for c in columns:
        measured.append(F.sum(F.size(f"_spans_{c}")).alias(f"entities:{c}"))
    for entity in (policy.entities or fv.ENTITIES):
        per_row = None
        for c in columns:
            n = F.expr(f"size(filter(`_spans_{c}`, s -> s.entity_type = '{entity}'))")
            per_row = n if per_row is None else per_row + n
        measured.append(F.sum(per_row).alias(f"type:{entity}"))
    seen = with_spans.observe(watch, *measured)
    out = seen.withColumns({c: F.expr(let(keep_best(f"`_spans_{c}`"), lambda k, c=c: rewrite_sql(f"`{c}`", k, fast)))
                            for c in columns})
    return out.select(*df.columns), watch


def job_stats(df: DataFrame, key: str, columns: list[str], policy: Policy, job_id: str) -> DataFrame:
    """One-row job report: rows, entities, counts per type, columns, operator, samples."""
    rows = df.agg(F.count(F.lit(1)).alias("total_rows"))
    totals = entity_totals(df, columns, policy).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_entities"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "n")))).alias("entity_counts"))
    before = df.orderBy(key).limit(3).select(key, *columns)
    after = deidentify(before, columns, policy)
    pack = lambda d: d.na.fill("").agg(F.array_sort(F.collect_list(F.struct(key, *columns)))).scalar()
    found = totals.select(F.struct("total_entities", "entity_counts")).scalar()
    return rows.withColumn("_found", found).select(
        F.lit(job_id).alias("job_id"), "total_rows", F.col("total_rows").alias("processed_rows"),
        "_found.total_entities", "_found.entity_counts",
        F.array(*[F.lit(c) for c in columns]).alias("cols_processed"),
        F.lit(policy.operator).alias("operator"),
        pack(before).alias("sample_before"), pack(after).alias("sample_after"))


def flag_errors(df: DataFrame, checks: dict[str, Column], error_col: str = "_error") -> DataFrame:
    """Name every failed check of a row; null when all pass.  An undecided check fails."""
    named = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]
    text = F.concat_ws(", ", *named)
    return df.withColumn(error_col, F.when(text != "", text))


def split_quarantine(flagged: DataFrame, error_col: str = "_error") -> tuple[DataFrame, DataFrame]:
    """(good rows without the error column, quarantined rows with it)."""
    return flagged.where(F.col(error_col).isNull()).drop(error_col), flagged.where(F.col(error_col).isNotNull())


def quarantine_failures(df: DataFrame, key: str, spotted: DataFrame, error_col: str = "_error") -> DataFrame:
    """The raw rows whose text a recogniser failed on, with the error; ``spotted`` is that of ``guarded_model_spans``.

    The job goes on without them: ``attach_spans`` gives these rows no spans, so take them out or publish no text.
    """
    errors = spotted.where("error IS NOT NULL").groupBy(key).agg(F.min("error").alias(error_col))
    return df.join(errors, key)


def density(stats: DataFrame) -> DataFrame:
    """Entities per processed row and per output row."""
    return stats.withColumns({
        "entities_per_row": F.round(safe_ratio(F.col("total_entities"), F.col("processed_rows")), 2),
        "redaction_ratio": F.round(safe_ratio(F.col("total_entities"), F.col("total_rows")), 2)})


def entity_stats(stats: DataFrame, key: str = "job_id") -> DataFrame:
    """The count map of each job as rows."""
    return stats.select(key, F.explode("entity_counts").alias("entity_type", "n"))


def compare_runs(stats: DataFrame) -> DataFrame:
    """Per run: rows, entities, entities per row, and whether it found the most."""
    runs = stats.groupBy("job_id").agg(
        F.coalesce(F.sum("processed_rows"), F.lit(0)).alias("processed_rows"),
        F.coalesce(F.sum("total_entities"), F.lit(0)).alias("entities"))
    best = runs.agg(F.min_by("job_id", F.struct(-F.col("entities"), F.col("job_id")))).scalar()
    return (runs.withColumn("entities_per_row", F.round(safe_ratio(F.col("entities"), F.col("processed_rows")), 3))
            .withColumn("is_best", F.col("job_id") == best))


PROGRESS_FIELDS = ["pct", "processed", "total", "message", "status", "ts"]


def newest_by_source(events: DataFrame) -> DataFrame:
    """The newest record ``p`` of each job and progress source; on a stream, run it in update mode."""
    packed = F.struct("updated_at", *PROGRESS_FIELDS)
    return events.groupBy("job_id", "source_rank").agg(F.max_by(packed, F.struct("updated_at", "seq")).alias("p"))


def latest_progress(events: DataFrame) -> DataFrame:
    """Latest state per job from several progress sources; an aggregate with partial combine on another."""
    return merge_progress(newest_by_source(events))


def merge_progress(newest: DataFrame) -> DataFrame:
    """One state per job from the newest record of each source.

    The fresher source wins field by field and missing fields come from the other.
    ``source_rank`` breaks ties (lower wins).
    """
    order = F.struct(F.col("p.updated_at"), -F.col("source_rank"))
    merged = newest.groupBy("job_id").agg(
        *[F.max_by(F.col(f"p.{f}"), F.when(F.col(f"p.{f}").isNotNull(), order)).alias(f) for f in PROGRESS_FIELDS],
        F.max("p.updated_at").alias("updated_at"))
    pct = F.least(F.greatest(F.coalesce("pct", F.lit(0.0)), F.lit(0.0)), F.lit(100.0))
    return merged.select(
        "job_id", F.round(pct, 1).alias("pct"),
        F.greatest(F.coalesce("processed", F.lit(0)), F.lit(0)).alias("processed"),
        F.greatest(F.coalesce("total", F.lit(0)), F.lit(0)).alias("total"),
        F.coalesce("message", F.lit("")).alias("message"),
        F.lower(F.coalesce("status", F.lit(""))).alias("status"), "ts", "updated_at")


def remaining_seconds(elapsed: Column, pct: Column) -> Column:
    """elapsed x (100 - pct) / pct; null until something is done."""
    return F.when(pct > 0, elapsed * (100.0 - pct) / pct)


def reconcile_status(progress: DataFrame, scheduler: DataFrame) -> DataFrame:
    """One status per job from progress rows and scheduler rows; error beats done.

    A message that speaks of failure turns a finished job into an error.
    """
    p = progress.select("job_id", F.lower(F.coalesce("status", F.lit(""))).alias("_p"),
                        F.lower(F.coalesce("message", F.lit(""))).alias("_m"), F.col("pct").alias("_pct"))
    s = scheduler.select("job_id", F.lower(F.coalesce("status", F.lit(""))).alias("_s"))
    both = p.join(s, "job_id", "full_outer")
    spoken = None
    for w in fv.ERROR_WORDS:
        hit = F.col("_m").contains(w)
        spoken = hit if spoken is None else spoken | hit
    failed = F.coalesce((F.col("_p") == "error") | spoken, F.lit(False))
    state = (F.when(F.col("_s").isin("done", "skipped"), F.when(failed, F.lit("error")).otherwise(F.lit("done")))
             .when(F.col("_s").isin("failed", "cancelled", "abandoned"), F.lit("error"))
             .when(F.col("_s").isin("submitted", "blocked", "pending", "running"), F.lit("running"))
             .otherwise(F.coalesce("_p", F.lit(""))))
    return (both.withColumn("status", state)
            .select("job_id", "status", F.when(F.col("status") == "done", F.lit(100.0))
                    .otherwise(F.coalesce("_pct", F.lit(0.0))).alias("pct")))


def jobs_rollup(jobs: DataFrame) -> DataFrame:
    """Total, running, entities, success rate over closed jobs."""
    done, failed = F.count_if(F.col("status") == "done"), F.count_if(F.col("status") == "error")
    return (jobs.agg(F.count(F.lit(1)).alias("total"), done.alias("done"), failed.alias("failed"),
                     F.coalesce(F.sum("total_entities"), F.lit(0)).alias("entities"))
            .withColumn("running", F.col("total") - F.col("done") - F.col("failed"))
            .withColumn("success_pct", F.round(safe_ratio(F.col("done") * 100.0, F.col("done") + F.col("failed")), 1)))


def status_label(value: Column) -> Column:
    """Small stable set of labels from free-form status text."""
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(low == "", F.lit(fv.STATUS_LABEL_BLANK)).otherwise(
        by_rules(low, fv.STATUS_LABEL_RULES, F.lit(fv.STATUS_LABEL_DEFAULT)))


def error_feed(job_errors: DataFrame, audit: DataFrame, width: int | None = None) -> DataFrame:
    """Job errors and the audit rows of jobs; ``width`` cuts the details for display."""
    own = job_errors.select(
        "job_id", F.col("finished_at").alias("at"), F.explode("errors").alias("details")).select(
        "job_id", "at", F.lit("processor").alias("source"), shortened(F.col("details"), width).alias("details"),
        F.lit("warning").alias("severity"))
    logged = audit.where(F.col("resource_type") == "job").select(
        F.col("resource_id").alias("job_id"), F.col("timestamp").alias("at"), F.lit("audit").alias("source"),
        shortened(F.coalesce("details", F.lit("")), width).alias("details"), "severity")
    return own.unionByName(logged)


def complete_jobs(jobs: DataFrame, cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Finished jobs: (cards to move to review, sessions to create)."""
    done = jobs.where(F.col("status") == "done")
    waiting = cards.where(F.col("status") == "in_progress").select(
        F.col("id").alias("card_id"), "job_id", "priority")
    hit = lookup_join(waiting, done.select("job_id", "file_name", "entity_counts", "operator", "duration_s"), "job_id", "card_id")
    severity = priority_severity(F.col("priority"))
    short = F.substring("job_id", 1, 8)
    session_id = F.sha2(F.concat_ws("|", "job_id", "card_id"), 256)
    moves = hit.select(
        "card_id", F.lit("review").alias("status"), session_id.alias("session_id"), severity.alias("severity"),
        F.concat(F.lit("Auto-moved to review after job "), short, F.lit(" completed")).alias("details"))
    sessions = hit.select(
        session_id.alias("id"),
        F.concat(F.lit("File job "), short, F.when(F.coalesce("file_name", F.lit("")) != "",
                 F.concat(F.lit(" — "), "file_name")).otherwise(F.lit(""))).alias("title"),
        "entity_counts", F.coalesce("operator", F.lit("replace")).alias("operator"),
        F.lit("file").alias("source_type"), "file_name", F.col("card_id").alias("pipeline_card_id"),
        (F.coalesce("duration_s", F.lit(0.0)) * 1000.0).alias("processing_ms"))
    return moves, sessions


def priority_severity(priority: Column) -> Column:
    low = F.lower(F.coalesce(priority, F.lit("")))
    return (F.when(low == "critical", F.lit("critical")).when(low == "high", F.lit("warning"))
            .otherwise(F.lit("info")))


def scenario_status(scenarios: DataFrame, jobs: DataFrame) -> DataFrame:
    """Latest job status per scenario; none is "submitted", a blank scenario "—"."""
    names = F.create_map(*[F.lit(v) for pair in fv.JOB_STATUS_NAMES.items() for v in pair])
    latest = jobs.groupBy("scenario_id").agg(F.max_by("status", F.struct("ts", "seq")).alias("_s"))
    shown = F.coalesce(F.element_at(names, F.upper("_s")), F.lower("_s"), F.lit("submitted"))
    # A blank scenario has no job; such rows are spread over tasks by their other columns.
    return (lookup_join(scenarios, latest, "scenario_id", scenarios.columns, "left")
            .withColumn("job_status", F.when(F.coalesce("scenario_id", F.lit("")) == "", F.lit("—"))
                        .otherwise(shown)).drop("_s"))
