"""Reports over detections, sessions, cards, appointments and audit entries."""

from __future__ import annotations

import math

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import fixed_values as fv
from ..functions.columns import percent, positive, safe_ratio, shortened
from ..functions.expr import let, raw, record
from ..functions.when import as_moment, in_window, ntz
from ..plans.salting import lookup_join
from ..plans.shared import written
from ..plans.unnest import inline_rows
from ..plans.windows import running_clamped_sum
from .filters import count_by_priority, count_by_severity, domain_counts
from .records import entity_breakdown, global_stats


# --- cards -----------------------------------------------------------------

def stage_distribution(cards: DataFrame) -> DataFrame:
    """Cards per stage with share in percent (one digit); empty stages dropped."""
    counts = domain_counts(cards, F.col("status"), fv.CARD_STATUSES, "status").where("n > 0")
    total = F.sum("n").over(W.partitionBy())  # at most four rows
    return counts.select("position", "status", "n", percent(F.col("n"), total).alias("share_pct"))


def funnel(cards: DataFrame) -> DataFrame:
    """Cards per stage in stage order, empty stages kept."""
    return domain_counts(cards, F.col("status"), fv.CARD_STATUSES, "status")


def completion(cards: DataFrame) -> DataFrame:
    """Completion percent (half to even), in flight, backlog."""
    done = F.count_if(F.col("status") == "done")
    total = F.count_if(F.col("status").isin(fv.CARD_STATUSES))
    return cards.agg(
        F.bround(safe_ratio(done * 100.0, total), 0).cast("int").alias("completion_pct"),
        F.count_if(F.col("status").isin("in_progress", "review")).alias("in_flight"),
        F.count_if(F.col("status") == "backlog").alias("backlog"))


def priority_counts(cards: DataFrame) -> DataFrame:
    """Critical first, empty priorities dropped."""
    return (count_by_priority(cards).where("n > 0")
            .select((F.lit(len(fv.PRIORITIES) + 1) - F.col("position")).alias("position"), "priority", "n"))


def board_summary(cards: DataFrame) -> DataFrame:
    is_done = F.col("status") == "done"
    urgent = (F.col("status") == "backlog") & F.lower("priority").isin("high", "critical")
    return cards.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~is_done).alias("open"), F.count_if(is_done).alias("done"),
        F.count_if(F.coalesce("attested", F.lit(False))).alias("attested"),
        F.count_if(urgent).alias("high_priority_backlog"), F.max("updated_at").alias("latest_update"))


_STAGE = "(" + "|".join(s.replace("_", "[_ ]") for s in fv.CARD_STATUSES) + ")"
_EDGE_L, _EDGE_R = r"(?:^|[^a-z0-9_])", r"(?:$|[^a-z0-9_])"
# Arrows may touch the stages; the word needs white space on both sides.
_ARROW = rf"{_EDGE_L}{_STAGE}(?:\s*(?:→|->)\s*|\s+to\s+){_STAGE}{_EDGE_R}"


def parse_move(details: str) -> Column:
    """struct<from_status, to_status> out of free text: "a → b", "a -> b" or "a to b"
    first, else the first and the last stage word; null when fewer than two are named.

    ``details`` is a column name or SQL expression.
    """
    pair = lambda a, b: record(from_status=f"replace({a}, ' ', '_')", to_status=f"replace({b}, ' ', '_')")

    def by_words(low: str) -> str:
        # Edges are doubled so that neighbouring words do not share one.
        spaced = f"replace(regexp_replace({low}, '([^a-z0-9_])', '$1$1'), 'in  progress', 'in_progress')"
        words = f"regexp_extract_all({spaced}, {raw(_EDGE_L + _STAGE + _EDGE_R)}, 1)"
        return let(words, lambda w: f"IF(size({w}) >= 2, {pair(f'{w}[0]', f'element_at({w}, -1)')}, NULL)")

    def body(low: str) -> str:
        hit = f"regexp_extract({low}, {raw(_ARROW)}, 0)"
        ends = lambda h: pair(f"regexp_extract({h}, {raw(_ARROW)}, 1)", f"regexp_extract({h}, {raw(_ARROW)}, 2)")
        return let(hit, lambda h: f"IF({h} <> '', {ends(h)}, {by_words(low)})")

    return F.expr(let(f"lower({details})", body))


def burndown(cards: DataFrame, audit: DataFrame, as_of: datetime | str) -> DataFrame:
    """Open cards over time with an ideal line.

    +1 when a card is created, -1 when it enters done, +1 when it is reopened; a
    done card without a logged move counts -1 at ``done_at`` (or ``updated_at``).
    Times are never before creation, simultaneous events are netted, the running
    value never drops below zero, and the last point is the true open count.
    """
    now = ntz(as_moment(as_of))
    known = cards.where(F.col("created_at").isNotNull() & (F.coalesce("id", F.lit("")) != "")).select(
        F.col("id").alias("card_id"), "status", F.date_trunc("second", "created_at").cast("timestamp_ntz").alias("c_at"),
        F.coalesce("done_at", "updated_at", "created_at").alias("d_at"))
    logs = audit.where(F.col("action") == "pipeline.move").select(
        F.col("resource_id").alias("card_id"), F.col("timestamp").alias("at"), "details")
    moves = (inline_rows(logs, ["card_id", "at"], F.array(parse_move("details")), "from_status")
             .where(F.col("at").isNotNull() & (F.col("from_status") != F.col("to_status"))
                    & ((F.col("from_status") == "done") | (F.col("to_status") == "done"))))
    # Each move knows its card's creation; the card side has one row per key.
    logged = moves.join(known.select("card_id", "c_at"), "card_id").select(
        "card_id", F.greatest("at", "c_at").alias("ts"),
        F.when(F.col("to_status") == "done", F.lit(-1)).otherwise(F.lit(1)).alias("delta"))
    created = known.select(F.col("c_at").alias("ts"), F.lit(1).alias("delta"))
    moved_cards = logged.select("card_id").distinct()
    fallback = (known.where(F.col("status") == "done").join(moved_cards, "card_id", "left_anti")
                .select(F.greatest("d_at", "c_at").alias("ts"), F.lit(-1).alias("delta")))
    events = created.unionByName(logged.select("ts", "delta")).unionByName(fallback)
    second = F.date_trunc("second", "ts").cast("timestamp_ntz")
    # One row per second with an event.  Several steps need it, so it is written once.
    netted = written(events.groupBy(second.alias("ts")).agg(F.sum("delta").alias("delta")), "burndown")
    line = running_clamped_sum(netted, "ts", "delta", "remaining")

    # One aggregate over the netted points and one over the cards give the frame
    # of the ideal line; both are single rows.
    span = netted.agg(F.min("ts").alias("first"), F.max("ts").alias("last"),
                      F.min_by(F.greatest("delta", F.lit(0)), "ts").alias("start_value"))
    open_now = cards.agg(F.count_if(F.coalesce("status", F.lit("")) != "done").alias("n")).scalar()
    frame = span.select(F.struct("first", "last", "start_value")).scalar()
    framed = line.select("ts", "remaining", frame.alias("f"))
    closing = span.where(F.col("last") < now).select(now.alias("ts"))
    end = F.greatest(F.col("f.last"), now)
    points = (framed.select("ts", "remaining", "f")
              .unionByName(closing.select("ts", F.lit(None).cast("bigint").alias("remaining"), frame.alias("f"))))
    seconds = lambda a, b: F.timestamp_diff("SECOND", a, b).cast("double")
    whole = F.greatest(F.lit(1.0), seconds(F.col("f.first"), end))
    only_point = F.col("f.first") == end
    start_value = F.when(only_point, open_now).otherwise(F.col("f.start_value"))
    gone = F.least(F.lit(1.0), F.greatest(F.lit(0.0), seconds(F.col("f.first"), F.col("ts")) / whole))
    return points.select(
        "ts", F.when(F.col("ts") == end, open_now).otherwise(F.col("remaining")).cast("bigint").alias("remaining"),
        F.greatest(F.lit(0.0), F.round(start_value * (1 - gone), 2)).alias("ideal"))


def table_signature(df: DataFrame, columns: list[str]) -> DataFrame:
    """Row count and an order-free checksum, to tell whether a table changed."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in columns]
    part = F.conv(F.substring(F.md5(F.concat_ws("|", *cells)), 1, 8), 16, 10).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(part).alias("checksum"))


def appointment_cards(appts: DataFrame, cards: DataFrame) -> DataFrame:
    """Appointments with the title of their card, "—" when there is none."""
    titles = cards.select(F.col("id").alias("pipeline_card_id"), F.col("title").alias("card_title"))
    found = lookup_join(appts, titles, "pipeline_card_id", "id", "left")
    return found.select(*appts.columns, F.coalesce("card_title", F.lit("—")).alias("card_title"))


def card_history(audit: DataFrame, cards: DataFrame, width: int | None = None) -> DataFrame:
    """Audit rows of every card; ``width`` cuts the details for display."""
    rows = audit.where(F.col("resource_type") == "card").select(
        F.col("resource_id").alias("card_id"), F.col("id").alias("audit_id"), "timestamp", "action", "actor",
        shortened(F.coalesce("details", F.lit("")), width).alias("details"))
    return lookup_join(rows, cards.select(F.col("id").alias("card_id")), "card_id", "audit_id", "left_semi").select(*rows.columns)


def card_sessions(sessions: DataFrame, cards: DataFrame) -> DataFrame:
    """(card, session) links from either side, each once."""
    from_session = sessions.where(F.col("pipeline_card_id").isNotNull()).select(
        F.col("pipeline_card_id").alias("card_id"), F.col("id").alias("session_id"))
    from_session = lookup_join(from_session, cards.select(F.col("id").alias("card_id")), "card_id", "session_id",
                               "left_semi").select("card_id", "session_id")
    from_card = cards.where(F.coalesce("session_id", F.lit("")) != "").select(F.col("id").alias("card_id"), "session_id")
    from_card = lookup_join(from_card, sessions.select(F.col("id").alias("session_id")), "session_id", "card_id",
                            "left_semi").select("card_id", "session_id")
    return from_session.unionByName(from_card).distinct()


# --- entities --------------------------------------------------------------

def top_entities(sessions: DataFrame, n: int = 8) -> DataFrame:
    """Most frequent types with their share of all detections, and the leader's share."""
    return _shares(entity_breakdown(sessions), positive(n)).select(
        "position", "entity_type", F.col("n").alias("detections"), "share_pct", "dominance_pct")


def pareto(sessions: DataFrame, top_n: int = 10) -> DataFrame:
    """Top types with share and cumulative share of all detections."""
    return _shares(entity_breakdown(sessions), positive(top_n)).select(
        "position", "entity_type", "n", "share_pct", "cumulative_pct")


def _shares(breakdown: DataFrame, n: int) -> DataFrame:
    """One row per entity type, so these unpartitioned windows see a handful of rows."""
    ordered = W.orderBy(F.col("n").desc(), F.col("entity_type"))
    total = F.sum("n").over(W.partitionBy())
    return (breakdown.select(
        "entity_type", "n", F.row_number().over(ordered).alias("position"),
        percent(F.col("n"), total).alias("share_pct"),
        percent(F.sum("n").over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow)), total).alias("cumulative_pct"),
        percent(F.max("n").over(W.partitionBy()), total).alias("dominance_pct"))
        .where(F.col("position") <= n))


def severity_counts(audit: DataFrame, window: str, as_of: datetime | str) -> DataFrame:
    return count_by_severity(audit.where(in_window(F.col("timestamp"), window, as_of)))


def entities_in(counts: Column) -> Column:
    return F.aggregate(F.map_values(counts), F.lit(0).cast("bigint"), lambda a, x: a + x)


def daily_trend(sessions: DataFrame) -> DataFrame:
    """Sessions and entities per calendar day."""
    return (sessions.groupBy(F.to_date("created_at").alias("day"))
            .agg(F.count(F.lit(1)).alias("sessions"),
                 F.sum(F.coalesce(entities_in(F.col("entity_counts")), F.lit(0))).alias("entities")))


def last_active_days(sessions: DataFrame, n: int = 7) -> DataFrame:
    """The newest days that have data."""
    return daily_trend(sessions).orderBy(F.col("day").desc()).limit(positive(n))


def processing_time(sessions: DataFrame, as_of_order: str = "created_at") -> DataFrame:
    """Mean, newest minus mean, count, axis limit (1.2 x max, at least 50), speed band."""
    one = sessions.where(F.col("processing_ms").isNotNull() & (F.col("processing_ms") > 0)).agg(
        F.count(F.lit(1)).alias("n"), F.avg("processing_ms").alias("mean"), F.max("processing_ms").alias("top"),
        F.max_by("processing_ms", F.struct(as_of_order, "id")).alias("newest"))
    mean = F.coalesce("mean", F.lit(0.0))
    return one.select(
        "n", F.round(mean, 1).alias("mean_ms"), F.round(F.coalesce("newest", F.lit(0.0)) - mean, 1).alias("newest_vs_mean"),
        F.greatest(F.lit(50.0), F.coalesce("top", F.lit(0.0)) * 1.2).alias("axis_max"),
        F.when(mean < 50, F.lit("fast")).when(mean < 200, F.lit("normal")).otherwise(F.lit("slow")).alias("band"))


def recent_processing(sessions: DataFrame, n: int = 12) -> DataFrame:
    return (sessions.where(F.col("processing_ms") > 0).orderBy(F.col("created_at").desc(), F.col("id").desc())
            .limit(positive(n)).select("id", "created_at", "processing_ms"))


# --- evidence --------------------------------------------------------------

def evidence_rows(detections: DataFrame, key: str) -> DataFrame:
    """Display form of spans: confidence in percent and its band."""
    pct = F.bround(F.col("score") * 100, 0).cast("int")
    return detections.select(
        key, "entity_type", "text", pct.alias("confidence"), confidence_band(pct).alias("band"),
        F.concat(F.col("start").cast("string"), F.lit("–"), F.col("end").cast("string")).alias("span"),
        "recognizer", "rationale")


def confidence_band(pct: Column) -> Column:
    out = None
    for label, low in fv.CONFIDENCE_BANDS[:-1]:
        out = F.when(pct >= low, F.lit(label)) if out is None else out.when(pct >= low, F.lit(label))
    return out.otherwise(F.lit(fv.CONFIDENCE_BANDS[-1][0]))


def recogniser_crosstab(evidence: DataFrame, types: list[str]) -> DataFrame:
    """Evidence count per recogniser and entity type; the type list is explicit, so one pass."""
    return evidence.groupBy("recognizer").agg(
        *[F.count_if(F.col("entity_type") == t).alias(t) for t in types])


def confidence_distribution(evidence: DataFrame) -> DataFrame:
    """Box-plot numbers per type from a count per (type, confidence).

    Confidence is a whole percent, so a type has at most 101 distinct values.
    """
    counts = evidence.groupBy("entity_type", "confidence").agg(F.count(F.lit(1)).alias("n"))
    q = counts.groupBy("entity_type").agg(
        F.sum("n").alias("n"), F.min("confidence").alias("low"), F.max("confidence").alias("high"),
        F.expr("percentile(confidence, array(0.25, 0.5, 0.75), n)").alias("q"),
        F.collect_list("confidence").alias("seen"))
    box = q.select("entity_type", "n", "low", "high", "seen", F.col("q")[0].alias("q1"),
                   F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    inside = F.expr("filter(seen, c -> c BETWEEN q1 - 1.5D * (q3 - q1) AND q3 + 1.5D * (q3 - q1))")
    return box.select("entity_type", "n", "low", "high", "q1", "median", "q3",
                      F.array_min(inside).alias("whisker_low"), F.array_max(inside).alias("whisker_high"))


def confidence_histogram(evidence: DataFrame, bins: int = 10) -> DataFrame:
    """Evidence per type and equal-width confidence bin; 100 falls into the last bin."""
    b = F.least(F.floor(F.col("confidence") * bins / F.lit(100)).cast("int"), F.lit(bins - 1))
    return evidence.groupBy("entity_type", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def confidence_density(evidence: DataFrame, bandwidth: float = 5.0, step: int = 5) -> DataFrame:
    """A violin's outline: the Gaussian kernel density of each type's confidences on a grid from 0 to 100.

    Worked out from a count per (type, confidence), of which a type has at most 101.
    """
    counts = evidence.groupBy("entity_type", "confidence").agg(F.count(F.lit(1)).alias("n"))
    grid = F.explode(F.sequence(F.lit(0), F.lit(100), F.lit(step)))
    z = (F.col("at") - F.col("confidence")) / F.lit(bandwidth)
    weight = F.col("n") * F.exp(-z * z / 2)
    return counts.withColumn("at", grid).groupBy("entity_type", "at").agg(
        F.round(F.sum(weight) / (F.sum("n") * F.lit(bandwidth * math.sqrt(2 * math.pi))), 6).alias("density"))


def confidence_kpis(evidence: DataFrame, key: str) -> DataFrame:
    """Per text: total, mean confidence, band counts, dominant band (first in order on ties)."""
    labels = [label for label, _ in fv.CONFIDENCE_BANDS]
    names = {label: label.lower().replace(" ", "_") for label in labels}
    per = evidence.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), F.bround(F.avg("confidence"), 0).cast("int").alias("mean_confidence"),
        *[F.count_if(F.col("band") == label).alias(names[label]) for label in labels])
    best = F.greatest(*[F.col(names[label]) for label in labels])
    dominant = None
    for label in labels:
        hit = F.col(names[label]) == best
        dominant = F.when(hit, F.lit(label)) if dominant is None else dominant.when(hit, F.lit(label))
    return per.withColumn("dominant_band", dominant)


def type_summary(detections: DataFrame, key: str) -> DataFrame:
    """Per text: "2x A, 1x B", by count and then name."""
    counts = detections.groupBy(key, "entity_type").agg(F.count(F.lit(1)).alias("n"))
    listed = counts.groupBy(key).agg(
        F.sum("n").alias("total"),
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "entity_type"))).alias("l"))
    part = F.transform("l", lambda e: F.concat((-e["o"]).cast("string"), F.lit("x "), e["entity_type"]))
    return listed.select(key, "total", F.array_join(part, ", ").alias("breakdown"))


def kpi_changes(snapshots: DataFrame, ts: str, kpi: str, keys: list[str]) -> DataFrame:
    """Change of a KPI against the snapshot before it, with a +/- label.

    Snapshots are one row per key and time, far fewer than the facts behind them.
    """
    prev = F.lag(kpi).over(W.partitionBy(*keys).orderBy(ts))
    delta = F.col(kpi) - prev
    text = F.col(kpi).cast("string")
    label = (F.when(delta > 0, F.concat(text, F.lit(" (+"), delta.cast("string"), F.lit(")")))
             .when(delta < 0, F.concat(text, F.lit(" ("), delta.cast("string"), F.lit(")")))
             .otherwise(F.concat(text, F.lit(" (=)"))))
    return snapshots.select(*keys, ts, kpi, delta.alias("delta"), label.alias("label"))


REPORT_MODES = {
    "operations": ["cards_backlog", "cards_in_progress", "cards_review", "cards_done"],
    "compliance": ["attested_cards", "total_audit_entries", "total_appointments"],
    "throughput": ["total_sessions", "total_entities"],
}


def mode_report(sessions: DataFrame, cards: DataFrame, appts: DataFrame, audit: DataFrame, mode: str) -> DataFrame:
    """The measures of one mode, or of all."""
    stats = global_stats(sessions, cards, appts, audit)
    if mode.lower() == "all":
        return stats
    if mode.lower() not in REPORT_MODES:
        raise ValueError(f"unknown report mode: {mode}")
    return stats.select(*REPORT_MODES[mode.lower()])


