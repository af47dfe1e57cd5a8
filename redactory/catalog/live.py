"""Queries for streams (run over what is available) and due reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import job, reviews, telemetry
from ..plans.shared import work_dir
from ..policy import Policy
from ..streaming import live, run
from . import duck
from .base import STATEMENTS, query
from .derived import APPTS_SQL, AS_OF_ORDERS, CARDS_SQL, appointments, cards, job_events_of, progress_of
from .jobs import FAST

DUE = f"due AS (SELECT * FROM appts WHERE status = 'scheduled' AND scheduled_for <= TIMESTAMP '{AS_OF_ORDERS}')"
FIRE = "WITH " + APPTS_SQL + ", " + CARDS_SQL + ", " + DUE


@query("due_appointments", "WITH " + APPTS_SQL + ", " + DUE + " SELECT id, scheduled_for, pipeline_card_id FROM due")
def _(spark, d):
    return reviews.due_appointments(appointments(spark, d), AS_OF_ORDERS).select("id", "scheduled_for", "pipeline_card_id")


def _fired(spark, d, name):
    return reviews.fire(reviews.due_appointments(appointments(spark, d), AS_OF_ORDERS), cards(spark, d))[name]


@query("due_card_changes", FIRE + " SELECT DISTINCT c.id, 'review' AS status FROM due JOIN cards c ON c.id = due.pipeline_card_id WHERE c.status = 'in_progress'")
def _(spark, d):
    return _fired(spark, d, "card_changes")


@query("due_appointment_changes", FIRE + " SELECT id, 'completed' AS status FROM due")
def _(spark, d):
    return _fired(spark, d, "appointment_changes")


@query("due_audit", FIRE + """ SELECT 'pipeline.advance' AS action, 'card' AS resource_type, c.id AS resource_id,
 'Auto-advanced to Review via appointment ''' || arg_min(due.title, due.id) || '''' AS details FROM due JOIN cards c ON c.id = due.pipeline_card_id WHERE c.status = 'in_progress' GROUP BY c.id
UNION ALL SELECT 'appointment.due', 'appointment', id, 'Appointment ''' || title || ''' came due — actions executed' FROM due""")
def _(spark, d):
    return _fired(spark, d, "audit")


@query("live_due_reviews", FIRE + """, moved AS (SELECT c.id, arg_min(due.title, due.id) AS title FROM due JOIN cards c ON c.id = due.pipeline_card_id WHERE c.status = 'in_progress' GROUP BY c.id)
SELECT 'card_changes' AS kind, id, 'review' AS outcome FROM moved UNION ALL SELECT 'appointment_changes', id, 'completed' FROM due
UNION ALL SELECT 'audit', id, 'pipeline.advance card Auto-advanced to Review via appointment ''' || title || '''' FROM moved
UNION ALL SELECT 'audit', id, 'appointment.due appointment Appointment ''' || title || ''' came due — actions executed' FROM due""")
def _(spark, d):
    """Appointments as a stream in which every version arrives twice; those not yet due wait for their time."""
    base = work_dir(spark, "reviews")
    orders = run.stream_of(spark, d, "orders")
    twice = orders.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1))))
    appts = twice.select(*[F.expr(e) for e in (
        "concat('a', o_orderkey) AS id", "concat('Review ', o_orderkey) AS title",
        "IF(o_orderkey % 11 = 0, NULL, o_orderdate + make_dt_interval(30)) AS scheduled_for",
        "IF(o_orderkey % 5 = 0, NULL, cast(o_orderkey + o_orderkey % 3 as string)) AS pipeline_card_id",
        "element_at(array('scheduled', 'completed', 'cancelled'), cast(o_custkey % 3 + 1 as int)) AS status",
        "o_orderkey AS seq", f"timestamp'{AS_OF_ORDERS}' + make_dt_interval(0, 0, 10, 0.001) AS ts")])

    def write(name, rows, batch_id):
        outcome = F.concat_ws(" ", "action", "resource_type", "details") if name == "audit" else F.col("status")
        rows.select(F.lit(name).alias("kind"), F.col("resource_id" if name == "audit" else "id").alias("id"),
                    outcome.alias("outcome")).write.mode("overwrite").parquet(f"{base}/out/{name}/batch={batch_id}")

    live.watch_due_appointments(appts, lambda: cards(spark, d), write)(f"{base}/checkpoint").awaitTermination()
    out = [spark.read.parquet(f"{base}/out/{name}") for name in ("card_changes", "appointment_changes", "audit")]
    return out[0].unionByName(out[1]).unionByName(out[2]).select("kind", "id", "outcome")


@query("live_redaction", lambda: duck.spans_ctes("conversations", "conv_id * 100000 + turn", "text", FAST) + duck.kept_ctes()
       + duck.rewritten_ctes(duck.replacement("replace"))
       + " SELECT conv_id, turn, role, coalesce(new_text, text) AS text FROM conversations c LEFT JOIN rewritten r ON r.k = conv_id * 100000 + turn")
def _(spark, d):
    return run.run_appending(live.deidentify_stream(run.stream_of(spark, d, "conversations"), ["text"], FAST), "redaction")


EMAILS = Policy(entities=("EMAIL_ADDRESS", "IP_ADDRESS"), explain=False)


@query("live_entity_counts", lambda: duck.spans_ctes("documents", "doc_id", "text", EMAILS) + """,
e AS (SELECT entity_type, TIMESTAMP '2024-01-01 00:00:00' + to_hours(k) AS ts FROM spans), m AS (SELECT TIMESTAMP '2024-01-01 00:00:00' + to_hours(max(doc_id)) - INTERVAL 10 MINUTE AS wm FROM documents)
SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, entity_type, count(*) AS n FROM e, m
WHERE time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= wm GROUP BY 1, 2, 3""")
def _(spark, d):
    docs = run.stream_of(spark, d, "documents").select("text", F.expr(
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id as int))").cast("timestamp").alias("ts"))
    out = run.run_appending(live.live_entity_counts(docs, "text", "ts", EMAILS, "1 day"), "entities")
    return _ntz(out)


def _ntz(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


def _events(spark, d):
    return run.stream_of(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")


_CLOSED = """WITH m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM events), w AS ({}) SELECT window_start, window_start + INTERVAL {} AS window_end, event_type, count(*) AS n
FROM w, m WHERE window_start + INTERVAL {} <= date_trunc('millisecond', wm) GROUP BY 1, 2, 3"""


@query("live_event_counts", _CLOSED.format("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type FROM events", "1 HOUR", "1 HOUR"))
def _(spark, d):
    return _ntz(run.run_appending(live.live_event_counts(_events(spark, d), "ts", ["event_type"]), "tumbling"))


@query("live_event_counts_sliding", _CLOSED.format(
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(o) AS window_start, event_type FROM events, (SELECT unnest([0, 1]) AS o) q", "2 HOUR", "2 HOUR"))
def _(spark, d):
    counts = live.live_event_counts(_events(spark, d), "ts", ["event_type"], "2 hours", "1 hour")
    return _ntz(run.run_appending(counts, "sliding"))


@query("live_progress", lambda: STATEMENTS["latest_progress"])
def _(spark, d):
    """The stream's newest records, merged, are the batch form's answer."""
    newest = run.run_updating(live.live_progress(progress_of(run.stream_of(spark, d, "events"))), "progress", "job_id", "source_rank")
    return job.merge_progress(newest)


@query("live_queue_depth", lambda: STATEMENTS["queue_depth_over_time"])
def _(spark, d):
    """Every event arrives twice; the moves of the stream, summed, are the batch form's answer."""
    twice = job_events_of(run.stream_of(spark, d, "events")).withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1))))
    moves = live.live_queue_moves(twice.withColumn("ts", F.col("ts").cast("timestamp")))
    return telemetry.depth_of_moves(run.run_summing(moves, "moves", ["status", "ts"], "delta"))
