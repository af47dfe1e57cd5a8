"""Record tables derived from the given tables, in Spark and in SQL.

Sessions come from documents and what is found in them, cards and appointments
from orders, audit entries, job events, progress rows and the change feed from
events.  Every row of the source table takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.detect import detect
from ..operators.rewrite import counts_sql
from ..plans.spread import spread
from ..policy import Policy
from . import duck

AS_OF_EVENTS = "2024-01-20 12:00:00"
AS_OF_ORDERS = "2000-06-01 00:00:00"

SESSION_POLICY = Policy(entities=("EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "IP_ADDRESS"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def document_spans(spark: SparkSession, sf_dir: str, policy: Policy) -> DataFrame:
    """doc_id, text, spans."""
    return detect(documents(spark, sf_dir), "text", policy)


# --- sessions --------------------------------------------------------------

def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars"))
    op = F.element_at(F.array(*[F.lit(o) for o in ("replace", "redact", "mask", "hash")]),
                      (F.col("doc_id") % 4 + 1).cast("int"))
    return (detect(docs, "text", SESSION_POLICY.but(explain=False)).select(
        F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("Document "), "doc_id").alias("title"),
        F.expr(counts_sql("spans")).alias("entity_counts"), op.alias("operator"),
        F.col("source").alias("source_type"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id as int))").alias("created_at"),
        F.col("doc_id").cast("string").alias("pipeline_card_id"), (F.col("n_chars") / F.lit(10)).alias("processing_ms")))


def sessions_sql() -> str:
    """CTEs ``sessions`` (one row each) and ``session_counts`` (id, entity_type, n)."""
    return duck.spans_ctes("documents", "doc_id", "text", SESSION_POLICY) + """,
session_counts AS (SELECT CAST(k AS VARCHAR) AS id, entity_type, count(*) AS n FROM spans GROUP BY 1, 2),
session_totals AS (SELECT id, CAST(sum(n) AS BIGINT) AS total FROM session_counts GROUP BY 1),
sessions AS (SELECT CAST(doc_id AS VARCHAR) AS id, 'Document ' || doc_id AS title,
  (['replace','redact','mask','hash'])[doc_id % 4 + 1] AS "operator", source AS source_type,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) AS created_at,
  CAST(doc_id AS VARCHAR) AS pipeline_card_id, n_chars / 10.0::DOUBLE AS processing_ms,
  coalesce(t.total, 0) AS total
  FROM documents d LEFT JOIN session_totals t ON t.id = CAST(d.doc_id AS VARCHAR))"""


# --- cards and appointments ------------------------------------------------

def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(*[F.expr(e) for e in (
        "cast(o_orderkey as string) AS id",
        "concat('Order ', o_orderkey) AS title",
        "concat(o_orderstatus, ' ', o_orderpriority) AS description",
        "element_at(array('backlog', 'in_progress', 'review', 'done'), cast(o_orderkey % 4 + 1 as int)) AS status",
        "cast(o_custkey as string) AS assignee",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' "
        "WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS priority",
        "array(concat(' ', lower(o_orderstatus), ' '), 'pii', concat('c', o_custkey % 7), 'pii', '') AS labels",
        "cast(o_custkey as string) AS session_id",
        "o_orderdate AS created_at",
        "o_orderdate + make_dt_interval(cast(o_orderkey % 20 as int)) AS updated_at",
        "IF(o_orderkey % 4 = 3 AND o_orderkey % 8 <> 7, o_orderdate + make_dt_interval(10), NULL) AS done_at",
        "o_orderkey % 8 = 3 AS attested",
        "IF(o_orderkey % 8 = 3, concat('reviewer ', o_custkey % 10), '') AS attested_by",
        "IF(o_orderkey % 8 = 3, o_orderdate + make_dt_interval(12), NULL) AS attested_at",
        "concat('scn-', o_custkey % 50) AS scenario_id",
        "concat('job-', o_custkey % 200) AS job_id")])


CARDS_SQL = """cards AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, 'Order ' || o_orderkey AS title,
  o_orderstatus || ' ' || o_orderpriority AS description,
  (['backlog','in_progress','review','done'])[o_orderkey % 4 + 1] AS status,
  CAST(o_custkey AS VARCHAR) AS assignee,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high'
    WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS priority,
  [' ' || lower(o_orderstatus) || ' ', 'pii', 'c' || (o_custkey % 7), 'pii', ''] AS labels,
  CAST(o_custkey AS VARCHAR) AS session_id, o_orderdate AS created_at,
  o_orderdate + to_days(CAST(o_orderkey % 20 AS INTEGER)) AS updated_at,
  CASE WHEN o_orderkey % 4 = 3 AND o_orderkey % 8 <> 7 THEN o_orderdate + INTERVAL 10 DAY END AS done_at,
  o_orderkey % 8 = 3 AS attested,
  CASE WHEN o_orderkey % 8 = 3 THEN 'reviewer ' || (o_custkey % 10) ELSE '' END AS attested_by,
  CASE WHEN o_orderkey % 8 = 3 THEN o_orderdate + INTERVAL 12 DAY END AS attested_at,
  'scn-' || (o_custkey % 50) AS scenario_id, 'job-' || (o_custkey % 200) AS job_id
  FROM orders)"""


def appointments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(*[F.expr(e) for e in (
        "concat('a', o_orderkey) AS id", "concat('Review ', o_orderkey) AS title",
        "IF(o_orderkey % 11 = 0, NULL, o_orderdate + make_dt_interval(30)) AS scheduled_for",
        "cast(15 * (1 + o_orderkey % 4) as int) AS duration_mins",
        "IF(o_orderkey % 5 = 0, NULL, cast(o_orderkey + o_orderkey % 3 as string)) AS pipeline_card_id",
        "element_at(array('scheduled', 'completed', 'cancelled'), cast(o_custkey % 3 + 1 as int)) AS status")])


APPTS_SQL = """appts AS (SELECT 'a' || o_orderkey AS id, 'Review ' || o_orderkey AS title,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate + INTERVAL 30 DAY END AS scheduled_for,
  CAST(15 * (1 + o_orderkey % 4) AS INTEGER) AS duration_mins,
  CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey + o_orderkey % 3 AS VARCHAR) END AS pipeline_card_id,
  (['scheduled','completed','cancelled'])[o_custkey % 3 + 1] AS status FROM orders)"""


# --- audit -----------------------------------------------------------------

def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(*[F.expr(x) for x in (
        "cast(event_id as string) AS id", "ts AS timestamp", "cast(user_id as string) AS actor",
        "concat('card.', event_type) AS action",
        "element_at(array('card', 'session', 'appointment', 'job'), cast(event_id % 4 + 1 as int)) AS resource_type",
        "get_json_object(props, '$.k') AS resource_id",
        "concat('User ', user_id, ' did ', upper(event_type), ' for ', get_json_object(props, '$.k')) AS details",
        "CASE event_type WHEN 'error' THEN 'critical' WHEN 'signup' THEN 'warning' ELSE 'info' END AS severity")])


AUDIT_SQL = """audit AS (SELECT CAST(event_id AS VARCHAR) AS id, ts AS "timestamp", CAST(user_id AS VARCHAR) AS actor,
  'card.' || event_type AS action,
  (['card','session','appointment','job'])[event_id % 4 + 1] AS resource_type,
  json_extract_string(props, '$.k') AS resource_id,
  'User ' || user_id || ' did ' || upper(event_type) || ' for ' || json_extract_string(props, '$.k') AS details,
  CASE event_type WHEN 'error' THEN 'critical' WHEN 'signup' THEN 'warning' ELSE 'info' END AS severity FROM events)"""


def move_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card moves in free text: most cards enter done once, some are reopened."""
    o = table(spark, sf_dir, "orders")
    # A card that is done moved there; an open card with a key in 5 was done and reopened.
    moves = F.expr("""filter(array(
        IF(o_orderkey % 8 = 3, named_struct('d', 7, 'details', concat("Moved 'Order ", o_orderkey, "' from 'review' → 'done'")), NULL),
        IF(o_orderkey % 5 = 0, named_struct('d', 4, 'details', 'moved in progress -> done'), NULL),
        IF(o_orderkey % 5 = 0, named_struct('d', 6, 'details', 'Done to review by system'), NULL),
        IF(o_orderkey % 3 = 0, named_struct('d', 2, 'details', 'backlog → in_progress'), NULL),
        IF(o_orderkey % 13 = 0, named_struct('d', -3, 'details', 'Set from review, now done'), NULL),
        IF(o_orderkey % 17 = 0, named_struct('d', 5, 'details', 'nothing to see'), NULL)), m -> m IS NOT NULL)""")
    return o.select("o_orderkey", "o_orderdate", F.inline(moves)).select(
        F.lit("pipeline.move").alias("action"), F.col("o_orderkey").cast("string").alias("resource_id"), "details",
        F.expr("o_orderdate + make_dt_interval(d)").alias("timestamp"))


MOVES_SQL = """moves AS (
  SELECT 'pipeline.move' AS action, CAST(o_orderkey AS VARCHAR) AS resource_id, m.details AS details,
         o_orderdate + to_days(m.d) AS "timestamp"
  FROM orders, unnest([
    CASE WHEN o_orderkey % 8 = 3 THEN {'d': 7, 'details': 'Moved ''Order ' || o_orderkey || ''' from ''review'' → ''done'''} END,
    CASE WHEN o_orderkey % 5 = 0 THEN {'d': 4, 'details': 'moved in progress -> done'} END,
    CASE WHEN o_orderkey % 5 = 0 THEN {'d': 6, 'details': 'Done to review by system'} END,
    CASE WHEN o_orderkey % 3 = 0 THEN {'d': 2, 'details': 'backlog → in_progress'} END,
    CASE WHEN o_orderkey % 13 = 0 THEN {'d': -3, 'details': 'Set from review, now done'} END,
    CASE WHEN o_orderkey % 17 = 0 THEN {'d': 5, 'details': 'nothing to see'} END]) AS u(m)
  WHERE m IS NOT NULL)"""


# --- jobs ------------------------------------------------------------------

def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_events_of(table(spark, sf_dir, "events"))


def job_events_of(events: DataFrame) -> DataFrame:
    return events.select(*[F.expr(x) for x in (
        "concat('job-', user_id) AS job_id", "ts", "event_id AS seq",
        "CASE event_type WHEN 'signup' THEN 'submitted' WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' "
        "WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status",
        "cast(value as bigint) AS entities", "cast(get_json_object(props, '$.k') as bigint) AS rows")])


JOB_EVENTS_SQL = """job_events AS (SELECT 'job-' || user_id AS job_id, ts, event_id AS seq,
  CASE event_type WHEN 'signup' THEN 'submitted' WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running'
    WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status,
  CAST(trunc(value) AS BIGINT) AS entities, CAST(json_extract_string(props, '$.k') AS BIGINT) AS "rows" FROM events)"""


def job_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per job; the counts per type are kept as a map."""
    ev = job_events(spark, sf_dir)
    per_type = ev.groupBy("job_id", "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("entities").alias("e"), F.sum("rows").alias("r"),
        F.min("ts").alias("a"), F.max("ts").alias("z"), F.max("seq").alias("s"))
    per_job = per_type.groupBy("job_id").agg(
        F.sum("n").alias("total_rows"), F.sum("r").alias("processed_rows"), F.sum("e").alias("total_entities"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "e")))).alias("entity_counts"),
        F.min("a").alias("started_at"), F.max("z").alias("finished_at"), F.max_by("status", "s").alias("last_status"),
        F.max(F.when(F.col("status") == "failed", F.col("n"))).alias("n_failed"))
    state = (F.when(F.col("last_status") == "completed", F.lit("done")).when(
        F.col("last_status") == "failed", F.lit("error")).otherwise(F.lit("running")))
    return per_job.select(
        "job_id", "total_rows", "processed_rows", "total_entities", "entity_counts", "started_at", "finished_at",
        state.alias("status"), F.concat(F.lit("file "), "job_id", F.lit(".csv")).alias("file_name"),
        F.lit("mask").alias("operator"), (F.col("total_rows") / F.lit(4)).alias("duration_s"),
        F.when(F.col("n_failed") > 0, F.array(F.concat(F.col("n_failed").cast("string"), F.lit(" chunks failed"))))
        .otherwise(F.array().cast("array<string>")).alias("errors"))


JOB_STATS_SQL = JOB_EVENTS_SQL + """,
job_types AS (SELECT job_id, status, count(*) AS n, CAST(sum(entities) AS BIGINT) AS e FROM job_events GROUP BY 1, 2),
job_stats AS (SELECT j.job_id, count(*) AS total_rows, CAST(sum("rows") AS BIGINT) AS processed_rows,
  CAST(sum(entities) AS BIGINT) AS total_entities, min(ts) AS started_at, max(ts) AS finished_at,
  CASE arg_max(status, seq) WHEN 'completed' THEN 'done' WHEN 'failed' THEN 'error' ELSE 'running' END AS status,
  'file ' || j.job_id || '.csv' AS file_name, 'mask' AS "operator", count(*) / 4.0::DOUBLE AS duration_s,
  count(*) FILTER (WHERE status = 'failed') AS n_failed FROM job_events j GROUP BY j.job_id)"""


def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress_of(table(spark, sf_dir, "events"))


def progress_of(e: DataFrame) -> DataFrame:
    return e.select(*[F.expr(x) for x in (
        "concat('job-', user_id) AS job_id", "cast(event_id % 2 as int) AS source_rank", "event_id AS seq",
        "value AS pct", "IF(event_id % 3 = 0, NULL, cast(get_json_object(props, '$.k') as bigint) - 10) AS processed",
        "IF(event_id % 5 = 0, NULL, 100L) AS total",
        "IF(event_id % 7 = 0, NULL, concat('at ', event_type)) AS message",
        "IF(event_id % 4 = 0, NULL, upper(event_type)) AS status",
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") AS ts",
        "cast(unix_micros(cast(date_format(ts, 'yyyy-MM-dd HH:mm:ss') as timestamp)) div 1000000 as double) AS updated_at")])


PROGRESS_SQL = """progress AS (SELECT 'job-' || user_id AS job_id, CAST(event_id % 2 AS INTEGER) AS source_rank,
  event_id AS seq, value AS pct,
  CASE WHEN event_id % 3 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) - 10 END AS processed,
  CASE WHEN event_id % 5 <> 0 THEN 100 END AS total,
  CASE WHEN event_id % 7 <> 0 THEN 'at ' || event_type END AS message,
  CASE WHEN event_id % 4 <> 0 THEN upper(event_type) END AS status,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts,
  CAST(epoch_us(date_trunc('second', ts)) // 1000000 AS DOUBLE) AS updated_at FROM events)"""


# --- change feed -----------------------------------------------------------

FEED_FIELDS = ["title", "status", "assignee", "note"]


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signup puts a record, view, click and purchase patch it, error deletes it."""
    e = table(spark, sf_dir, "events")
    stage = "element_at(array('backlog', 'in_progress', 'review', 'done'), cast(cast(value * 100 as bigint) % 4 + 1 as int))"
    return e.select(*[F.expr(x) for x in (
        "concat('c', cast(get_json_object(props, '$.k') as int)) AS id", "event_id AS seq", "ts",
        "CASE event_type WHEN 'signup' THEN 'put' WHEN 'error' THEN IF(event_id % 2 = 0, 'delete', 'patch') ELSE 'patch' END AS op",
        "CASE event_type "
        f"WHEN 'signup' THEN concat('{{\"title\":\"T', event_id, '\",\"status\":\"', {stage}, '\",\"assignee\":\"u', user_id, '\"}}') "
        f"WHEN 'view' THEN concat('{{\"status\":\"', {stage}, '\"}}') "
        "WHEN 'click' THEN concat('{\"assignee\":\"u', user_id, '\",\"note\":null}') "
        "WHEN 'purchase' THEN concat('{\"note\":\"n', event_id, '\",\"attested\":\"true\",\"attested_by\":\"u', user_id, '\"}') "
        "ELSE '{}' END AS payload")])


FEED_SQL = """feed AS (SELECT 'c' || CAST(json_extract_string(props, '$.k') AS INTEGER) AS id, event_id AS seq, ts, user_id, event_type,
  CASE event_type WHEN 'signup' THEN 'put' WHEN 'error' THEN (CASE WHEN event_id % 2 = 0 THEN 'delete' ELSE 'patch' END) ELSE 'patch' END AS op,
  (['backlog','in_progress','review','done'])[CAST(trunc(value * 100) AS BIGINT) % 4 + 1] AS stage,
  'T' || event_id AS new_title, 'u' || user_id AS new_user, 'n' || event_id AS new_note FROM events),
lives AS (SELECT *, max(CASE WHEN op = 'put' THEN seq END) OVER w AS put_seq,
  max(CASE WHEN op = 'delete' THEN seq END) OVER w AS del_seq,
  max(CASE WHEN op = 'put' THEN seq END) OVER b AS put_before, max(CASE WHEN op = 'delete' THEN seq END) OVER b AS del_before
  FROM feed WINDOW w AS (PARTITION BY id ORDER BY seq ROWS UNBOUNDED PRECEDING),
                  b AS (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
