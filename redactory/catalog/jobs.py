"""Queries for sources, column profiles and table-wide jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.expr import is_blank
from ..operators import job, profile
from ..plans.shared import work_dir
from ..plans.spread import spread
from ..policy import Policy
from ..sources import manifest, tables as src
from . import duck
from .base import query
from .derived import (AUDIT_SQL, JOB_EVENTS_SQL, JOB_STATS_SQL, PROGRESS_SQL, CARDS_SQL, audit, cards, job_events,
                      job_stats, progress_events, table)

POLICY = Policy(entities=("EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "IP_ADDRESS", "URL"))
FAST = POLICY.but(explain=False)


# --- sources ---------------------------------------------------------------

@query("rows_from_json", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS "value", CAST(NULL AS VARCHAR) AS corrupt
FROM events UNION ALL SELECT event_id, NULL, event_type, NULL FROM events UNION ALL SELECT event_id, NULL, NULL, '{' || event_type FROM events""")
def _(spark, d):
    e = table(spark, d, "events")
    # Every event gives an object document (with an _id to drop), a bare value and a broken object.
    docs = e.select("event_id", F.explode(F.array(
        F.concat(F.lit('{"_id":"'), "event_id", F.lit('",'), F.expr("substring(props, 2)")), F.col("event_type"),
        F.concat(F.lit("{"), "event_type"))).alias("doc"))
    return src.rows_from_json(docs, "doc", "_id string, k bigint", keep=["event_id"])


@query("manifest_of_orders", """WITH files AS (SELECT strftime(o_orderdate, '%Y-%m') AS "month",
 string_agg(o_orderkey || ',' || o_custkey || chr(10), '' ORDER BY o_orderkey) AS content FROM orders GROUP BY 1)
SELECT "month", CAST(strlen(content) AS BIGINT) AS length, 'csv' AS extension, CASE WHEN strlen(content) <= 2000 THEN sha256(content) END AS sha256,
 strlen(content) <= 2000 AS accepted, CASE WHEN strlen(content) <= 2000 THEN 'ok' ELSE 'too large' END AS reason FROM files""")
def _(spark, d):
    """A folder a month with one CSV file each, written first; files of over 2,000 bytes are too large here."""
    path = work_dir(spark, "orders-by-month")
    orders = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderkey", "o_custkey")
    orders.repartition("month").sortWithinPartitions("month", "o_orderkey").write.partitionBy("month").csv(path)
    listed = manifest.file_manifest(spark, path, path, max_bytes=2000)
    return listed.withColumn("month", F.regexp_extract("path", "month=([0-9-]+)", 1)).select(
        "month", "length", "extension", "sha256", "accepted", "reason")


@query("csv_scan_split", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(spark, d):
    """Written as CSV and read with a schema, in splits."""
    path = work_dir(spark, "customer-csv")
    src.write_csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return src.read_table(spark, path, schema="c_custkey bigint, c_name string, c_acctbal double")


@query("csv_round_trip", "SELECT doc_id, text, lang, source FROM documents")
def _(spark, d):
    """Texts with line breaks survive quoting."""
    path = work_dir(spark, "documents-csv")
    src.write_csv(table(spark, d, "documents").select("doc_id", "text", "lang", "source"), path)
    return src.read_table(spark, path, schema="doc_id bigint, text string, lang string, source string", multiline=True)


@query("json_round_trip", "SELECT conv_id, turn, role, text FROM conversations")
def _(spark, d):
    path = work_dir(spark, "conversations-json")
    src.write_json(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), path)
    return src.read_table(spark, path, "json", schema="conv_id bigint, turn bigint, role string, text string")


@query("to_json_rows", """SELECT '{"event_id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '","event_type":'
 || CASE WHEN event_type = 'view' THEN 'null' ELSE '"' || event_type || '"' END || ',"score":'
 || CASE WHEN event_type = 'error' THEN 'null' ELSE CAST(CAST(user_id AS DOUBLE) AS VARCHAR) END || '}' AS document FROM events""")
def _(spark, d):
    e = table(spark, d, "events").selectExpr(
        "event_id", "ts", "nullif(event_type, 'view') AS event_type",
        "IF(event_type = 'error', double('NaN'), double(user_id)) AS score")
    return src.to_json_rows(e)


@query("list_payloads", """SELECT CAST(event_id AS VARCHAR) AS id, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
FROM events ORDER BY ts DESC, id LIMIT 25""")
def _(spark, d):
    e = table(spark, d, "events").selectExpr("string(event_id) AS id", "ts", "props")
    return src.list_payloads(e, "props", "k bigint", "ts", descending=True, limit=25)


@query("payload_by_id", """SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
WHERE event_id = (SELECT max(event_id) FROM events)""")
def _(spark, d):
    """The newest event's payload, looked up by its id in a table of all payloads kept in order of the id."""
    e = table(spark, d, "events").selectExpr("event_id AS id", "props")
    path = work_dir(spark, "payloads") + "/by_id"
    src.write_payloads(e, path, "id")
    return src.get_payload(spark.read.parquet(path), "props", "k bigint", "id", e.agg(F.max("id")).first()[0])


@query("filter_json_path", "SELECT event_id, user_id FROM events WHERE json_extract_string(props, '$.k') = '42'")
def _(spark, d):
    return src.where_json(table(spark, d, "events"), "props", "$.k", "42").select("event_id", "user_id")


@query("row_counts", "SELECT count(*) AS \"rows\" FROM lineitem")
def _(spark, d):
    return src.row_count(table(spark, d, "lineitem"))


@query("preview_rows", "SELECT conv_id, turn, coalesce(nullif(role, 'user'), '') AS role FROM conversations ORDER BY conv_id, turn LIMIT 50")
def _(spark, d):
    c = table(spark, d, "conversations").selectExpr("conv_id", "turn", "nullif(role, 'user') AS role",
                                                    "conv_id * 100000 + turn AS k")
    return src.preview(c, "k").drop("k")


@query("flatten_nested", """WITH """ + CARDS_SQL + """ SELECT id, '["' || array_to_string(labels, '","') || '"]' AS labels FROM cards""")
def _(spark, d):
    return src.flat(cards(spark, d).select("id", "labels"))


# --- column profiles -------------------------------------------------------

PROFILE_TABLES = {"documents": ["text", "lang", "source"], "conversations": ["role", "text"], "pages": ["url", "html"],
                  "events": ["event_type", "props"], "customer": ["c_name", "c_mktsegment"]}


def _profile_sql(t: str, columns: list[str], source=lambda t, c: f"(SELECT {c} AS v FROM {t})") -> str:
    screen = duck.lit(f"{fv.QUICK_SCREEN_MAIL}|{fv.QUICK_SCREEN_DIGITS}")
    parts = [f"""SELECT {i} AS "position", '{c}' AS "column", count(v) AS n, sum(len(regexp_extract_all(v, '[^ \\t\\r\\n\\f]+'))) AS w,
 count(*) FILTER (WHERE regexp_matches(v, {screen})) AS h FROM {source(t, c)} q""" for i, c in enumerate(columns)]
    return f"""SELECT "position", "column", n AS non_null, round(w / n::DOUBLE, 6) AS mean_words, h AS screen_hits,
 coalesce(w / n::DOUBLE >= 1.5 OR h > 0, false) AS chosen FROM ({' UNION ALL '.join(parts)}) u"""


def _profile_query(t: str, columns: list[str]) -> None:
    @query(f"profile_{t}", _profile_sql(t, columns))
    def _(spark, d):
        return profile.profile_columns(table(spark, d, t), columns)


for _t, _c in PROFILE_TABLES.items():
    _profile_query(_t, _c)


def _first_sql(t: str, key: str):
    return lambda _, c: f"(SELECT {c} AS v FROM {t} WHERE {c} IS NOT NULL ORDER BY {key} LIMIT 100)"


@query("text_columns_sampled", 'SELECT "position", "column" FROM (' + _profile_sql(
    "documents", PROFILE_TABLES["documents"], _first_sql("documents", "doc_id")) + ") p WHERE chosen")
def _(spark, d):
    return profile.choose_columns(profile.sampled_profile(table(spark, d, "documents"), "doc_id"))


@query("text_columns_fallback", "WITH p AS (" + _profile_sql("customer", PROFILE_TABLES["customer"])
       + """) SELECT "position", "column" FROM p WHERE CASE WHEN (SELECT bool_or(chosen) FROM p) THEN chosen ELSE "position" < 8 END""")
def _(spark, d):
    return profile.choose_columns(profile.profile_columns(table(spark, d, "customer")))


@query("quick_screen", f"""SELECT doc_id, regexp_matches(text, {duck.lit(fv.QUICK_SCREEN_MAIL + '|' + fv.QUICK_SCREEN_DIGITS)}) AS flagged FROM documents""")
def _(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", profile.pii_screen("text").alias("flagged"))


# --- jobs ------------------------------------------------------------------

@query("deidentify_documents", lambda: duck.spans_ctes("documents", "doc_id", "text", FAST) + duck.kept_ctes()
       + duck.rewritten_ctes(duck.replacement("replace"))
       + """ SELECT d.doc_id, sha256(coalesce(new_text, text)) AS text_hash, lang, source, n_chars
 FROM documents d LEFT JOIN rewritten r ON r.k = d.doc_id""")
def deidentify_documents(spark, d):
    out = job.deidentify(spread(table(spark, d, "documents")), ["text"], FAST)
    return out.select("doc_id", F.sha2("text", 256).alias("text_hash"), "lang", "source", "n_chars")


@query("deidentify_pages", lambda: duck.spans_ctes(
    "(SELECT page_id, url AS v, 'url' AS c FROM pages UNION ALL SELECT page_id, html, 'html' FROM pages)", "(page_id, c)", "v", FAST)
    + duck.kept_ctes() + duck.rewritten_ctes(duck.replacement("replace"))
    + """ SELECT p.page_id, coalesce(u.new_text, url) AS url, coalesce(h.new_text, html) AS html FROM pages p
LEFT JOIN rewritten u ON u.k = (p.page_id, 'url') LEFT JOIN rewritten h ON h.k = (p.page_id, 'html')""")
def _(spark, d):
    return job.deidentify(table(spark, d, "pages").select("page_id", "url", "html"), ["url", "html"], FAST)


@query("deidentify_conversations", lambda: duck.spans_ctes("conversations", "conv_id * 100000 + turn", "text", FAST) + duck.kept_ctes()
       + duck.rewritten_ctes(duck.replacement("replace"))
       + " SELECT conv_id, turn, role, coalesce(new_text, text) AS text FROM conversations c LEFT JOIN rewritten r ON r.k = conv_id * 100000 + turn")
def _(spark, d):
    return job.deidentify(table(spark, d, "conversations"), ["text"], FAST)


@query("entity_totals", lambda: duck.spans_ctes("documents", "doc_id", "text", FAST)
       + " SELECT entity_type, count(*) AS n FROM spans GROUP BY 1")
def _(spark, d):
    return job.entity_totals(table(spark, d, "documents"), ["text"], FAST)


@query("column_totals", lambda: duck.spans_ctes(
    "(SELECT page_id, url AS v, 'url' AS c FROM pages UNION ALL SELECT page_id, html, 'html' FROM pages)", "(page_id, c)", "v", FAST)
    + ' SELECT k[2] AS "column", entity_type, count(*) AS n FROM spans GROUP BY 1, 2')
def _(spark, d):
    return job.column_totals(table(spark, d, "pages"), ["url", "html"], FAST)


@query("job_report", lambda: duck.spans_ctes("documents", "doc_id", "text", FAST) + duck.kept_ctes()
       + duck.rewritten_ctes(duck.replacement("replace"))
       + """, totals AS (SELECT entity_type, count(*) AS n FROM spans GROUP BY 1),
samples AS (SELECT string_agg(doc_id || ':' || coalesce(text, ''), '|' ORDER BY doc_id) AS before,
 string_agg(doc_id || ':' || coalesce(new_text, text, ''), '|' ORDER BY doc_id) AS after
 FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 3) d LEFT JOIN rewritten r ON r.k = d.doc_id)
SELECT 'job-1' AS job_id, (SELECT count(*) FROM documents) AS total_rows, (SELECT count(*) FROM documents) AS processed_rows,
 CAST(coalesce(sum(n), 0) AS BIGINT) AS total_entities, coalesce(string_agg(entity_type || '=' || n, ',' ORDER BY entity_type), '') AS entity_counts,
 'text' AS cols_processed, 'replace' AS "operator", (SELECT sha256(before) FROM samples) AS sample_before,
 (SELECT sha256(after) FROM samples) AS sample_after FROM totals""")
def _(spark, d):
    s = job.job_stats(table(spark, d, "documents"), "doc_id", ["text"], FAST, "job-1")
    digest = lambda sample: F.sha2(F.expr(
        f"array_join(transform({sample}, r -> concat(r.doc_id, ':', r.text)), '|')"), 256).alias(sample)
    return s.select("job_id", "total_rows", "processed_rows", "total_entities", F.expr(
        "array_join(transform(map_entries(entity_counts), e -> concat(e.key, '=', string(e.value))), ',')").alias("entity_counts"),
        F.array_join("cols_processed", ",").alias("cols_processed"), "operator", digest("sample_before"), digest("sample_after"))


@query("quarantine_documents", """SELECT doc_id, concat_ws(', ', CASE WHEN NOT coalesce(length(text) = n_chars, false) THEN 'length' END,
 CASE WHEN NOT regexp_matches(coalesce(text, ''), '[^ \\t\\r\\n\\f]') THEN 'blank' END, CASE WHEN coalesce(lang, '') NOT IN ('en', 'fr') THEN 'language' END) AS "_error"
FROM documents WHERE "_error" <> ''""")
def _(spark, d):
    flagged = job.flag_errors(table(spark, d, "documents"), {
        "length": F.length("text") == F.col("n_chars"), "blank": ~F.expr(is_blank("text")),
        "language": F.col("lang").isin("en", "fr")})
    _, bad = job.split_quarantine(flagged)
    return bad.select("doc_id", "_error")


@query("job_density", "WITH " + JOB_STATS_SQL + """ SELECT job_id, round(total_entities / processed_rows::DOUBLE, 2) AS entities_per_row,
 round(total_entities / total_rows::DOUBLE, 2) AS redaction_ratio FROM job_stats""")
def _(spark, d):
    return job.density(job_stats(spark, d)).select("job_id", "entities_per_row", "redaction_ratio")


@query("entity_stats", "WITH " + JOB_STATS_SQL + " SELECT job_id, status AS entity_type, e AS n FROM job_types")
def _(spark, d):
    return job.entity_stats(job_stats(spark, d))


@query("compare_runs", "WITH " + JOB_STATS_SQL + """ SELECT job_id, processed_rows, total_entities AS entities,
 round(CASE WHEN processed_rows > 0 THEN total_entities / processed_rows::DOUBLE ELSE 0 END, 3) AS entities_per_row,
 row_number() OVER (ORDER BY total_entities DESC, job_id) = 1 AS is_best FROM job_stats""")
def _(spark, d):
    return job.compare_runs(job_stats(spark, d))


_MERGED = ", ".join(
    f"coalesce(arg_max({f}, ord) FILTER (WHERE {f} IS NOT NULL)) AS {f}" for f in job.PROGRESS_FIELDS)


@query("latest_progress", "WITH " + PROGRESS_SQL + """,
newest AS (SELECT *, row_number() OVER (PARTITION BY job_id, source_rank ORDER BY updated_at DESC, seq DESC) AS rn FROM progress),
two AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY updated_at, source_rank DESC) AS ord FROM newest WHERE rn = 1),
m AS (SELECT job_id, """ + _MERGED + """, max(updated_at) AS updated_at FROM two GROUP BY job_id)
SELECT job_id, round(least(greatest(coalesce(pct, 0), 0), 100), 1) AS pct, greatest(coalesce(processed, 0), 0) AS processed,
 CAST(greatest(coalesce(total, 0), 0) AS BIGINT) AS total, coalesce(message, '') AS message, lower(coalesce(status, '')) AS status, ts, updated_at FROM m""")
def _(spark, d):
    return job.latest_progress(progress_events(spark, d))


@query("remaining_time", "SELECT event_id, CASE WHEN value > 0 THEN user_id * (100.0::DOUBLE - value) / value END AS eta_s FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", job.remaining_seconds(F.col("user_id"), F.col("value")).alias("eta_s"))


_LATEST = """latest AS (SELECT job_id, arg_max(status, seq) AS st FROM job_events GROUP BY job_id),
prog AS (SELECT 'job-' || user_id AS job_id, arg_max(event_type, event_id) AS p, arg_max('run ' || event_type, event_id) AS m,
 arg_max(value, event_id) AS pct FROM events GROUP BY 1)"""


@query("reconcile_status", "WITH " + JOB_EVENTS_SQL + ", " + _LATEST + """,
j AS (SELECT coalesce(l.job_id, p.job_id) AS job_id, CASE st WHEN 'completed' THEN 'done' ELSE st END AS s, lower(coalesce(p, '')) AS p,
 lower(coalesce(m, '')) AS m, pct FROM latest l FULL JOIN prog p USING (job_id)),
r AS (SELECT job_id, pct, CASE WHEN s = 'done' THEN (CASE WHEN p = 'error' OR contains(m, 'error') OR contains(m, 'failed') OR contains(m, 'rejected') THEN 'error' ELSE 'done' END)
 WHEN s = 'failed' THEN 'error' WHEN s IN ('submitted', 'pending', 'running') THEN 'running' ELSE p END AS status FROM j)
SELECT job_id, status, CASE WHEN status = 'done' THEN 100.0 ELSE coalesce(pct, 0) END::DOUBLE AS pct FROM r""")
def _(spark, d):
    e = table(spark, d, "events").selectExpr(
        "concat('job-', user_id) AS job_id", "event_id", "event_type", "value")
    progress = e.groupBy("job_id").agg(F.max_by(F.struct("event_type", "value"), "event_id").alias("p")).select(
        "job_id", F.col("p.event_type").alias("status"), F.concat(F.lit("run "), "p.event_type").alias("message"),
        F.col("p.value").alias("pct"))
    state = job_events(spark, d).groupBy("job_id").agg(F.max_by("status", "seq").alias("s")).select(
        "job_id", F.when(F.col("s") == "completed", F.lit("done")).otherwise(F.col("s")).alias("status"))
    return job.reconcile_status(progress, state)


@query("jobs_rollup", "WITH " + JOB_STATS_SQL + """, a AS (SELECT count(*) AS total, count(*) FILTER (WHERE status = 'done') AS done,
 count(*) FILTER (WHERE status = 'error') AS failed, CAST(sum(total_entities) AS BIGINT) AS entities FROM job_stats)
SELECT total, done, failed, entities, total - done - failed AS running,
 round(CASE WHEN done + failed > 0 THEN done * 100.0::DOUBLE / (done + failed) ELSE 0 END, 1) AS success_pct FROM a""")
def _(spark, d):
    return job.jobs_rollup(job_stats(spark, d))


@query("status_labels", """WITH s AS (SELECT event_id, CASE event_id % 13 WHEN 0 THEN '' WHEN 1 THEN 'Status.REJECTED' WHEN 2 THEN 'job failed' WHEN 3 THEN 'CANCELED'
 WHEN 4 THEN 'abandoned' WHEN 5 THEN 'Skipped ok' WHEN 6 THEN 'success' WHEN 7 THEN 'is running' WHEN 8 THEN 'BLOCKED' WHEN 9 THEN 'pending' WHEN 10 THEN 'submit' WHEN 11 THEN event_type END AS raw FROM events)
SELECT event_id, CASE WHEN coalesce(trim(raw), '') = '' THEN '—' WHEN raw ILIKE '%reject%' THEN 'Rejected' WHEN raw ILIKE '%fail%' OR raw ILIKE '%error%' THEN 'Failed'
 WHEN raw ILIKE '%cancel%' THEN 'Cancelled' WHEN raw ILIKE '%abandon%' THEN 'Abandoned' WHEN raw ILIKE '%skip%' THEN 'Skipped' WHEN raw ILIKE '%success%' THEN 'Completed'
 WHEN raw ILIKE '%run%' THEN 'Running' WHEN raw ILIKE '%block%' THEN 'Blocked' WHEN raw ILIKE '%pend%' THEN 'Pending' ELSE 'Submitted' END AS label FROM s""")
def _(spark, d):
    s = table(spark, d, "events").selectExpr("event_id", """CASE event_id % 13 WHEN 0 THEN '' WHEN 1 THEN 'Status.REJECTED' WHEN 2 THEN 'job failed'
        WHEN 3 THEN 'CANCELED' WHEN 4 THEN 'abandoned' WHEN 5 THEN 'Skipped ok' WHEN 6 THEN 'success' WHEN 7 THEN 'is running' WHEN 8 THEN 'BLOCKED'
        WHEN 9 THEN 'pending' WHEN 10 THEN 'submit' WHEN 11 THEN event_type END AS raw""")
    return s.select("event_id", job.status_label(F.col("raw")).alias("label"))


@query("error_feed", "WITH " + JOB_STATS_SQL + ", " + AUDIT_SQL + """
SELECT job_id, finished_at AS "at", 'processor' AS source, n_failed || ' chunks failed' AS details, 'warning' AS severity FROM job_stats WHERE n_failed > 0
UNION ALL SELECT resource_id, "timestamp", 'audit', details, severity FROM audit WHERE resource_type = 'job'""")
def _(spark, d):
    return job.error_feed(job_stats(spark, d), audit(spark, d))


_DONE = "WITH " + JOB_STATS_SQL + ", " + CARDS_SQL + """,
hit AS (SELECT c.id AS card_id, c.job_id, c.priority, file_name, "operator", duration_s, sha256(c.job_id || '|' || c.id) AS session_id
 FROM cards c JOIN job_stats j ON j.job_id = c.job_id AND j.status = 'done' WHERE c.status = 'in_progress')"""


@query("completed_job_cards", _DONE + """ SELECT card_id, 'review' AS status, session_id,
 CASE priority WHEN 'critical' THEN 'critical' WHEN 'high' THEN 'warning' ELSE 'info' END AS severity,
 'Auto-moved to review after job ' || substr(job_id, 1, 8) || ' completed' AS details FROM hit""")
def _(spark, d):
    return job.complete_jobs(job_stats(spark, d), cards(spark, d))[0]


@query("completed_job_sessions", _DONE + """ SELECT session_id AS id, 'File job ' || substr(job_id, 1, 8) || ' — ' || file_name AS title, "operator",
 'file' AS source_type, file_name, card_id AS pipeline_card_id, duration_s * 1000.0 AS processing_ms,
 (SELECT string_agg(t.status || '=' || t.e, ',' ORDER BY t.status) FROM job_types t WHERE t.job_id = hit.job_id) AS entity_counts FROM hit""")
def _(spark, d):
    sessions = job.complete_jobs(job_stats(spark, d), cards(spark, d))[1]
    return sessions.withColumn("entity_counts", F.expr(
        "array_join(transform(map_entries(entity_counts), e -> concat(e.key, '=', string(e.value))), ',')"))


@query("scenario_status", "WITH " + JOB_EVENTS_SQL + """,
s AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE 'job-' || (c_custkey % 400) END AS scenario_id FROM customer),
l AS (SELECT job_id, arg_max(status, (ts, seq)) AS st FROM job_events GROUP BY 1)
SELECT c_custkey, scenario_id, CASE WHEN scenario_id = '' THEN '—' ELSE coalesce(CASE st WHEN 'completed' THEN 'done' ELSE st END, 'submitted') END AS job_status
FROM s LEFT JOIN l ON l.job_id = s.scenario_id""")
def _(spark, d):
    scenarios = table(spark, d, "customer").selectExpr(
        "c_custkey", "IF(c_custkey % 10 = 0, '', concat('job-', c_custkey % 400)) AS scenario_id")
    runs = job_events(spark, d).withColumnRenamed("job_id", "scenario_id")
    return job.scenario_status(scenarios, runs).select("c_custkey", "scenario_id", "job_status")
