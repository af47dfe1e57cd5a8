"""Queries for the change feed, record lists, filters and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import when
from ..operators import filters as flt
from ..operators import records as rec
from ..plans.shared import work_dir
from .base import STATEMENTS, query
from .derived import (APPTS_SQL, AS_OF_EVENTS, AS_OF_ORDERS, AUDIT_SQL, CARDS_SQL, FEED_FIELDS, FEED_SQL, appointments, audit,
                      cards, change_feed, sessions, sessions_sql, table)

CARDS, APPTS, AUDIT, FEED = ("WITH " + s for s in (CARDS_SQL, APPTS_SQL, AUDIT_SQL, FEED_SQL))

# --- change feed -----------------------------------------------------------

_STATE = FEED + """,
last AS (SELECT id, max(put_seq) AS put_seq, max(del_seq) AS del_seq FROM lives GROUP BY id),
live AS (SELECT l.* FROM feed l JOIN last USING (id) WHERE last.put_seq > coalesce(last.del_seq, -1) AND l.seq >= last.put_seq)"""


@query("current_state", _STATE + """
SELECT id, arg_max(new_title, seq) FILTER (WHERE op = 'put') AS title,
 arg_max(stage, seq) FILTER (WHERE event_type IN ('signup', 'view')) AS status,
 arg_max(new_user, seq) FILTER (WHERE event_type IN ('signup', 'click')) AS assignee,
 CASE arg_max(event_type, seq) FILTER (WHERE event_type IN ('signup', 'click', 'purchase')) WHEN 'purchase' THEN arg_max(new_note, seq) FILTER (WHERE event_type = 'purchase') END AS note,
 arg_max(ts, seq) AS updated_at FROM live GROUP BY id""")
def _(spark, d):
    return rec.current_state(change_feed(spark, d), FEED_FIELDS)


@query("snapshot_and_deltas", lambda: STATEMENTS["current_state"])
def _(spark, d):
    """The feed in three parts that overlap in time, the first of them twice: the answer of the full replay."""
    feed = change_feed(spark, d)
    third = F.pmod(F.floor(F.col("seq") / 1000), F.lit(3))
    path = work_dir(spark, "snapshot")
    for part in (0, 2, 0, 1):
        rec.apply_changes(path, feed.where(third == part), FEED_FIELDS)
    return rec.read_snapshot(spark, path, FEED_FIELDS)


@query("upsert_last_write", "SELECT user_id AS id, max(event_id) AS seq, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events").selectExpr("user_id AS id", "event_id AS seq", "event_type", "value")
    return rec.upsert(e)


@query("deleted_ids", FEED + """ SELECT id, max(del_seq) AS deleted_seq FROM lives GROUP BY id
HAVING max(del_seq) IS NOT NULL AND max(del_seq) > coalesce(max(put_seq), -1)""")
def _(spark, d):
    feed = change_feed(spark, d)
    seen = feed.where("op = 'delete'").groupBy("id").agg(F.max("seq").alias("deleted_seq"))
    return seen.join(rec.current_state(feed, ["status"]).select("id"), "id", "left_anti").join(
        feed.where("op = 'put'").groupBy("id").agg(F.max("seq").alias("p")), "id", "left").where(
        "p IS NULL OR deleted_seq > p").drop("p")


_CHANGES = FEED + """,
st AS (SELECT *, CASE WHEN op = 'put' OR event_type = 'view' THEN stage WHEN op = 'delete' THEN '' END AS status FROM lives),
pv AS (SELECT *, last_value(status IGNORE NULLS) OVER b AS prev_status,
  last_value(CASE WHEN op = 'put' THEN new_title WHEN op = 'delete' THEN '' END IGNORE NULLS) OVER b AS prev_title,
  coalesce(put_before > coalesce(del_before, -1), false) AS alive
  FROM st WINDOW b AS (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("done_times", _CHANGES + """,
fin AS (SELECT id, max(put_seq) AS p, max(del_seq) AS dl, arg_max(status, seq) FILTER (WHERE status IS NOT NULL) AS status,
 arg_max(ts, seq) FILTER (WHERE status = 'done' AND (op = 'put' OR (alive AND coalesce(prev_status, '') <> 'done'))) AS done_ts FROM pv GROUP BY id)
SELECT id, status, CASE WHEN status = 'done' THEN done_ts END AS done_at FROM fin WHERE p > coalesce(dl, -1)""")
def _(spark, d):
    return rec.done_times(change_feed(spark, d))


@query("audit_from_feed", _CHANGES + """
SELECT seq, ts AS "timestamp", 'system' AS actor, 'pipeline.create' AS action, 'card' AS resource_type, id AS resource_id,
 'Created card ''' || new_title || ''' in ''' || stage || '''' AS details, 'info' AS severity FROM pv WHERE op = 'put'
UNION ALL SELECT seq, ts, 'system', 'pipeline.move', 'card', id, 'Moved ''' || prev_title || ''' from ''' || prev_status || ''' → ''' || status || '''', 'info'
 FROM pv WHERE op = 'patch' AND alive AND status IS NOT NULL AND status <> prev_status
UNION ALL SELECT seq, ts, 'system', 'compliance.attest', 'card', id, 'Attested by ''' || new_user || '''', 'info' FROM pv WHERE op = 'patch' AND alive AND event_type = 'purchase'
UNION ALL SELECT seq, ts, 'system', 'pipeline.delete', 'card', id, 'Deleted ''' || prev_title || '''', 'warning' FROM pv WHERE op = 'delete' AND alive""")
def _(spark, d):
    return rec.audit_from_feed(change_feed(spark, d), "card")


@query("audit_from_feed_appointments", _CHANGES + """
SELECT seq, 'schedule.create' AS action, id AS resource_id, 'Scheduled ''' || new_title || ''' for ' AS details, 'info' AS severity FROM pv WHERE op = 'put'
UNION ALL SELECT seq, 'schedule.update', id, 'Updated ''' || prev_title || ''': ' || CASE event_type WHEN 'view' THEN 'status' WHEN 'click' THEN 'assignee, note'
 WHEN 'purchase' THEN 'attested, attested_by, note' ELSE '' END, 'info' FROM pv WHERE op = 'patch' AND alive
UNION ALL SELECT seq, 'schedule.delete', id, 'Deleted ''' || prev_title || '''', 'warning' FROM pv WHERE op = 'delete' AND alive""")
def _(spark, d):
    return rec.audit_from_feed(change_feed(spark, d), "appointment").select("seq", "action", "resource_id", "details", "severity")


@query("audit_from_feed_sessions", _CHANGES + """
SELECT seq, 'pii.anonymize' AS action, id AS resource_id, 'Anonymized 0 entities using ''replace''' AS details FROM pv WHERE op = 'put'
UNION ALL SELECT seq, 'session.update', id, 'Updated session: ' || CASE event_type WHEN 'view' THEN 'status' WHEN 'click' THEN 'assignee, note'
 WHEN 'purchase' THEN 'attested, attested_by, note' ELSE '' END FROM pv WHERE op = 'patch' AND alive""")
def _(spark, d):
    return rec.audit_from_feed(change_feed(spark, d), "session").select("seq", "action", "resource_id", "details")


@query("severity_rules", """SELECT o_orderkey, CASE WHEN lower(trim(o_orderstatus)) IN ('info', 'warning', 'critical') THEN lower(o_orderstatus) ELSE 'info' END AS severity,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'warning' ELSE 'info' END AS priority_severity FROM orders""")
def _(spark, d):
    o = table(spark, d, "orders").selectExpr(
        "o_orderkey", "o_orderstatus AS severity",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'HIGH' ELSE 'low' END AS priority")
    return rec.with_severity(o).drop("priority")


# --- lists -----------------------------------------------------------------

@query("sessions_newest_first", lambda: sessions_sql() + ' SELECT id, created_at, "operator", total FROM sessions ORDER BY created_at DESC, id')
def _(spark, d):
    from ..operators.analytics import entities_in
    s = sessions(spark, d).withColumn("total", F.coalesce(entities_in(F.col("entity_counts")), F.lit(0)))
    return rec.sessions_newest_first(s).select("id", "created_at", "operator", "total")


@query("cards_latest_first", CARDS + " SELECT id, status, updated_at FROM cards ORDER BY updated_at DESC, id")
def _(spark, d):
    return rec.cards_latest_first(cards(spark, d)).select("id", "status", "updated_at")


@query("appointments_by_time", APPTS + " SELECT id, scheduled_for, status FROM appts ORDER BY scheduled_for NULLS FIRST, id")
def _(spark, d):
    return rec.appointments_by_time(appointments(spark, d)).select("id", "scheduled_for", "status")


@query("sessions_of_card", "SELECT CAST(doc_id AS VARCHAR) AS id, CAST(doc_id AS VARCHAR) AS pipeline_card_id FROM documents WHERE doc_id = 17")
def _(spark, d):
    return rec.sessions_of_card(sessions(spark, d), "17").select("id", "pipeline_card_id")


@query("sessions_per_card", CARDS + """ SELECT c.id AS card_id, CAST(doc_id AS VARCHAR) AS session_id, TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) AS created_at
 FROM cards c JOIN documents ON c.id = CAST(doc_id AS VARCHAR)""")
def _(spark, d):
    return rec.sessions_per_card(sessions(spark, d), cards(spark, d))


@query("entity_breakdown", lambda: sessions_sql() + " SELECT entity_type, CAST(sum(n) AS BIGINT) AS n FROM session_counts GROUP BY 1")
def _(spark, d):
    return rec.entity_breakdown(sessions(spark, d))


@query("global_stats", lambda: sessions_sql() + ", " + CARDS_SQL + """ SELECT (SELECT count(*) FROM sessions) AS total_sessions,
 (SELECT CAST(coalesce(sum(total), 0) AS BIGINT) FROM sessions) AS total_entities,
 count(*) FILTER (WHERE status = 'backlog') AS cards_backlog, count(*) FILTER (WHERE status = 'in_progress') AS cards_in_progress,
 count(*) FILTER (WHERE status = 'review') AS cards_review, count(*) FILTER (WHERE status = 'done') AS cards_done,
 (SELECT count(*) FROM orders) AS total_appointments, (SELECT count(*) FROM events) AS total_audit_entries,
 count(*) FILTER (WHERE attested) AS attested_cards FROM cards""")
def _(spark, d):
    return rec.global_stats(sessions(spark, d), cards(spark, d), appointments(spark, d), audit(spark, d))


@query("cards_per_status", CARDS + """ SELECT list_position(['backlog','in_progress','review','done'], status) AS "position", status, count(*) AS n FROM cards GROUP BY status""")
def _(spark, d):
    return rec.count_cards_by_status(cards(spark, d))


@query("cards_in_review", CARDS + " SELECT id, title, updated_at FROM cards WHERE status = 'review'")
def _(spark, d):
    return rec.cards_latest_first(cards(spark, d), "review").select("id", "title", "updated_at")


@query("upcoming_appointments", APPTS + f" SELECT id, scheduled_for FROM appts WHERE status = 'scheduled' AND scheduled_for >= TIMESTAMP '{AS_OF_ORDERS}' ORDER BY scheduled_for, id LIMIT 5")
def _(spark, d):
    return rec.upcoming(appointments(spark, d), AS_OF_ORDERS).select("id", "scheduled_for")


@query("latest_audit", AUDIT + ' SELECT id, "timestamp", action, severity FROM audit ORDER BY "timestamp" DESC, id DESC LIMIT 200')
def _(spark, d):
    return rec.latest_audit(audit(spark, d)).select("id", "timestamp", "action", "severity")


@query("retained_audit", AUDIT + f' SELECT id, "timestamp" FROM audit ORDER BY "timestamp" DESC, id DESC LIMIT {fv.AUDIT_RETENTION_ROWS}')
def _(spark, d):
    return rec.retain_newest(audit(spark, d)).select("id", "timestamp")


@query("retained_audit_bytes", AUDIT + """, s AS (SELECT id, "timestamp", octet_length(encode(id || actor || details)) AS b FROM audit)
, r AS (SELECT *, sum(b) OVER (ORDER BY "timestamp" DESC, id DESC ROWS UNBOUNDED PRECEDING) AS total, row_number() OVER (ORDER BY "timestamp" DESC, id DESC) AS k FROM s)
SELECT id, "timestamp" FROM r WHERE total <= 80000 AND k <= 2500""")
def _(spark, d):
    size = F.octet_length(F.concat("id", "actor", "details"))
    return rec.retain_newest(audit(spark, d), rows=2_500, max_bytes=80_000, size=size).select("id", "timestamp")


@query("session_link_violations", CARDS + " SELECT session_id, count(*) AS n_cards, min(id) AS first_card FROM cards WHERE session_id <> '' GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return rec.session_link_violations(cards(spark, d))


@query("stage_steps", CARDS + """ SELECT id, (['in_progress','review','done','done'])[list_position(['backlog','in_progress','review','done'], status)] AS next_stage,
 (['backlog','backlog','in_progress','review'])[list_position(['backlog','in_progress','review','done'], status)] AS previous_stage FROM cards""")
def _(spark, d):
    return cards(spark, d).select("id", rec.stage_after(F.col("status")).alias("next_stage"),
                                  rec.stage_before(F.col("status")).alias("previous_stage"))


# --- filters and counts ----------------------------------------------------

@query("time_window_cutoffs", """SELECT event_id, ts >= TIMESTAMP '2024-01-20 00:00:00' AS in_today, ts >= TIMESTAMP '2024-01-13 12:00:00' AS in_week,
 ts >= TIMESTAMP '2023-12-21 12:00:00' AS in_month, true AS in_all FROM events""")
def _(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", *[when.in_window(F.col("ts"), w, AS_OF_EVENTS).alias(f"in_{w}")
                                  for w in ("today", "week", "month", "all")])


@query("parsed_moments", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - INTERVAL 2 HOUR WHEN 2 THEN date_trunc('second', ts) END AS moment FROM events""")
def _(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", """concat(CASE event_id % 4 WHEN 3 THEN 'bad ' ELSE '' END,
        date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), CASE event_id % 4 WHEN 0 THEN 'Z' WHEN 1 THEN '+02:00' ELSE '' END) AS raw""")
    return e.select("event_id", when.parse_moment(F.col("raw")).alias("moment"))


@query("filter_audit", AUDIT + f""" SELECT id, "timestamp", details FROM audit WHERE severity = 'warning' AND (contains(lower(action), 'user 1') OR contains(lower(details), 'user 1'))
 AND "timestamp" >= TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL 7 DAY AND resource_type = 'card'""")
def _(spark, d):
    return flt.filter_audit(audit(spark, d), severity="Warning", text="USER 1", window="week", resource_type="card",
                            as_of=AS_OF_EVENTS).select("id", "timestamp", "details")


@query("filter_audit_resource", AUDIT + " SELECT id FROM audit WHERE resource_id = '42'")
def _(spark, d):
    return flt.filter_audit(audit(spark, d), resource_id="42", severity="all").select("id")


@query("count_by_severity", AUDIT + """ SELECT list_position(['info','warning','critical'], severity) AS "position", severity, count(*) AS n FROM audit GROUP BY severity""")
def _(spark, d):
    return flt.count_by_severity(audit(spark, d))


@query("appointments_with_status", APPTS + " SELECT id FROM appts WHERE status = 'cancelled'")
def _(spark, d):
    return flt.appointments_by_status(appointments(spark, d), "Cancelled").select("id")


@query("appointments_between", APPTS + " SELECT id, scheduled_for FROM appts WHERE scheduled_for BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'")
def _(spark, d):
    return flt.appointments_between(appointments(spark, d), "1997-01-01", "1997-12-31").select("id", "scheduled_for")


@query("scheduled_appointments", APPTS + " SELECT id FROM appts WHERE status = 'scheduled'")
def _(spark, d):
    return flt.scheduled_appointments(appointments(spark, d)).select("id")


@query("cards_with_priority", CARDS + " SELECT id FROM cards WHERE priority = 'high'")
def _(spark, d):
    return flt.cards_by_priority(cards(spark, d), "HIGH").select("id")


@query("count_by_priority", CARDS + """ SELECT list_position(['low','medium','high','critical'], priority) AS "position", priority, count(*) AS n FROM cards GROUP BY priority""")
def _(spark, d):
    return flt.count_by_priority(cards(spark, d))


@query("cards_with_status", CARDS + " SELECT id FROM cards WHERE status = 'in_progress'")
def _(spark, d):
    return flt.cards_with_status(cards(spark, d), "in_progress").select("id")


@query("attested_cards", CARDS + " SELECT id, attested_by FROM cards WHERE attested")
def _(spark, d):
    return flt.attested_cards(cards(spark, d)).select("id", "attested_by")


@query("sessions_in_window", f"SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) >= TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL 7 DAY")
def _(spark, d):
    return flt.sessions_in_window(sessions(spark, d), "week", AS_OF_EVENTS).select("id")


@query("sessions_with_entities", lambda: sessions_sql() + " SELECT DISTINCT id FROM session_counts WHERE entity_type IN ('EMAIL_ADDRESS', 'IP_ADDRESS')")
def _(spark, d):
    return flt.sessions_with_entities(sessions(spark, d), ["EMAIL_ADDRESS", "IP_ADDRESS"]).select("id")


@query("sessions_with_listed_entities", lambda: sessions_sql() + " SELECT DISTINCT id FROM session_counts WHERE entity_type IN ('PHONE_NUMBER', 'CREDIT_CARD')")
def _(spark, d):
    types = table(spark, d, "region").selectExpr("IF(r_regionkey % 2 = 0, 'PHONE_NUMBER', 'CREDIT_CARD') AS entity_type")
    return flt.sessions_with_listed_entities(sessions(spark, d), types).select("id")


@query("count_by_operator", """SELECT CASE WHEN doc_id % 5 = 0 THEN 'replace' ELSE (['replace','redact','mask','hash'])[doc_id % 4 + 1] END AS "operator", count(*) AS n FROM documents GROUP BY 1""")
def _(spark, d):
    s = table(spark, d, "documents").selectExpr(
        "IF(doc_id % 5 = 0, ' ', element_at(array('replace', 'redact', 'mask', 'hash'), int(doc_id % 4 + 1))) AS operator")
    return flt.count_by_operator(s)


@query("filter_by_predicate", CARDS + " SELECT id FROM cards WHERE attested AND priority = 'critical'")
def _(spark, d):
    return flt.filter_by(cards(spark, d), F.col("attested") & (F.col("priority") == "critical")).select("id")


@query("group_by_key", """WITH n AS (SELECT event_type AS "key", count(*) AS c FROM events GROUP BY 1)
SELECT n."key", CAST(ceil(c / 1000.0) AS INTEGER) AS n_parts, event_id AS member FROM n JOIN events ON event_type = n."key" """)
def _(spark, d):
    parts = flt.group_by(table(spark, d, "events"), F.col("event_type"), "event_id", chunk_rows=1000)
    return parts.select("key", "n_parts", F.explode("members").alias("member"))


@query("count_by_key", """SELECT o_orderpriority || '/' || o_orderstatus AS "key", count(*) AS n FROM orders GROUP BY 1""")
def _(spark, d):
    return flt.count_by(table(spark, d, "orders"), F.concat_ws("/", "o_orderpriority", "o_orderstatus"))
