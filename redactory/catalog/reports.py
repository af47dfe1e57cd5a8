"""Queries for reports, places, telemetry and attestation."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fv
from .. import registry as reg
from ..functions import text as tx
from ..operators import analytics as an
from ..operators import attestation as att
from ..operators import geo, telemetry as tel
from ..operators.detect import detect, detections
from ..plans.spread import spread
from ..policy import Policy
from . import duck
from .base import query
from .derived import (APPTS_SQL, AS_OF_EVENTS, AS_OF_ORDERS, AUDIT_SQL, CARDS_SQL, JOB_EVENTS_SQL, MOVES_SQL, appointments,
                      audit, cards, job_events, move_audit, sessions, sessions_sql, table)
from .planted import PLANTED_SQL, planted

CARDS, AUDIT, JOBS = ("WITH " + s for s in (CARDS_SQL, AUDIT_SQL, JOB_EVENTS_SQL))
ALL = Policy()

# --- cards -----------------------------------------------------------------

_STAGES = "['backlog','in_progress','review','done']"


@query("stage_distribution", CARDS + f""" SELECT list_position({_STAGES}, status) AS "position", status, count(*) AS n,
 round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM cards), 1) AS share_pct FROM cards GROUP BY status""")
def _(spark, d):
    return an.stage_distribution(cards(spark, d))


@query("stage_funnel", CARDS + f""" SELECT list_position({_STAGES}, status) AS "position", status, count(*) AS n FROM cards GROUP BY status""")
def _(spark, d):
    return an.funnel(cards(spark, d))


@query("completion", CARDS + """ SELECT CAST(round_even(count(*) FILTER (WHERE status = 'done') * 100.0 / count(*), 0) AS INTEGER) AS completion_pct,
 count(*) FILTER (WHERE status IN ('in_progress', 'review')) AS in_flight, count(*) FILTER (WHERE status = 'backlog') AS backlog FROM cards""")
def _(spark, d):
    return an.completion(cards(spark, d))


@query("priority_counts", CARDS + """ SELECT list_position(['critical','high','medium','low'], priority) AS "position", priority, count(*) AS n FROM cards GROUP BY priority""")
def _(spark, d):
    return an.priority_counts(cards(spark, d))


@query("board_summary", CARDS + """ SELECT count(*) AS total, count(*) FILTER (WHERE status <> 'done') AS "open", count(*) FILTER (WHERE status = 'done') AS done,
 count(*) FILTER (WHERE attested) AS attested, count(*) FILTER (WHERE status = 'backlog' AND priority IN ('high', 'critical')) AS high_priority_backlog,
 max(updated_at) AS latest_update FROM cards""")
def _(spark, d):
    return an.board_summary(cards(spark, d))


@query("parse_moves", "WITH " + MOVES_SQL + """ SELECT resource_id, details,
 CASE WHEN details LIKE 'Moved %' THEN 'review' WHEN details LIKE 'moved in%' THEN 'in_progress' WHEN details LIKE 'Done to%' THEN 'done'
      WHEN details LIKE 'backlog%' THEN 'backlog' WHEN details LIKE 'Set from%' THEN 'review' END AS from_status,
 CASE WHEN details LIKE 'Moved %' THEN 'done' WHEN details LIKE 'moved in%' THEN 'done' WHEN details LIKE 'Done to%' THEN 'review'
      WHEN details LIKE 'backlog%' THEN 'in_progress' WHEN details LIKE 'Set from%' THEN 'done' END AS to_status FROM moves""")
def _(spark, d):
    m = move_audit(spark, d).select("resource_id", "details", an.parse_move("details").alias("m"))
    return m.select("resource_id", "details", "m.from_status", "m.to_status")


@query("burndown", CARDS + ", " + MOVES_SQL + f""",
mv AS (SELECT resource_id AS id, greatest(m."timestamp", c.created_at) AS ts, CASE WHEN details LIKE 'Done to%' THEN 1 ELSE -1 END AS delta
  FROM moves m JOIN cards c ON c.id = m.resource_id WHERE details NOT LIKE 'backlog%' AND details NOT LIKE 'nothing%'),
ev AS (SELECT created_at AS ts, 1 AS delta FROM cards UNION ALL SELECT ts, delta FROM mv
  UNION ALL SELECT greatest(coalesce(done_at, updated_at), created_at), -1 FROM cards WHERE status = 'done' AND id NOT IN (SELECT id FROM mv)),
net AS (SELECT ts, sum(delta) AS delta FROM ev GROUP BY ts),
run AS (SELECT ts, sum(delta) OVER (ORDER BY ts) AS s FROM net),
cl AS (SELECT ts, s - least(0, min(s) OVER (ORDER BY ts)) AS remaining FROM run),
op AS (SELECT count(*) FILTER (WHERE status <> 'done') AS n FROM cards),
pts AS (SELECT ts, remaining FROM cl UNION ALL SELECT TIMESTAMP '{AS_OF_ORDERS}', NULL WHERE (SELECT max(ts) FROM cl) < TIMESTAMP '{AS_OF_ORDERS}'),
fr AS (SELECT min(ts) AS a, max(ts) AS z, arg_min(remaining, ts) AS r0 FROM pts)
SELECT ts, CAST(CASE WHEN ts = z THEN (SELECT n FROM op) ELSE remaining END AS BIGINT) AS remaining,
 greatest(0.0::DOUBLE, round(r0 * (1 - date_diff('second', a, ts)::DOUBLE / date_diff('second', a, z)), 2)) AS ideal FROM pts, fr""")
def burndown(spark, d):
    return an.burndown(cards(spark, d), move_audit(spark, d), AS_OF_ORDERS)


@query("table_signature", CARDS + """ SELECT count(*) AS "rows", CAST(sum(CAST('0x' || substr(md5(concat_ws('|', id, status, CAST(created_at AS VARCHAR),
 CAST(updated_at AS VARCHAR), coalesce(CAST(done_at AS VARCHAR), '<null>'))), 1, 8) AS BIGINT)) AS BIGINT) AS checksum FROM cards""")
def _(spark, d):
    return an.table_signature(cards(spark, d), ["id", "status", "created_at", "updated_at", "done_at"])


@query("appointment_cards", CARDS + ", " + APPTS_SQL + " SELECT a.id, a.scheduled_for, coalesce(c.title, '—') AS card_title FROM appts a LEFT JOIN cards c ON c.id = a.pipeline_card_id")
def _(spark, d):
    return an.appointment_cards(appointments(spark, d), cards(spark, d)).select("id", "scheduled_for", "card_title")


@query("card_history", CARDS + ", " + AUDIT_SQL + """ SELECT resource_id AS card_id, id AS audit_id, "timestamp", action, actor, details
 FROM audit WHERE resource_type = 'card' AND resource_id IN (SELECT id FROM cards)""")
def _(spark, d):
    return an.card_history(audit(spark, d), cards(spark, d))


@query("card_sessions", CARDS + """, s AS (SELECT CAST(doc_id AS VARCHAR) AS id FROM documents)
SELECT c.id AS card_id, s.id AS session_id FROM cards c JOIN s ON s.id = c.id UNION SELECT c.id, s.id FROM cards c JOIN s ON s.id = c.session_id""")
def _(spark, d):
    return an.card_sessions(sessions(spark, d), cards(spark, d))


# --- entities --------------------------------------------------------------

_SHARES = """, b AS (SELECT entity_type, CAST(sum(n) AS BIGINT) AS n FROM session_counts GROUP BY 1),
r AS (SELECT entity_type, n, CAST(row_number() OVER o AS INTEGER) AS "position", round(n * 100.0::DOUBLE / sum(n) OVER (), 1) AS share_pct,
 round(sum(n) OVER (ORDER BY n DESC, entity_type ROWS UNBOUNDED PRECEDING) * 100.0::DOUBLE / sum(n) OVER (), 1) AS cumulative_pct,
 round(max(n) OVER () * 100.0::DOUBLE / sum(n) OVER (), 1) AS dominance_pct FROM b WINDOW o AS (ORDER BY n DESC, entity_type))"""


@query("top_entities", lambda: sessions_sql() + _SHARES + ' SELECT "position", entity_type, n AS detections, share_pct, dominance_pct FROM r WHERE "position" <= 8')
def _(spark, d):
    return an.top_entities(sessions(spark, d))


@query("entity_pareto", lambda: sessions_sql() + _SHARES + ' SELECT "position", entity_type, n, share_pct, cumulative_pct FROM r WHERE "position" <= 10')
def _(spark, d):
    return an.pareto(sessions(spark, d))


def _severity_query(window: str, days: int | None) -> None:
    limit = f""" WHERE "timestamp" >= TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL {days} DAY""" if days else ""

    @query(f"severity_{window.lower()}", AUDIT + f""" SELECT list_position(['info','warning','critical'], v) AS "position", v AS severity,
 (SELECT count(*) FROM (SELECT severity FROM audit{limit}) a WHERE a.severity = v) AS n FROM (SELECT unnest(['info','warning','critical']) AS v) q""")
    def _(spark, d):
        return an.severity_counts(audit(spark, d), window, AS_OF_EVENTS)


for _w, _n in (("24h", 1), ("7d", 7), ("30d", 30), ("All", None)):
    _severity_query(_w, _n)


@query("daily_trend", lambda: sessions_sql() + """ SELECT CAST(created_at AS DATE) AS "day", count(*) AS sessions, CAST(sum(total) AS BIGINT) AS entities FROM sessions GROUP BY 1""")
def _(spark, d):
    return an.daily_trend(sessions(spark, d))


@query("last_active_days", lambda: sessions_sql() + """ SELECT CAST(created_at AS DATE) AS "day", count(*) AS sessions, CAST(sum(total) AS BIGINT) AS entities FROM sessions GROUP BY 1 ORDER BY 1 DESC LIMIT 7""")
def _(spark, d):
    return an.last_active_days(sessions(spark, d))


@query("processing_time", """WITH s AS (SELECT doc_id, n_chars / 10.0::DOUBLE AS ms FROM documents WHERE n_chars > 0),
a AS (SELECT count(*) AS n, sum(n_chars) / 10.0::DOUBLE / count(*) AS mean, max(n_chars) / 10.0::DOUBLE AS top FROM documents WHERE n_chars > 0)
SELECT n, round(mean, 1) AS mean_ms, round((SELECT arg_max(ms, doc_id) FROM s) - mean, 1) AS newest_vs_mean,
 greatest(50.0::DOUBLE, top * 1.2::DOUBLE) AS axis_max, CASE WHEN mean < 50 THEN 'fast' WHEN mean < 200 THEN 'normal' ELSE 'slow' END AS band FROM a""")
def _(spark, d):
    return an.processing_time(sessions(spark, d))


@query("recent_processing", """SELECT CAST(doc_id AS VARCHAR) AS id, TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) AS created_at, n_chars / 10.0::DOUBLE AS processing_ms
FROM documents WHERE n_chars > 0 ORDER BY doc_id DESC LIMIT 12""")
def _(spark, d):
    return an.recent_processing(sessions(spark, d))


# --- evidence --------------------------------------------------------------

def evidence(spark, d, explain=True):
    """Without ``explain`` neither recogniser nor rationale is written, for reports that show none."""
    spans = detect(planted(spark, d).select("order_id", "note"), "note", ALL.but(explain=explain), dense=True)
    return an.evidence_rows(detections(spans, "order_id"), "order_id")


def _evidence_sql(tail: str) -> str:
    return duck.spans_ctes("planted", "order_id", "note", ALL).replace("WITH src", f"WITH {PLANTED_SQL}, src", 1) + """,
ev0 AS (SELECT k AS order_id, entity_type, x AS "text", CAST(round_even(score * 100, 0) AS INTEGER) AS confidence, s || '–' || e AS span, recognizer, rationale FROM spans),
ev AS (SELECT *, CASE WHEN confidence >= 90 THEN 'Very High' WHEN confidence >= 75 THEN 'High' WHEN confidence >= 60 THEN 'Medium' ELSE 'Low' END AS band FROM ev0)
""" + tail


@query("evidence_rows", lambda: _evidence_sql('SELECT order_id, entity_type, "text", confidence, band, span, recognizer, rationale FROM ev'))
def _(spark, d):
    return evidence(spark, d)


_TYPES = list(dict.fromkeys(r.entity for r in reg.REGISTRY))


@query("recogniser_crosstab", lambda: _evidence_sql("SELECT recognizer, " + ", ".join(
    f"count(*) FILTER (WHERE entity_type = '{t}') AS {t}" for t in _TYPES) + " FROM ev GROUP BY 1"))
def _(spark, d):
    return an.recogniser_crosstab(evidence(spark, d), _TYPES)


@query("confidence_distribution", lambda: _evidence_sql("""
, q AS (SELECT entity_type, count(*) AS n, min(confidence) AS low, max(confidence) AS high, CAST(quantile_cont(confidence, 0.25) AS DOUBLE) AS q1,
 CAST(quantile_cont(confidence, 0.5) AS DOUBLE) AS median, CAST(quantile_cont(confidence, 0.75) AS DOUBLE) AS q3 FROM ev GROUP BY 1)
SELECT q.entity_type, n, low, high, q1, median, q3, min(confidence) AS whisker_low, max(confidence) AS whisker_high FROM q JOIN ev ON ev.entity_type = q.entity_type
 AND confidence BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL"""))
def _(spark, d):
    return an.confidence_distribution(evidence(spark, d, explain=False))


@query("confidence_histogram", lambda: _evidence_sql("SELECT entity_type, CAST(least(confidence // 10, 9) AS INTEGER) AS bin, count(*) AS n FROM ev GROUP BY 1, 2"))
def _(spark, d):
    return an.confidence_histogram(evidence(spark, d, explain=False))


@query("confidence_density", lambda: _evidence_sql("""
, c AS (SELECT entity_type, confidence, count(*) AS n FROM ev GROUP BY 1, 2), g AS (SELECT CAST(unnest(range(0, 101, 5)) AS INTEGER) AS "at")
SELECT entity_type, "at", round(sum(n * exp(-((("at" - confidence) / 5.0::DOUBLE) ** 2) / 2)) / (sum(n) * 5.0::DOUBLE * sqrt(2 * pi())), 6) AS density
 FROM c CROSS JOIN g GROUP BY 1, 2"""))
def _(spark, d):
    return an.confidence_density(evidence(spark, d, explain=False))


@query("confidence_kpis", lambda: _evidence_sql("""
, p AS (SELECT order_id, count(*) AS total, CAST(round_even(CAST(sum(confidence) AS DOUBLE) / count(*), 0) AS INTEGER) AS mean_confidence, count(*) FILTER (WHERE band = 'Very High') AS very_high,
 count(*) FILTER (WHERE band = 'High') AS high, count(*) FILTER (WHERE band = 'Medium') AS medium, count(*) FILTER (WHERE band = 'Low') AS low FROM ev GROUP BY 1)
SELECT *, CASE greatest(very_high, high, medium, low) WHEN very_high THEN 'Very High' WHEN high THEN 'High' WHEN medium THEN 'Medium' ELSE 'Low' END AS dominant_band FROM p"""))
def _(spark, d):
    return an.confidence_kpis(evidence(spark, d, explain=False), "order_id")


@query("type_summary", lambda: _evidence_sql("""
, c AS (SELECT order_id, entity_type, count(*) AS n FROM ev GROUP BY 1, 2)
SELECT order_id, CAST(sum(n) AS BIGINT) AS total, string_agg(n || 'x ' || entity_type, ', ' ORDER BY n DESC, entity_type) AS breakdown FROM c GROUP BY 1"""))
def _(spark, d):
    return an.type_summary(evidence(spark, d, explain=False), "order_id")


@query("kpi_changes", """WITH s AS (SELECT event_type, CAST(ts AS DATE) AS "day", count(*) AS n FROM events GROUP BY 1, 2),
l AS (SELECT *, n - lag(n) OVER (PARTITION BY event_type ORDER BY "day") AS delta FROM s)
SELECT event_type, "day", n, delta, n || CASE WHEN delta > 0 THEN ' (+' || delta || ')' WHEN delta < 0 THEN ' (' || delta || ')' ELSE ' (=)' END AS label FROM l""")
def _(spark, d):
    e = table(spark, d, "events")
    daily = e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return an.kpi_changes(daily, "day", "n", ["event_type"])


def _mode_query(mode: str, columns: str, source: str = "cards") -> None:
    @query(f"report_{mode}", lambda: sessions_sql() + ", " + CARDS_SQL + f" SELECT {columns} FROM {source}")
    def _(spark, d):
        return an.mode_report(sessions(spark, d), cards(spark, d), appointments(spark, d), audit(spark, d), mode)


_mode_query("operations", ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS cards_{s}" for s in fv.CARD_STATUSES))
_mode_query("compliance", "count(*) FILTER (WHERE attested) AS attested_cards, (SELECT count(*) FROM events) AS total_audit_entries, (SELECT count(*) FROM orders) AS total_appointments")
_mode_query("throughput", "(SELECT count(*) FROM sessions) AS total_sessions, "
            "(SELECT CAST(coalesce(sum(total), 0) AS BIGINT) FROM sessions) AS total_entities", "(SELECT 1 AS one) q")


# --- places ----------------------------------------------------------------

_PLACES = "places AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{c}', {la}::DOUBLE, {lo}::DOUBLE)" for i, (c, la, lo) in enumerate(fv.CITIES)) + ") v(pos, city, lat, lon))"
_ALIASES = "aliases AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{c}')" for a, c in fv.CITY_ALIASES) + ") v(alias, city))"
_TOKEN = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query("place_tokens", "SELECT doc_id, sha256(" + _TOKEN.format("text") + ") AS token_hash FROM documents")
def _(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.sha2(F.expr(tx.place_token("text")), 256).alias("token_hash"))


_TEXT_HITS = ("tk AS (SELECT order_id, ' ' || replace(" + _TOKEN.format("note") + """, ' ', '  ') || ' ' AS v FROM planted),
th AS (SELECT order_id, city, (length(v) - length(replace(v, ' ' || replace(city, ' ', '  ') || ' ', ''))) // (length(replace(city, ' ', '  ')) + 2) AS n FROM tk, places)""")
_RESOLVED = """pl AS (SELECT order_id, place AS v, """ + _TOKEN.format("place") + """ AS tok FROM planted),
cand AS (SELECT order_id, city, 1 AS rule, pos FROM pl JOIN places ON tok = city UNION ALL SELECT order_id, a.city, 2, 0 FROM pl JOIN aliases a ON tok = alias
 UNION ALL SELECT order_id, city, 3, pos FROM pl JOIN places ON split_part(tok, ' ', 1) = city
 UNION ALL SELECT order_id, city, 4, pos FROM pl, places WHERE contains(' ' || tok || ' ', ' ' || city || ' ')),
res AS (SELECT order_id, arg_min(city, (rule, pos)) AS city FROM cand GROUP BY 1)"""
_GEO = f"WITH {PLANTED_SQL}, {_PLACES}, {_ALIASES}, {_TEXT_HITS}, {_RESOLVED}"


@query("city_text_mentions", _GEO + " SELECT order_id, city, CAST(n AS BIGINT) AS n FROM th WHERE n > 0")
def _(spark, d):
    hits = geo.text_mentions(planted(spark, d).select("order_id", "note"), "order_id", "note", geo.cities(spark))
    return hits.groupBy("order_id", "city").agg(F.count(F.lit(1)).alias("n"))


@query("resolve_city", _GEO + " SELECT pl.order_id, pl.v AS place, res.city FROM pl LEFT JOIN res USING (order_id)")
def _(spark, d):
    return geo.resolve_city(planted(spark, d).select("order_id", "place"), "place", geo.cities(spark), geo.aliases(spark))


@query("resolve_city_large", _GEO + " SELECT pl.order_id, pl.v AS place, res.city FROM pl LEFT JOIN res USING (order_id)")
def _(spark, d):
    """The plan for place tables beyond the bound: here the bound is zero."""
    return geo.resolve_city(planted(spark, d).select("order_id", "place"), "place", geo.cities(spark), geo.aliases(spark),
                            max_rows=0)


def _geo_parts(spark, d):
    p = planted(spark, d)
    places = geo.cities(spark)
    hits = geo.text_mentions(p.select("order_id", "note"), "order_id", "note", places)
    spans = p.select(F.lit("GPE").alias("entity_type"), F.col("place").alias("text"))
    return hits, geo.entity_mentions(spans, places, geo.aliases(spark)), places


_GEO_COUNTS = _GEO + """, tc AS (SELECT city, CAST(sum(n) AS BIGINT) AS t FROM th WHERE n > 0 GROUP BY 1),
ec AS (SELECT res.city, count(*) AS e FROM pl LEFT JOIN res USING (order_id) GROUP BY 1),
gc AS (SELECT coalesce(tc.city, ec.city) AS city, coalesce(t, 0) AS text_mentions, coalesce(e, 0) AS entity_mentions, coalesce(t, 0) + coalesce(e, 0) AS mentions
 FROM tc FULL JOIN ec ON tc.city = ec.city)"""


@query("geo_counts", _GEO_COUNTS + " SELECT * FROM gc")
def _(spark, d):
    hits, entities, _ = _geo_parts(spark, d)
    return geo.geo_counts(hits, entities)


@query("map_rows", _GEO_COUNTS + " SELECT city, lat, lon, mentions FROM gc JOIN places USING (city)")
def _(spark, d):
    hits, entities, places = _geo_parts(spark, d)
    return geo.map_rows(geo.geo_counts(hits, entities), places)


@query("map_view", _GEO_COUNTS + """ SELECT min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon,
 (min(lat) + max(lat)) / 2 AS center_lat, (min(lon) + max(lon)) / 2 AS center_lon FROM gc JOIN places USING (city)""")
def _(spark, d):
    hits, entities, places = _geo_parts(spark, d)
    return geo.map_view(geo.map_rows(geo.geo_counts(hits, entities), places))


# --- telemetry -------------------------------------------------------------

_DUR = JOBS + """, du AS (SELECT job_id, min(ts) AS a, min(ts) FILTER (WHERE status IN ('completed', 'failed')) AS z FROM job_events GROUP BY 1),
dd AS (SELECT job_id, a AS created, z AS closed, date_diff('microsecond', a, z) / 1000000.0::DOUBLE AS duration_s FROM du WHERE z IS NOT NULL)"""


@query("job_transitions", JOBS + " SELECT upper(status) AS status, count(*) AS transitions FROM job_events GROUP BY 1")
def _(spark, d):
    return tel.status_transitions(job_events(spark, d))


@query("job_durations", _DUR + " SELECT * FROM dd")
def _(spark, d):
    return tel.job_durations(job_events(spark, d))


@query("duration_histogram", _DUR + ", b AS (SELECT unnest([5, 15, 30, 60, 120, 300, 600]) AS le, unnest(range(0, 7)) AS p) " + """
SELECT CAST(p AS INTEGER) AS "position", CAST(le AS VARCHAR) AS le, (SELECT count(*) FROM dd WHERE duration_s <= b.le) AS n FROM b
UNION ALL SELECT 7, '+Inf', count(*) FROM dd""")
def _(spark, d):
    return tel.duration_histogram(tel.job_durations(job_events(spark, d)))


@query("telemetry_totals", JOBS + """ SELECT count(DISTINCT job_id) AS jobs_created, count(*) FILTER (WHERE status IN ('completed', 'failed')) AS terminal_events,
 CAST(sum(entities) AS BIGINT) AS entities, CAST(sum("rows") AS BIGINT) AS "rows" FROM job_events""")
def _(spark, d):
    return tel.telemetry_totals(job_events(spark, d))


@query("queue_depth", JOBS + ", l AS (SELECT job_id, arg_max(upper(status), (ts, seq)) AS status FROM job_events GROUP BY 1) SELECT status, count(*) AS depth FROM l GROUP BY 1")
def _(spark, d):
    return tel.queue_depth(job_events(spark, d))


@query("queue_depth_over_time", JOBS + """, m AS (SELECT date_trunc('second', ts) AS ts, upper(status) AS status, lag(upper(status)) OVER (PARTITION BY job_id ORDER BY seq) AS prev FROM job_events),
u AS (SELECT ts, status, 1 AS dl FROM m UNION ALL SELECT ts, prev, -1 FROM m WHERE prev IS NOT NULL), g AS (SELECT status, ts, sum(dl) AS dl FROM u GROUP BY 1, 2)
SELECT status, ts, CAST(sum(dl) OVER (PARTITION BY status ORDER BY ts) AS BIGINT) AS depth FROM g""")
def _(spark, d):
    return tel.queue_depth_over_time(job_events(spark, d))


@query("job_rates", JOBS + """ SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, upper(status) AS status, count(*) AS n, round(count(*) / 300.0::DOUBLE, 6) AS per_second FROM job_events GROUP BY 1, 2""")
def _(spark, d):
    return tel.rates(job_events(spark, d))


@query("duration_quantiles", _DUR + """, ms AS (SELECT round(duration_s * 1000, 0) AS v FROM dd)
SELECT count(*) AS jobs, round(quantile_cont(v, 0.5) / 1000, 6) AS p50, round(quantile_cont(v, 0.95) / 1000, 6) AS p95, round(quantile_cont(v, 0.99) / 1000, 6) AS p99 FROM ms""")
def _(spark, d):
    return tel.duration_quantiles(tel.job_durations(job_events(spark, d)))


# --- attestation -----------------------------------------------------------

_PAYLOAD = CARDS + """, p AS (SELECT *, '{"actor":{"email":"","name":"","sub":""},"attestation_note":"","attested_at":"' || coalesce(strftime(attested_at, '%Y-%m-%dT%H:%M:%S'), '')
 || '","attested_by":"' || attested_by || '","card":{"description":"' || description || '","id":"' || id || '","job_id":"' || job_id || '","labels":["'
 || array_to_string(list_sort(list_distinct(list_filter(list_transform(labels, lambda v: trim(v)), lambda v: v <> ''))), '","') || '"],"priority":"' || priority
 || '","scenario_id":"' || scenario_id || '","session_id":"' || session_id || '","status":"' || status || '","title":"' || title
 || '","updated_at":"' || strftime(updated_at, '%Y-%m-%dT%H:%M:%S') || '"},"schema":"redactory.attestation.v1"}' AS payload FROM cards)"""


@query("attestation_digest", _PAYLOAD + " SELECT id, payload, sha256(payload) AS payload_hash FROM p WHERE attested")
def _(spark, d):
    return att.attestation_digest(cards(spark, d).where("attested")).select("id", "payload", "payload_hash")


@query("attestation_check", _PAYLOAD + " SELECT id, CAST(id AS BIGINT) % 3 <> 0 AS intact FROM p WHERE attested")
def _(spark, d):
    signed = att.attestation_digest(cards(spark, d).where("attested")).withColumnRenamed("payload_hash", "stored").drop("payload")
    # Every third card is changed after it was attested.
    changed = signed.withColumn("title", F.expr("IF(int(id) % 3 = 0, title || '!', title)"))
    return att.attestation_check(changed, "stored").select("id", "intact")
