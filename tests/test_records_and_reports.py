"""Change feed, filters, reports, places, telemetry and attestation."""

import datetime as dt
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from redactory.operators import analytics as an
from redactory.operators import attestation as att
from redactory.operators import filters as flt
from redactory.operators import geo
from redactory.operators import records as rec
from redactory.operators import reviews, telemetry as tel
from redactory.plans.salting import lookup_join, salted_join
from redactory.plans.windows import previous_values, running_clamped_sum

NOW = dt.datetime(2024, 5, 10, 12, 0, 0)
H, D = dt.timedelta(hours=1), dt.timedelta(days=1)


def feed(spark, rows):
    data = [(i, seq, NOW + seq * H, op, json.dumps(p) if p is not None else None) for i, seq, op, p in rows]
    return spark.createDataFrame(data, "id string, seq long, ts timestamp_ntz, op string, payload string")


def test_current_state_and_audit(spark):
    f = feed(spark, [
        ("a", 1, "put", {"title": "A", "status": "backlog", "note": "n"}), ("a", 2, "patch", {"status": "done"}),
        ("a", 3, "patch", {"note": None}), ("a", 4, "patch", {"status": "done"}),
        ("b", 5, "patch", {"status": "done"}), ("c", 6, "put", {"title": "C", "status": "done"}),
        ("c", 7, "patch", {"status": "review"}), ("d", 8, "put", {"title": "D"}), ("d", 9, "delete", None),
        ("a", 10, "patch", {"attested": "true", "attested_by": "eve"})])
    state = {r["id"]: r for r in rec.current_state(f, ["title", "status", "note"]).collect()}
    assert set(state) == {"a", "c"}
    assert (state["a"]["status"], state["a"]["note"], state["a"]["updated_at"]) == ("done", None, NOW + 10 * H)
    done = {r["id"]: r["done_at"] for r in rec.done_times(f).collect()}
    assert done == {"a": NOW + 2 * H, "c": None}  # the second "done" is no entry; reopening clears
    log = [(r["resource_id"], r["action"], r["details"], r["severity"]) for r in
           rec.audit_from_feed(f).orderBy("seq").collect()]
    assert log == [
        ("a", "pipeline.create", "Created card 'A' in 'backlog'", "info"),
        ("a", "pipeline.move", "Moved 'A' from 'backlog' → 'done'", "info"),
        ("c", "pipeline.create", "Created card 'C' in 'done'", "info"),
        ("c", "pipeline.move", "Moved 'C' from 'done' → 'review'", "info"),
        ("d", "pipeline.create", "Created card 'D' in 'backlog'", "info"),
        ("d", "pipeline.delete", "Deleted 'D'", "warning"),
        ("a", "compliance.attest", "Attested by 'eve'", "info")]


def test_snapshot_and_deltas_equal_the_replay(spark, tmp_path):
    rng, rows = random.Random(5), []
    for seq in range(600):
        op = rng.choice(["put", "patch", "patch", "patch", "delete"])
        fields = {f: rng.choice(["a", "b", None]) for f in ("title", "status") if op == "put" or rng.random() < 0.5}
        some = rng.choice([None, "hot", "hot", *map(str, range(40))])
        rows.append((some, seq, "2024-01-01 00:00:00", op, json.dumps(fields) if rng.random() < 0.95 else "{bad"))
    make = lambda some: spark.createDataFrame(some, "id string, seq long, at string, op string, payload string").selectExpr(
        "id", "seq", "cast(at as timestamp_ntz) AS ts", "op", "payload")
    path, fields = str(tmp_path / "snapshot"), ["title", "status"]
    records = lambda df: sorted(map(tuple, df.collect()), key=str)
    rec.apply_changes(path, make([]), fields, 16)
    assert records(rec.read_snapshot(spark, path, fields)) == []
    for part in (rows[:200], rows[400:], rows[150:420], rows[400:]):  # late, overlapping and repeated parts
        rec.apply_changes(path, make(part), fields, 16)
    assert records(rec.read_snapshot(spark, path, fields)) == records(rec.current_state(make(rows), fields))
    files = lambda: {str(p): p.stat().st_mtime_ns for p in tmp_path.glob("snapshot/_bucket=*/*.parquet")}
    before = files()
    rec.apply_changes(path, make([("7", 1000, "2024-01-02 00:00:00", "put", '{"title": "new"}')]), fields, 16)
    rec.apply_changes(path, make([]), fields, 16)
    after = files()
    assert {p.split("/")[-2] for p in before.items() ^ after.items() for p in [p[0]]} == {
        f"_bucket={r[0]}" for r in spark.sql("SELECT pmod(xxhash64('7'), 16)").collect()}
    assert ("7", "new", None) in {r[:3] for r in records(rec.read_snapshot(spark, path, fields))}


def test_previous_values_with_a_hot_key(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("xyz"), i, rng.choice([None, i])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, seq long, v long")
    want, last = {}, {}
    for k, i, v in rows:
        want[i] = last.get(k)
        if v is not None:
            last[k] = v
    for bucket in (7, 10_000):
        got = {r["seq"]: r["prev_v"] for r in previous_values(df, "k", "seq", ["v"], bucket).collect()}
        assert got == want


def test_clamped_running_sum(spark):
    rng = random.Random(9)
    steps = [(NOW + i * 5 * H, rng.choice([-3, -1, 1, 2])) for i in range(300)]
    out = running_clamped_sum(spark.createDataFrame(steps, "ts timestamp_ntz, d int"), "ts", "d", "run")
    got = {r["ts"]: r["run"] for r in out.collect()}
    run = 0
    for ts, d in steps:
        run = max(0, run + d)
        assert got[ts] == run


def test_salted_join_equals_plain_join(spark):
    facts = spark.range(1000).selectExpr("id", "IF(id % 3 = 0, 'hot', string(id % 50)) AS k")
    look = spark.createDataFrame([("hot", 1), ("7", 2), ("nope", 3)], "k string, v int")
    for how in ("inner", "left"):
        want = sorted(map(repr, facts.join(look, "k", how).select("id", "k", "v").collect()))
        assert sorted(map(repr, salted_join(facts, look, "k", "id", how).select("id", "k", "v").collect())) == want
        assert sorted(map(repr, lookup_join(facts, look, "k", "id", how).select("id", "k", "v").collect())) == want


AUDIT = "id string, timestamp timestamp_ntz, actor string, action string, resource_type string, resource_id string, details string, severity string"


def audit_rows(spark):
    return spark.createDataFrame([
        ("1", NOW - H, "user1", "pipeline.create", "pipeline", "card-001", "Created card", "info"),
        ("2", NOW - 2 * D, "user2", "session.save", "session", "sess-001", "Saved session", "warning"),
        ("3", NOW - 10 * D, "admin", "pipeline.delete", "pipeline", "card-002", "Deleted old card", "critical")], AUDIT)


def test_filters(spark):
    a = audit_rows(spark)
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(flt.filter_audit(a, severity="WARNING")) == ["2"]
    assert ids(flt.filter_audit(a, text="card")) == ["1", "3"]
    assert ids(flt.filter_audit(a, window="week", as_of=NOW)) == ["1", "2"]
    assert ids(flt.filter_audit(a, window="today", as_of=NOW)) == ["1"]
    assert ids(flt.filter_audit(a, window="month", as_of=NOW, resource_type="pipeline")) == ["1", "3"]
    with pytest.raises(ValueError):
        flt.filter_audit(a, window="week")
    assert [(r["severity"], r["n"]) for r in flt.count_by_severity(a.where("id <> '2'")).collect()] == [
        ("info", 1), ("warning", 0), ("critical", 1)]
    s = spark.createDataFrame([("a", {"PERSON": 5, "EMAIL_ADDRESS": 2}, ""), ("b", {"PHONE_NUMBER": 3}, "mask")],
                              "id string, entity_counts map<string,long>, operator string")
    assert ids(flt.sessions_with_entities(s, ["PERSON", "URL"])) == ["a"]
    assert ids(flt.sessions_with_entities(s, [])) == ["a", "b"]
    types = spark.createDataFrame([("PHONE_NUMBER",)], "entity_type string")
    assert ids(flt.sessions_with_listed_entities(s, types)) == ["b"]
    assert {r["operator"]: r["n"] for r in flt.count_by_operator(s).collect()} == {"replace": 1, "mask": 1}
    with pytest.raises(ValueError):
        flt.cards_with_status(s, "nope")
    with pytest.raises(ValueError):
        rec.latest_audit(a, 0)


def test_group_by_splits_hot_groups(spark):
    df = spark.range(1000).selectExpr("id", "IF(id % 3 = 0, NULL, IF(id < 900, 'hot', 'cold')) AS k")
    parts = flt.group_by(df, F.col("k"), "id", chunk_rows=50).collect()
    assert sum(len(r["members"]) for r in parts) == 1000
    assert max(len(r["members"]) for r in parts) < 150
    assert {r["key"] for r in parts} == {None, "hot", "cold"}


def brute_burndown(cards, moves, now):
    ev, seen = [], set()
    for cid, status, created, done in cards:
        ev.append((created, 1))
    at = {c[0]: c[2] for c in cards}
    for cid, ts, a, b in moves:
        if cid in at and a != b and "done" in (a, b):
            ev.append((max(ts, at[cid]), -1 if b == "done" else 1))
            seen.add(cid)
    for cid, status, created, done in cards:
        if status == "done" and cid not in seen:
            ev.append((max(done, created), -1))
    net = {}
    for ts, d in ev:
        net[ts] = net.get(ts, 0) + d
    run, line = 0, []
    for ts in sorted(net):
        run = max(0, run + net[ts])
        line.append([ts, run])
    open_now = sum(c[1] != "done" for c in cards)
    if line[-1][0] < now:
        line.append([now, line[-1][1]])
    line[-1][1] = open_now
    start, total = line[0], max(1.0, (line[-1][0] - line[0][0]).total_seconds())
    return [(ts, n, max(0.0, round(start[1] * (1 - (ts - start[0]).total_seconds() / total), 2))) for ts, n in line]


@pytest.mark.parametrize("as_of", [NOW + 90 * D, NOW + 5 * D])
def test_burndown_against_brute_force(spark, as_of):
    rng = random.Random(4)
    cards = [(f"c{i}", rng.choice(["backlog", "done", "review"]), NOW + rng.randint(0, 400) * H, NOW + rng.randint(0, 600) * H)
             for i in range(60)]
    moves = [(f"c{rng.randint(0, 80)}", NOW + rng.randint(0, 700) * H, *rng.sample(["backlog", "in progress", "review", "done"], 2))
             for _ in range(80)]
    c = spark.createDataFrame([(i, s, t, d, d) for i, s, t, d in cards],
                              "id string, status string, created_at timestamp_ntz, updated_at timestamp_ntz, done_at timestamp_ntz")
    a = spark.createDataFrame([("pipeline.move", i, f"{x} → {y}", t) for i, t, x, y in moves],
                              "action string, resource_id string, details string, timestamp timestamp_ntz")
    got = [tuple(r) for r in an.burndown(c, a, as_of).orderBy("ts").collect()]
    assert got == brute_burndown(cards, moves, as_of)


def test_parse_move(spark):
    texts = ["Moved 'x' from 'backlog' → 'review'", "in progress -> done", "review to done", "first backlog, then review done",
             "done", "reviewed backlogs", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(an.parse_move("t").alias("m"))
    got = [r["m"] and (r["m"]["from_status"], r["m"]["to_status"]) for r in df.collect()]
    assert got == [("backlog", "review"), ("in_progress", "done"), ("review", "done"), ("backlog", "done"), None, None, None]


def test_places(spark):
    texts = spark.createDataFrame([(1, "Routing through Seattle and Austin, TX.")], "id int, text string")
    ents = spark.createDataFrame([("LOCATION", "Seattle"), ("GPE", "Austin TX"), ("LOCATION", "Springfield"), ("PERSON", "Paris"),
                                  ("LOC", " "), ("LOC", "nyc"), ("LOC", "Greater Boston area")], "entity_type string, text string")
    places = geo.cities(spark)
    counts = geo.geo_counts(geo.text_mentions(texts, "id", "text", places), geo.entity_mentions(ents, places, geo.aliases(spark)))
    got = {r["city"]: (r["text_mentions"], r["entity_mentions"]) for r in counts.collect()}
    assert got == {"seattle": (1, 1), "austin": (1, 1), "new york": (0, 1), "boston": (0, 1), None: (0, 1)}
    assert geo.map_view(geo.map_rows(counts, places)).first()["max_lat"] == 47.6062


def test_attestation_matches_json(spark):
    df = spark.createDataFrame([("card-1", "HIPAA review", "d", "done", "high", [" urgent", "hipaa", "hipaa", ""], "s", None, "j",
                                 dt.datetime(2026, 3, 5, 18, 0), "eve", dt.datetime(2026, 3, 5, 18, 8))],
                               "id string, title string, description string, status string, priority string, labels array<string>, "
                               "session_id string, scenario_id string, job_id string, updated_at timestamp_ntz, attested_by string, attested_at timestamp_ntz")
    want = json.dumps({
        "schema": "redactory.attestation.v1", "attested_at": "2026-03-05T18:08:00", "attested_by": "eve", "attestation_note": "",
        "actor": {"sub": "", "name": "", "email": ""},
        "card": {"id": "card-1", "title": "HIPAA review", "description": "d", "status": "done", "priority": "high",
                 "labels": ["hipaa", "urgent"], "session_id": "s", "scenario_id": "", "job_id": "j", "updated_at": "2026-03-05T18:00:00"}},
        sort_keys=True, separators=(",", ":"))
    row = att.attestation_digest(df).first()
    assert row["payload"] == want and row["payload_hash"] == hashlib.sha256(want.encode()).hexdigest()
    stored = df.withColumn("h", F.lit(row["payload_hash"]))
    assert att.attestation_check(stored, "h").first()["intact"]
    assert not att.attestation_check(stored.withColumn("title", F.lit("x")), "h").first()["intact"]


def test_due_reviews(spark):
    appts = spark.createDataFrame([("a1", "R1", NOW - H, "c1", "scheduled"), ("a2", "R2", NOW + H, "c1", "scheduled"),
                                   ("a3", "R3", NOW, None, "scheduled"), ("a4", "R4", NOW - H, "c2", "cancelled"),
                                   ("a5", "R5", NOW - D, "c1", "scheduled")],
                                  "id string, title string, scheduled_for timestamp_ntz, pipeline_card_id string, status string")
    cards = spark.createDataFrame([("c1", "in_progress"), ("c2", "in_progress")], "id string, status string")
    out = reviews.fire(reviews.due_appointments(appts, NOW), cards)
    assert [r["id"] for r in out["card_changes"].collect()] == ["c1"]
    assert sorted(r["id"] for r in out["appointment_changes"].collect()) == ["a1", "a3", "a5"]
    assert out["audit"].where("action = 'appointment.due'").count() == 3


def test_telemetry(spark):
    ev = spark.createDataFrame([("j1", NOW, 1, "submitted", 0, 0), ("j1", NOW + 10 * H / 3600, 2, "completed", 4, 2),
                                ("j2", NOW, 3, "running", 1, 1)], "job_id string, ts timestamp_ntz, seq long, status string, entities long, rows long")
    hist = {r["le"]: r["n"] for r in tel.duration_histogram(tel.job_durations(ev)).collect()}
    assert hist["5"] == 0 and hist["15"] == 1 and hist["+Inf"] == 1
    assert {r["status"]: r["depth"] for r in tel.queue_depth(ev).collect()} == {"COMPLETED": 1, "RUNNING": 1}
