"""Sources and sinks, streams, registered queries against SQL."""

import os

import pytest

import __spark_entry__ as entry
from check_queries import compare, duck
from redactory import Policy, catalog
from redactory.operators import telemetry as tel
from redactory.operators.job import deidentify
from redactory.sources import manifest, tables
from redactory.streaming import live, run

SF = "/root/testdata/sf0.001"


def test_csv_round_trip(spark, tmp_path):
    df = spark.sql("""SELECT * FROM VALUES (1, 'two
lines, "quoted"', array('a', 'b')), (2, NULL, NULL) AS t(id, note, tags)""")
    tables.write_csv(df, str(tmp_path / "csv"))
    back = sorted(tuple(r) for r in tables.read_table(spark, str(tmp_path / "csv"), multiline=True).collect())
    assert back == [("1", 'two\nlines, "quoted"', '["a","b"]'), ("2", None, None)]
    assert tables.row_count(tables.read_table(spark, str(tmp_path / "csv"), multiline=True)).first()["rows"] == 2
    (tmp_path / "large.csv").write_text("a\n" + "x" * 50 + "\n" + ("y" * 50 + "\n") * 200_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    large = tables.read_table(spark, str(tmp_path / "large.csv"))
    splits, rows = large.rdd.getNumPartitions(), large.count()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert splits > 4 and rows == 200_001
    tables.write_json(df, str(tmp_path / "json"))
    assert tables.read_table(spark, str(tmp_path / "json"), "json").count() == 2
    (tmp_path / "latin.csv").write_bytes("name\ncafé\n".encode("latin-1"))
    assert tables.read_table(spark, str(tmp_path / "latin.csv"), encoding="ISO-8859-1").first()["name"] == "café"
    with pytest.raises(ValueError):
        tables.read_table(spark, "x", "xlsx")


def test_manifest(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "good.csv").write_text("a\n1\n")
    (root / "fake.csv").write_bytes(b"PK\x03\x04rest")
    (root / "note.txt").write_text("x")
    (root / "big.csv").write_text("x" * 100)
    (root / "no rows+at all.csv").write_text("")
    got = {os.path.basename(r["path"]): (r["accepted"], r["reason"]) for r in
           manifest.file_manifest(spark, str(root), str(tmp_path), max_bytes=50).collect()}
    assert got == {"good.csv": (True, "ok"), "fake.csv": (False, "content is not text"), "note.txt": (False, "unsupported type"), "big.csv": (False, "too large"),
                   "no rows+at all.csv": (False, "empty")}
    for outside in ("/data/../etc", "/data2/x"):
        with pytest.raises(manifest.PathNotAllowed):
            manifest.file_manifest(spark, outside, "/data")


def test_manifest_of_nested_folders(spark, tmp_path, monkeypatch):
    """Listed and read in tasks: the driver gets no path; names with signs, hidden files, empty folders, many pieces."""
    import hashlib
    root = tmp_path / "in"
    wanted = {}
    for i in range(40):
        folder = root / f"k={i % 5}" / "a b+%20" / f"_x=é{i % 3}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f {i}.csv").write_text("v\n" * i)
        wanted[str(folder / f"f {i}.csv")] = (2 * i, hashlib.sha256(b"v\n" * i).hexdigest(), "ok" if i else "empty")
    (root / "empty").mkdir()
    (root / "_hidden").mkdir()
    (root / "_hidden" / "x.csv").write_text("1")
    (root / ".x.csv").write_text("1")
    big = bytes(range(256)) * 10_000
    (root / "big.csv").write_bytes(big)
    wanted[str(root / "big.csv")] = (len(big), hashlib.sha256(big).hexdigest(), "ok")
    seen = []
    collect = type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda df: seen.append(df) or collect(df))
    frame = manifest.file_manifest(spark, str(root), str(tmp_path))
    assert seen == []
    monkeypatch.undo()
    assert {r.path: (r.length, r.sha256, r.reason) for r in frame.collect()} == wanted
    as_uri = manifest.file_manifest(spark, (root / "k=1").as_uri(), str(tmp_path)).collect()
    assert len(as_uri) == 8 and all(r.path.startswith("file:///") for r in as_uri)
    assert all(r.reason in ("ok", "empty") for r in as_uri)
    store, inner, _ = manifest.opened(str(root / "k=2"))
    listed = manifest.list_files(spark, store, inner)
    first = listed.orderBy("path").first().path
    os.remove(first)
    lost = manifest._verdict(manifest.digest_files(listed, store), 1000).where("reason = 'unreadable'")
    assert [r.path for r in lost.collect()] == [first]
    one = manifest.file_manifest(spark, str(root / "big.csv"), str(root)).collect()
    assert [(r.length, r.sha256, r.reason) for r in one] == [wanted[str(root / "big.csv")]]
    with pytest.raises(FileNotFoundError):
        manifest.file_manifest(spark, str(root / "absent"), str(root))
    (root / "nothing").mkdir()
    assert manifest.file_manifest(spark, str(root / "nothing"), str(tmp_path)).count() == 0


def test_documents_from_json(spark):
    df = spark.createDataFrame([('{"_id":"abc","text":"Seattle office"}',), ('7',), ('{bad',)], "doc string")
    rows = [tuple(r) for r in tables.rows_from_json(df, "doc", "_id string, text string").collect()]
    assert rows == [("Seattle office", None, None), (None, "7", None), (None, None, "{bad")]


def test_one_payload_reads_few_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq
    rows = spark.range(100_000).selectExpr("(id * 7919) % 100000 AS id", "concat('{\"k\":', id, ',\"pad\":\"', repeat(uuid(), 4), '\"}') AS doc")
    rows = rows.unionByName(spark.sql("SELECT * FROM VALUES (NULL, '{\"k\":0}'), (5L, '{bad'), (100001L, NULL) AS t(id, doc)"))
    path = str(tmp_path / "payloads")
    tables.write_payloads(rows, path, "id", 1 << 20)
    kept = spark.read.parquet(path)
    found = tables.get_payload(kept, "doc", "k long", "id", 7919)
    assert [tuple(r) for r in found.collect()] == [(7919, 1)]
    assert "EqualTo(id,7919)" in found._jdf.queryExecution().toString()
    groups = [pq.ParquetFile(f).metadata.row_group(g).column(0).statistics
              for f in (tmp_path / "payloads").glob("*.parquet") for g in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert len(groups) >= 8 and sum(g.has_min_max and g.min <= 7919 <= g.max for g in groups) == 1
    look = lambda value: sorted(map(tuple, tables.get_payload(kept, "doc", "k long", "id", value).collect()), key=str)
    assert look(None) == [] and look(-1) == [] and len(look(5)) == 2 and look(100_001) == [(100_001, None)]


def test_stream_equals_batch(spark):
    policy = Policy(entities=("EMAIL_ADDRESS", "IP_ADDRESS"))
    stream = run.stream_of(spark, SF, "documents").select("doc_id", "text")
    got = run.run_appending(live.deidentify_stream(stream, ["text"], policy), "t")
    want = deidentify(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), ["text"], policy)
    assert sorted(got.collect()) == sorted(want.collect())


def test_a_folder_of_parts_is_a_stream_too(spark, tmp_path):
    for table in ("documents", "conversations"):
        spark.read.parquet(f"{SF}/{table}.parquet").repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
        for folder in (SF, str(tmp_path)):
            got = run.run_appending(run.stream_of(spark, folder, table), "parts")
            assert got.count() == spark.read.parquet(f"{SF}/{table}.parquet").count() > 0
    whole, parts = (sorted(entry.queries()["live_entity_counts"](spark, f).collect()) for f in (SF, str(tmp_path)))
    assert whole == parts and whole


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "entity_counts", "redacted_text"] and df.count() > 0


def test_contract_is_complete():
    # The corpus operators' own tests name their exceptions; this is the rule for all other queries.
    queries, sql = catalog.queries(), catalog.statements()
    assert set(sql) <= set(queries) and len(queries) - len(sql) <= 1
    assert set(queries) <= set(entry.queries()) and set(sql) <= set(entry.oracle_sql())


SAMPLE = ["detect_documents", "rewrite_hash", "dictionary_hits", "result_record", "deidentify_documents", "profile_documents",
          "latest_progress", "reconcile_status", "current_state", "audit_from_feed", "global_stats", "filter_audit",
          "entity_pareto", "burndown", "confidence_kpis", "geo_counts", "queue_depth_over_time", "attestation_digest",
          "live_event_counts", "live_due_reviews"]


@pytest.mark.parametrize("name", sorted(entry.queries()) if os.environ.get("ALL_QUERIES") else SAMPLE)
def test_query_equals_sql(spark, name):
    sql = entry.oracle_sql().get(name)
    df = entry.queries()[name](spark, SF)
    if sql is None:
        assert df.count() > 0
    else:
        verdict = compare(df, duck(SF), sql)
        assert verdict.startswith("ok") and "types" not in verdict, verdict


def test_reviews_fire_once_at_their_time(spark, tmp_path):
    """Early, late, repeated, moved and cancelled appointments over several batches."""
    schema = "id string, title string, pipeline_card_id string, scheduled_for timestamp_ntz, status string, seq long, ts timestamp"
    row = lambda i, due, status, seq, ts, card="c": (i, f"t-{i}", card, due and f"2024-01-01 {due}:00", status, seq, f"2024-01-01 {ts}:00")
    batches = [
        [row("early", "12:00", "scheduled", 1, "10:00"), row("early", "12:00", "scheduled", 1, "10:00"),
         row("cancelled", "12:00", "scheduled", 1, "10:00"), row("moved", "12:00", "scheduled", 1, "10:00"),
         row("later", "18:00", "scheduled", 1, "10:00"), row("never", None, "scheduled", 1, "10:00")],
        [row("cancelled", "12:00", "cancelled", 2, "11:00"), row("moved", "14:00", "scheduled", 2, "11:00")],
        [row("early", "12:00", "scheduled", 1, "13:00"), row("late", "09:00", "scheduled", 1, "13:00", None)],
        [row("tick", None, "completed", 1, "15:00")],
    ]
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    for k, rows in enumerate(batches):
        df = spark.createDataFrame([tuple(r) for r in rows], "id string, title string, pipeline_card_id string, due string, status string, seq long, at string")
        df = df.selectExpr("id", "title", "pipeline_card_id", "cast(due as timestamp_ntz) AS scheduled_for", "status", "seq", "cast(at as timestamp) AS ts")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        fired = live.fire_when_due(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        # One run a batch from one checkpoint: state and timers live on between runs.
        query = (fired.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out"))
                 .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start())
        query.awaitTermination()
        seen = sorted(r.id for r in spark.read.schema("id string, title string, pipeline_card_id string").parquet(str(tmp_path / "out")).collect())
        assert seen == [[], [], ["early", "late"], ["early", "late", "moved"]][k], k
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_live_queue_depth_with_late_and_repeated_events(spark, tmp_path):
    schema = "job_id string, seq long, ts timestamp, status string"
    at = lambda minute: f"2024-01-01 10:{minute:02}:00"
    batches = [
        [("a", 1, at(0), "pending"), ("a", 3, at(4), "Running"), ("b", 2, at(1), "pending"), ("a", 1, at(0), "pending")],
        [("a", 2, at(2), "queued"), ("b", 2, at(1), "pending"), ("b", 9, at(8), "failed"), (None, 4, at(4), "pending"),
         ("c", None, at(4), "pending"), ("c", 5, None, "pending"), ("c", 6, at(6), None)],
        [("a", 7, at(50), "completed"), ("b", 8, at(7), "running"), ("a", 7, at(50), "completed"), ("b", 9, at(8), "failed")],
        [("a", 8, at(55), "running"), ("a", 7, at(50), "completed")],
        [("a", 1, at(0), "lost"), ("b", 1, at(0), "queued")],  # a knows no event before seq 7 any more, b none before 9
    ]
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "job_id string, seq long, at string, status string").selectExpr(
            "job_id", "seq", "cast(at as timestamp) AS ts", "status").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        moves = live.live_queue_moves(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "10 minutes")
        (moves.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination())
        kept = {(r[0], r[1]): r for part in batches[:min(k, 3) + 1] for r in part if None not in r}
        whole = tel.queue_depth_over_time(spark.createDataFrame(list(kept.values()), "job_id string, seq long, at string, status string")
                                          .selectExpr("job_id", "seq", "cast(at as timestamp_ntz) AS ts", "status"))
        live_depth = tel.depth_of_moves(spark.read.schema(moves.schema).parquet(str(tmp_path / "out")))

        def changes(df):
            depth, out = {}, []
            for r in sorted(df.collect(), key=lambda r: (r.status, r.ts)):
                if depth.get(r.status, 0) != r.depth:
                    out.append((r.status, r.ts, r.depth))
                depth[r.status] = r.depth
            return out
        assert changes(live_depth) == changes(whole), k
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_reviews_count_rows_far_behind_the_clock(spark, tmp_path):
    """Appointments, moves and cancellations whose ts is hours or weeks behind, and repeats of fired ones."""
    schema = "id string, title string, pipeline_card_id string, scheduled_for timestamp, status string, seq long, ts timestamp"
    batches = [
        [("gone", "2024-01-30 12:00", "scheduled", 1, "2024-01-01 10:00"), ("moved", "2024-01-30 12:00", "scheduled", 1, "2024-01-01 10:00"),
         ("once", "2024-01-01 09:00", "scheduled", 1, "2024-01-01 10:00"), ("tick", None, "completed", 1, "2024-01-02 10:00")],
        [("gone", "2024-01-30 12:00", "cancelled", 2, "2024-01-02 04:00"), ("moved", "2024-02-20 12:00", "scheduled", 2, "2024-01-01 04:00"),
         ("late", "2024-01-01 09:00", "scheduled", 1, "2024-01-01 05:00"), ("tick", None, "completed", 2, "2024-02-02 10:00")],
        [("once", "2024-01-01 09:00", "scheduled", 1, "2024-01-01 10:00"), ("gone", "2024-01-30 12:00", "scheduled", 1, "2024-01-01 10:00"),
         ("later", "2024-02-02 11:00", "scheduled", 1, "2023-12-01 10:00"), ("tick", None, "completed", 3, "2024-02-02 10:30")],
        [("tick", None, "completed", 4, "2024-03-01 10:00")],
    ]
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "id string, due string, status string, seq long, at string")
        df = df.selectExpr("id", "concat('t-', id) AS title", "'c' AS pipeline_card_id", "cast(due as timestamp) AS scheduled_for", "status", "seq",
                           "cast(at as timestamp) AS ts")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        fired = live.fire_when_due(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        query = (fired.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out"))
                 .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start())
        query.awaitTermination()
        seen = sorted(r.id for r in spark.read.schema("id string").parquet(str(tmp_path / "out")).collect())
        assert seen == [["once"], ["late", "once"], ["late", "once"], ["late", "later", "moved", "once"]][k], k
    spark.conf.set("spark.sql.shuffle.partitions", "8")
