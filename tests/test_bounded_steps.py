"""Steps that once ran in one task: retention by bytes, exact quantiles; and failures that stay with their text."""

import random

import pytest
from pyspark.sql import functions as F

from redactory.catalog import planted
from redactory.operators import dictionary as dic, records as rec, telemetry as tel
from redactory.operators.job import quarantine_failures
from redactory.plans import salting, spread
from redactory.streaming import live


def kept(rows, n, b):
    out, total = [], 0
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]), reverse=True):
        total += r[2]
        if (n is not None and len(out) == n) or (b is not None and total > b):
            break
        out.append(r[0])
    return sorted(out)


@pytest.mark.parametrize("n,b", [(10, None), (None, 500), (200, 3000), (1, 1), (300, 10**6), (None, 7)])
def test_newest_within_rows_and_bytes(spark, n, b):
    rng = random.Random(n or b)
    times = [None, "2024-01-01 00:00:00", "2024-01-01 00:00:00.000001", "2024-01-02 10:00:00", "2024-01-02 10:00:00.5"]
    rows = [(f"id{i:04d}", rng.choice(times[:1] + times[3:] * 4), rng.randint(1, 20)) for i in range(300)]  # one hot moment
    audit = spark.createDataFrame(rows, "id string, t string, size int").selectExpr("id", "cast(t AS timestamp) AS timestamp", "size")
    got = rec.retain_newest(audit, n, b, audit["size"])
    assert got.columns == audit.columns
    assert sorted(r.id for r in got.collect()) == kept(rows, n, b)
    assert "TakeOrdered" not in got._jdf.queryExecution().toString()


def test_exact_quantiles_without_one_task_for_all(spark):
    rng = random.Random(1)
    for values in ([], [3.0], [1.0, 2.0], [rng.expovariate(1 / 300) for _ in range(3000)] + [0.0, 5e6, -1.0], [7.25] * 50):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "duration_s double")
        row = tel.duration_quantiles(df).first()
        ms = sorted(round(v * 1000) for v in values)
        assert row.jobs == len(ms)
        for name, q in tel.QUANTILES:
            if not ms:
                assert row[name] is None
                continue
            at = q * (len(ms) - 1)
            low = ms[int(at)]
            assert abs(row[name] - (low + (ms[min(int(at) + 1, len(ms) - 1)] - low) * (at - int(at))) / 1000) < 2e-6
    assert "percentile" not in tel.duration_quantiles(df)._jdf.queryExecution().toString()


def test_failing_texts_leave_the_others(spark):
    def model(texts):
        out = []
        for t in texts:
            if "bad" in t:
                raise RuntimeError("cannot read")
            out.append([("PER", 0, 3, 0.9)] + ([("PER", 5, 99, 0.9)] if "far" in t else []))
        return out

    rows = [(i, "bad" if i == 5 else "Ann far" if i == 7 else None if i == 9 else f"Ann {i}") for i in range(30)]
    df = spark.createDataFrame(rows, "id int, t string")
    spotted = dic.guarded_model_spans(df, "id", "t", model)
    got = spotted.collect()
    assert {r.id: r.error for r in got if r.error} == {
        5: "RuntimeError: cannot read", 7: "ValueError: span 5-99 is not in the text"}
    assert sorted(r.id for r in got if not r.error) == [i for i in range(30) if i not in (5, 7, 9)]
    assert {r.text for r in got if not r.error} == {"Ann"}
    failed = quarantine_failures(df, "id", spotted)
    assert {(r.id, r.t) for r in failed.collect()} == {(5, "bad"), (7, "Ann far")}


@pytest.mark.parametrize("small", [True, False])
def test_sessions_of_a_hot_card(spark, monkeypatch, small):
    """Half of the sessions hold one card; broadcast and salted forms give the same rows."""
    monkeypatch.setattr(salting, "measured_small", lambda df: small)
    sessions = spark.range(400).selectExpr(
        "concat('s', id) AS id", "CASE WHEN id % 2 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('c', id % 9) END AS pipeline_card_id",
        "timestamp '2024-01-01' AS created_at")
    cards = spark.sql("SELECT * FROM VALUES ('hot'), ('c1'), ('c3'), ('unused'), (NULL) AS t(id)")
    got = rec.sessions_per_card(sessions, cards)
    assert got.columns == ["card_id", "session_id", "created_at"]
    wanted = [(f"c{i % 9}" if i % 2 else "hot", f"s{i}") for i in range(400) if i % 2 == 0 or (i % 7 and i % 9 in (1, 3))]
    assert sorted((r.card_id, r.session_id) for r in got.collect()) == sorted(wanted)
    assert ("_salt" in got._jdf.queryExecution().toString()) == (not small)

@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_a_lookup_that_is_not_small_never_goes_to_the_driver(spark, tmp_path, how):
    """Compressed to little, it looks small enough for a broadcast of all its repetitions."""
    spark.range(200_000).selectExpr("cast(id as string) AS card_id").write.parquet(str(tmp_path / "cards"))
    facts = spark.range(1000).selectExpr("id AS n", "cast(id as string) AS card_id")
    got = salting.lookup_join(facts, spark.read.parquet(str(tmp_path / "cards")), "card_id", "n", how)
    assert got.count() == 1000
    plan = got._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_costly_rows_do_not_stay_in_their_row_group(spark, tmp_path, monkeypatch):
    """One row group in a file of as many splits as cores: the rows are dealt by number, not by split."""
    import pyarrow.parquet as pq
    path = str(tmp_path / "orders.parquet")
    rows = spark.range(6000).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey")
    pq.write_table(rows.toArrow(), path)
    monkeypatch.setattr(spread, "TASK_ROWS", 500)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        notes = planted.planted(spark, str(tmp_path)).select("order_id", F.spark_partition_id().alias("p"))
        held = [r["count"] for r in notes.groupBy("p").count().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(held) == 6000 and max(held) <= 2 * 500


def test_reports_without_explanations_write_none(spark):
    from redactory import catalog
    folder = "/root/testdata/sf0.001"
    for name, shown in (("confidence_histogram", False), ("type_summary", False), ("evidence_rows", True)):
        plan = catalog.queries()[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        assert ("pattern=" in plan) == shown, name


def test_card_numbers_pass_luhn_with_13_to_19_digits_only(spark):
    from redactory.functions.checks import luhn
    texts = ["4111 1111-1111 1111", "4111111111111112", "0000000000000", "000000000000", "0" * 19, "0" * 20, "4222222222222"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.expr(luhn("t"))).collect()
    assert [r[0] for r in got] == [True, False, True, False, True, False, True]


def test_due_reviews_keep_many_ids_in_one_state(spark, tmp_path):
    """One Python call a bucket and batch, not one an id; every id fires once, by its newest version."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    rows = spark.range(3000).selectExpr(
        "concat('a', id) AS id", "concat('t', id) AS title", "cast(null as string) AS pipeline_card_id",
        "timestamp'2024-01-01 09:00:00' AS scheduled_for", "IF(id % 3 = 0, 'cancelled', 'scheduled') AS status",
        "IF(id % 5 = 0, NULL, 1L) AS seq", "timestamp'2024-01-01 10:00:00' AS ts")
    rows.write.parquet(str(tmp_path / "in"))
    fired = live.fire_when_due(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), buckets=8)
    query = (fired.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start())
    query.awaitTermination()
    states = max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert states == 8
    ids = [r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(ids) == sorted(f"a{i}" for i in range(3000) if i % 3 and i % 5)
