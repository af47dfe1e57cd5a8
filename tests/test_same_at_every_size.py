"""Operators that choose a plan by size give the same answer either way; bad input is named, not guessed."""

import pytest
from pyspark.sql import functions as F

from redactory.functions import when
from redactory.operators import analytics, dictionary, geo, records


def test_dictionary_spans_with_repeated_and_null_keys(spark):
    rows = [("k", "Ann Lee met Bob"), ("k", "xx Bob"), ("k", "xx Bob"), (None, "Bob"), (None, None), ("n", ""), ("n", None)]
    df = spark.createDataFrame(rows, "k string, t string")
    terms = spark.createDataFrame([("Ann Lee", "PERSON"), ("Bob", "PERSON")], "term string, entity_type string")
    small = dictionary.with_dictionary_spans(df, "k", "t", terms)
    large = dictionary.with_dictionary_spans(df, "k", "t", terms, max_rows=0)
    assert small.columns == large.columns
    plain = lambda d: sorted(map(repr, d.select("k", "t", F.transform(
        F.array_sort("dictionary_spans"), lambda s: F.struct(s.start, s.end, s.text)).alias("s")).collect()))
    assert plain(small) == plain(large)
    spans = {(r.k, r.t): [(s.start, s.end, s.text) for s in r.dictionary_spans] for r in large.collect()}
    assert spans["k", "xx Bob"] == [(3, 6, "Bob")] and len(spans["k", "Ann Lee met Bob"]) == 2 and spans[None, None] == []


def test_cities_with_map_columns_and_repeated_aliases(spark):
    places = spark.createDataFrame([(0, "seattle", 1.0, 2.0), (1, "new york", 3.0, 4.0), (2, "seattle", 1.0, 2.0)],
                                   "pos int, city string, lat double, lon double")
    alias = spark.createDataFrame([("nyc", "new york"), ("nyc", "new york")], "alias string, city string")
    df = spark.createDataFrame([("NYC",), ("Seattle office",), ("nowhere",), (None,), ("",)], "v string").withColumn(
        "m", F.create_map(F.lit("a"), F.lit(1)))
    got = [sorted(map(repr, geo.resolve_city(df, "v", places, alias, max_rows=n).select("v", "city").collect())) for n in (100, 0)]
    assert got[0] == got[1] and "Row(v='NYC', city='new york')" in got[0]


def test_unknown_windows_and_limits_raise():
    with pytest.raises(ValueError):
        when.cutoff("yesterday", "2024-01-01")
    assert when.cutoff("ALL", "2024-01-01") is None


def test_unreadable_changes_change_nothing(spark):
    feed = spark.createDataFrame(
        [("a", 1, "put", '{"status":"backlog"}'), ("b", 2, "put", "{bad"), ("a", 3, "patch", None), ("a", 4, "delete", None)],
        "id string, seq long, op string, payload string").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    assert {r.seq for r in records.unreadable_changes(feed).collect()} == {2, 3}
    assert records.current_state(feed.where("seq < 4"), ["status"]).select("id", "status").collect() == [("a", "backlog")]
    assert records.current_state(feed, ["status"]).count() == 0


def test_moves_need_their_own_words(spark):
    texts = ["reviewtodone", "review\tto\tdone", "review→done", "review  ->\tdone", "preview to done", "backlog to review"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", analytics.parse_move("t").alias("m"))
    got = {r.t: r.m and (r.m.from_status, r.m.to_status) for r in df.collect()}
    assert got == {"reviewtodone": None, "review\tto\tdone": ("review", "done"), "review→done": ("review", "done"),
                   "review  ->\tdone": ("review", "done"), "preview to done": None, "backlog to review": ("backlog", "review")}


def test_details_are_cut_only_on_request(spark):
    audit = spark.createDataFrame([("c", "card", "x", "m", "me", "d" * 500)],
                                  "resource_id string, resource_type string, id string, action string, actor string, details string").withColumn(
        "timestamp", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    cards = spark.createDataFrame([("c",)], "id string")
    assert len(analytics.card_history(audit, cards).first().details) == 500
    assert len(analytics.card_history(audit, cards, width=80).first().details) == 80


def test_written_tables_are_deleted_on_request(spark):
    import os

    from redactory.plans import shared
    shared.forget_written(spark)
    df = shared.written(spark.range(3), "t")
    folder = shared._made[-1]
    assert df.count() == 3 and os.path.isdir(folder)
    assert shared.forget_written(spark) == 1 and not os.path.exists(folder)


def test_retention_sorts_one_day(spark):
    rows = [(i, f"2024-01-{1 + i % 3:02d} 0{i % 7}:00:00") for i in range(60)] + [(100, None), (101, None)]
    audit = spark.createDataFrame(rows, "id int, t string").selectExpr("id", "cast(t as timestamp_ntz) AS timestamp")
    newest = [i for i, t in sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]), reverse=True)]
    for n in (1, 19, 20, 21, 45, 60, 61, 62, 99):
        assert sorted(r.id for r in records.retain_newest(audit, n).collect()) == sorted(newest[:n]), n
