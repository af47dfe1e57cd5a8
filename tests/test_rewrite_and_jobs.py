"""Rewriting, table-wide jobs and the plans behind them."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from redactory import Policy
from redactory.catalog.detection import documents_with_pii
from redactory.functions import text as tx
from redactory.operators import job, profile
from redactory.operators.detect import detect
from redactory.operators.rewrite import annotate, result_record, rewrite, rewrite_given_spans
from redactory.operators.synth import synthesize_placeholders

SF = "/root/testdata/sf0.001"


def rewritten(spark, text, **kwargs):
    policy = Policy(**kwargs)
    df = spark.createDataFrame([(text,)], "text string")
    return rewrite(detect(df, "text", policy), "text", "spans", policy).first()["anonymized_text"]


def test_operators(spark):
    text = "Email: bob@example.com"
    only = {"entities": ("EMAIL_ADDRESS",)}
    assert rewritten(spark, text, **only) == "Email: <EMAIL_ADDRESS>"
    assert rewritten(spark, text, operator="redact", **only) == "Email: "
    assert rewritten(spark, text, operator="mask", **only) == "Email: " + "*" * 15
    long = "x" * 25 + "@example.com"
    assert rewritten(spark, long, operator="mask", **only) == "*" * 20 + long[20:]
    digest = hashlib.sha256(b"pepperbob@example.com").hexdigest()
    assert rewritten(spark, text, operator="hash", salt="pepper", **only) == "Email: " + digest
    assert rewritten(spark, "nothing here", **only) == "nothing here"
    mixed = rewritten(spark, "a@b.co 10.0.0.1", operators={"IP_ADDRESS": "redact"})
    assert mixed == "<EMAIL_ADDRESS> "


def test_quotes_in_salt_and_terms(spark):
    got = rewritten(spark, "say o'neil\\x now", operator="hash", salt="it's \\", deny=("o'neil\\x",))
    assert got == f"say {hashlib.sha256(chr(105).encode() + b't' + chr(39).encode() + b's ' + chr(92).encode() + b'o' + chr(39).encode() + b'neil' + chr(92).encode() + b'x').hexdigest()} now"


def test_synthesis_is_consistent(spark):
    a = rewritten(spark, "bob@example.com, amy@example.com, bob@example.com", operator="synthesize", seed="s")
    one, two, three = a.split(", ")
    assert one == three != two and "bob" not in a
    df = spark.createDataFrame([(1, "No placeholders here."), (2, "Patient <PERSON> from <LOCATION> called <PHONE_NUMBER>.")],
                               "id int, t string")
    rows = df.select(F.expr(synthesize_placeholders("t", "id", "s")).alias("r")).select("r.*").collect()
    assert (rows[0]["text"], rows[0]["backend"]) == ("No placeholders here.", "none")
    assert rows[1]["backend"] == "seeded" and not re.search("<[A-Z_]+>", rows[1]["text"])


def test_given_spans(spark):
    df = spark.sql("""SELECT 'call Bob at home' AS t, array(
        named_struct('entity_type', 'PERSON', 'start', 5, 'end', 8), named_struct('entity_type', 'URL', 'start', 90, 'end', 95),
        named_struct('entity_type', 'LOCATION', 'start', 12, 'end', 16)) AS s""")
    run = lambda op: df.selectExpr(rewrite_given_spans("t", "s", op) + " AS x").first()["x"]
    assert run("replace") == "call <PERSON> at <LOCATION>"
    assert run("redact") == "call  at "
    assert run("mask") == "call **** at ****"
    assert run("hash") == "call <PERSON_HASH> at <LOCATION_HASH>"
    with pytest.raises(ValueError):
        rewrite_given_spans("t", "s", "shred")


def test_annotation_escapes_markup(spark):
    df = spark.createDataFrame([("a@b.co <script>alert(1)</script>",), ("plain",)], "text string")
    rows = [r["annotated"] for r in annotate(detect(df, "text"), "text").collect()]
    assert rows[0] == "`a@b.co` *(Email Address · 100%)* &lt;script&gt;alert(1)&lt;/script&gt;"
    assert rows[1] == "*No PII detected.*"


def test_placeholders(spark):
    df = spark.createDataFrame([("to <PERSON> at <US_SSN>",)], "t string")
    row = df.selectExpr(tx.placeholders("t") + " AS p", tx.tag_placeholders("t") + " AS g").first()
    assert row["p"] == ["PERSON", "US_SSN"] and row["g"] == "to `PERSON` at `US_SSN`"


def test_invariants_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rec = result_record(detect(docs, "text"), "text", Policy()).collect()
    assert len(rec) == docs.count()
    for r in rec:
        for s in r["spans"]:
            assert r["text"][s["start"]:s["end"]] == s["text"]
        kept = r["kept"]
        assert all(a["end"] <= b["start"] for a, b in zip(kept, kept[1:]))
        assert sum((r["detected_counts"] or {}).values()) == r["total_found"]
        out, at = "", 0
        for s in kept:
            out += r["text"][at:s["start"]] + f"<{s['entity_type']}>"
            at = s["end"]
        assert out + r["text"][at:] == r["anonymized_text"]
    again = detect(spark.createDataFrame([(r["anonymized_text"],) for r in rec], "text string"), "text",
                   Policy(entities=("EMAIL_ADDRESS", "IP_ADDRESS")))
    assert again.where(F.size("spans") > 0).count() == 0
    assert documents_with_pii(spark, SF).count() == sum(bool(r["spans"]) for r in rec)


def test_deidentify_leaves_the_rest_alone(spark):
    rows = [(1, "a@b.co", "x", 5), (2, None, "10.0.0.1", 6), (3, "  ", "", None)]
    df = spark.createDataFrame(rows, "id int, a string, b string, n int")
    out = [tuple(r) for r in job.deidentify(df, ["a"], Policy()).orderBy("id").collect()]
    assert out == [(1, "<EMAIL_ADDRESS>", "x", 5), (2, None, "10.0.0.1", 6), (3, "  ", "", None)]
    totals = {(r["column"], r["entity_type"]): r["n"] for r in job.column_totals(df, ["a", "b"], Policy()).collect()}
    assert totals == {("a", "EMAIL_ADDRESS"): 1, ("b", "IP_ADDRESS"): 1}
    with pytest.raises(ValueError):
        job.deidentify(df, ["n"], Policy())
    with pytest.raises(job.NoTextColumns):
        job.deidentify(df, [], Policy())


def test_deidentify_plan_is_one_narrow_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = job.deidentify(docs.select("doc_id", "text"), ["text"], Policy())._jdf.queryExecution().executedPlan().toString()
    for word in ("Exchange", "Python", "BatchEval", "Join"):
        assert word not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_observed_counts(spark, tmp_path):
    df = spark.createDataFrame([("a@b.co c@d.co",), ("10.0.0.1",)], "t string")
    out, watch = job.observed(df, ["t"], Policy(), "job-9")
    out.write.parquet(str(tmp_path / "o"))
    assert watch.get["rows"] == 2 and watch.get["entities:t"] == 3 and watch.get["type:EMAIL_ADDRESS"] == 2
    stats = job.job_stats(df.withColumn("id", F.monotonically_increasing_id()), "id", ["t"], Policy(), "job-9").first()
    assert stats["total_entities"] == 3 and stats["entity_counts"]["IP_ADDRESS"] == 1
    assert len(stats["sample_after"]) == 2


def test_quarantine(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, t string")
    good, bad = job.split_quarantine(job.flag_errors(df, {"text": F.length("t") > 0}))
    assert [r["id"] for r in good.collect()] == [1] and bad.first()["_error"] == "text"


def test_text_columns(spark):
    df = spark.createDataFrame([(i, f"w{i}", "two words here", "x") for i in range(5)] + [(9, "a@b.co", None, None)],
                               "id int, code string, note string, tag string")
    assert profile.detect_text_columns(df) == ["code", "note"]
    assert profile.detect_text_columns(df, "id", 3) == ["note"]
    assert profile.detect_text_columns(df.select("id", "tag")) == ["tag"]
    assert sorted(r["column"] for r in profile.choose_columns(profile.profile_columns(df)).collect()) == ["code", "note"]


def test_progress_rules(spark):
    rows = [("j", 0, 1, 142.345, 21, None, "old", "RUNNING", "t1", 10.0), ("j", 1, 2, None, None, 50, "new", None, "t2", 20.0)]
    df = spark.createDataFrame(rows, "job_id string, source_rank int, seq long, pct double, processed long, total long, "
                                     "message string, status string, ts string, updated_at double")
    r = job.latest_progress(df).first()
    assert (r["pct"], r["processed"], r["total"], r["message"], r["status"], r["updated_at"]) == (100.0, 21, 50, "new", "running", 20.0)
