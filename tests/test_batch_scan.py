"""The recognisers over Arrow batches find what the expression form finds."""

import cProfile
import random

import pyarrow as pa
from pyspark.sql import functions as F

from redactory import registry as reg
from redactory.catalog.planted import planted
from redactory.operators import scan
from redactory.operators.detect import detect
from redactory.operators.resolve import keep_best
from redactory.operators.rewrite import rewrite
from redactory.policy import Policy

SMOKE = "/root/testdata/sf0.001"
PARTS = [
    "a@b.cc-x@d.ee", "x..y@mail.example.org,z@q.io", "@@@", "é@é.fr", "bob@example.com", "phone", "call", "tel", "telephone", "CALL",
    "(555) 205-6082", "+1 555-867-5309", "555.867.5309", "5558675309", "435-82-0665", "000-12-3456", "123 45 6789", "982-75-8615",
    "ssn", "SSN:", "itin", "tax id", "A78607395", "passport", "Passport", "B6961778", "license", "driver", "9251969915", "account",
    "acct", "bank", "GB05NWBK05975270953546", "GB82WEST12345698765432", "iban", "AB6864345", "AB1234563", "dea", "4004420239480815", "card",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "visa", "https://shop.example.com/o/1?q=é", "http://x", "10.5.194.7", "300.1.1.1", "ip",
    "ip10.0.0.1", "1972-04-06", "1973-02-29", "2000-02-29", "1900-02-29", "0000-01-01", "1972-13-01", "3/4/2021", "12/31/99", "dob", "date",
    "_12345678", "12345678_", "x12345678", "é12345678", "12345678é", "\n", "\t", "\x02", "\x03", "\x1f", ";", ", ", ". ", "日本語", "K", "İ",
    "ﬁ", "😀", "word", "straße", "ΑΣ", "²", "12345678901234567890123", "0" * 40, "x" * 120, "é" * 99, " " * 101, "a b c d e f",
]


def texts_of(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) + r.choice(["", " ", " ", " ", "-"]) for _ in range(r.randrange(60))) for _ in range(n)]


def test_batches_and_expressions_find_the_same(spark):
    texts = texts_of(300, 1) + [None, "", "  \n", "call " * 300 + "555-867-5309 é " + "1972-04-06 " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, note string").repartition(4)
    policies = [Policy(), Policy(explain=False, threshold=0.0), Policy(threshold=0.8, entities=("URL", "IP_ADDRESS", "IBAN_CODE")),
                Policy(allow=("1972-04-06",), deny=("word", "bob@example.com"))]
    for policy in policies:
        found = detect(df, "note", policy, "a").persist()
        other = detect(found, "note", policy, "b", dense=True).where("NOT (a <=> b)").select("note", "a", "b").take(1)
        assert not other, (policy, other)
        best = found.withColumn("a", F.expr(keep_best("a"))).persist()
        other = detect(best, "note", policy, "b", dense=True, best=True).where("NOT (a <=> b)").select("note", "a", "b").take(1)
        assert not other, (policy, other)
        best.unpersist()
        found.unpersist()


def test_a_batch_is_read_in_slices(monkeypatch):
    texts = pa.array(texts_of(200, 2) + [None, ""])
    whole = scan.spans_of_batch(texts, Policy()).to_pylist()
    assert sum(map(len, whole)) > 500
    monkeypatch.setattr(scan, "SLICE_BYTES", 300)
    assert scan.spans_of_batch(texts, Policy()).to_pylist() == whole
    assert scan.spans_of_batch(texts.slice(50, 30), Policy()).to_pylist() == whole[50:80]
    assert scan.spans_of_batch(texts.slice(0, 0), Policy()).to_pylist() == []


def test_patterns_read_the_same_bytes_in_any_text():
    assert all(r.pattern.isascii() for r in reg.REGISTRY)
    assert {r.validator for r in reg.REGISTRY} - {None} == set(scan.VALID)


def test_texts_that_are_not_utf8(spark):
    rows = spark.sql("SELECT cast(concat(X'FEFF41', encode(' mail bob@example.com', 'utf-8')) as string) AS note")
    spans = detect(rows, "note", Policy(), dense=True).first()["spans"]
    assert [s["entity_type"] for s in spans] == ["EMAIL_ADDRESS"]


def test_spans_in_any_order_are_resolved_alike(spark):
    df = detect(spark.createDataFrame([(i, t) for i, t in enumerate(texts_of(300, 3))], "id int, note string"), "note", Policy(threshold=0.0))
    df = df.select("spans", F.expr("reverse(spans)").alias("turned"), F.shuffle("spans").alias("mixed")).persist()
    same = df.select(F.expr(keep_best("spans")).alias("a"), F.expr(keep_best("turned")).alias("b"), F.expr(keep_best("mixed")).alias("c"))
    assert same.where("a <=> b AND a <=> c").count() == 300
    assert same.where("size(a) > 3").count() > 100
    df.unpersist()


def test_no_python_calls_a_span(spark):
    """A text of eleven spans costs few calls, those of overlapping runs (before, each context word and validator took some)."""
    notes = [r.note for r in planted(spark, SMOKE).select("note").limit(1500).collect()]

    def calls(n):
        profile = cProfile.Profile()
        profile.runcall(scan.spans_of_batch, pa.array(notes[:n]), Policy(explain=False), True)
        return sum(entry.callcount for entry in profile.getstats())

    assert calls(1500) - calls(300) < 5 * 1200


def test_context_in_cut_and_foreign_windows(spark):
    tail = " 555-867-5309"
    texts = ["xx" + "call" + "y" * 96 + tail, "recall" + "." * 96 + tail, "recall" + "." * 95 + tail, "Call é" + tail, "écall" + tail,
             "call" + " a" * 4 + tail, "call" + " a" * 5 + tail, "call", "555-867-5309", "call(555)867-5309", "call(555) 867-5309"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, note string").coalesce(1)
    policy = Policy(entities=("PHONE_NUMBER",), threshold=0.0)
    both = detect(detect(df, "note", policy, "a"), "note", policy, "b", dense=True).orderBy("id").collect()
    assert [r.a for r in both] == [r.b for r in both]
    assert len({s["score"] for r in both for s in r.b}) == 2


def test_resolved_spans_are_rewritten_alike(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts_of(100, 4) + [None, ""])], "id int, note string")
    policy = Policy(operator="hash", salt="s", explain=False)
    known = detect(df, "note", policy, dense=True, best=True)
    out = rewrite(rewrite(known, "note", "spans", policy, "a"), "note", "spans", policy, "b", resolved=True)
    assert out.where("a <=> b").count() == 102
