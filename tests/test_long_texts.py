"""Texts with very many matches: the same result as for short ones, in time that is linear in the matches."""

import time

from redactory import Policy
from redactory.operators.detect import detect
from redactory.operators.rewrite import annotate, rewrite


def lines(n):
    return [f"wörd 😀 mail{i}@example.org and 10.0.{i % 256}.7 call (555) 123-{i % 10000:04d} end" for i in range(n)]


def test_many_matches_are_rewritten_in_linear_time(spark):
    policy = Policy()
    seconds = {}
    one = {t: r for t, r in rewrite(detect(spark.createDataFrame([(t,) for t in lines(500)], "t string"), "t", policy),
                                    "t", "spans", policy).select("t", "anonymized_text").collect()}
    for n in (100, 1000, 10_000):
        df = spark.createDataFrame([("\n".join(lines(n)),)], "t string").repartition(1)
        began = time.time()
        row = rewrite(detect(df, "t", policy), "t", "spans", policy).first()
        seconds[n] = time.time() - began
        assert len(row.spans) == 3 * n
        assert all(row.t[s.start:s.end] == s.text for s in row.spans)
        assert row.anonymized_text.split("\n")[:500] == [one[t] for t in lines(n)[:500]]
    # Ten times the matches take at most some twenty times as long; what grows with the square takes a hundred times.
    assert seconds[10_000] < 20 * max(seconds[1000], 0.5), seconds


def test_chunk_borders(spark):
    """Matches around the places where a long text is cut."""
    policy = Policy(entities=("EMAIL_ADDRESS",), explain=False)
    texts = ["é" * k + " a@example.org " + "x" * 3000 + " b@example.org_ c@example.org" for k in (0, *range(1005, 1030), 2040, 2047, 2048)]
    found = annotate(detect(spark.createDataFrame([(t,) for t in texts], "t string"), "t", policy), "t").collect()
    for row in found:
        assert [s.text for s in row.spans] == ["a@example.org", "c@example.org"], len(row.t)
        assert all(row.t[s.start:s.end] == s.text for s in row.spans)
        assert row.annotated.count("`a@example.org` *(Email Address") == 1 and row.annotated.startswith(row.t[:row.spans[0].start])
