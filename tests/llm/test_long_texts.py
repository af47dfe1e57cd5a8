"""Texts that would be slow or too large if work grew with the square of their length; and the contract of the queries."""

import time

import pytest
from conftest import frame

from redactory.llm import license_scan, line_dedup, queries


def test_many_notices_in_one_text(spark):
    name, notice = license_scan.TEMPLATES[0]
    text = "\n".join(f"{i} {notice} {i}" for i in range(10_000))
    got = license_scan.scan_licenses(frame(spark, [(1, text), (2, "none")])).collect()
    assert {r.doc_id: r.licenses for r in got} == {1: [name], 2: []}
    matches = license_scan.license_matches(frame(spark, [(1, text)])).where(f"license = '{name}'")
    assert matches.select("shingle_at").distinct().count() >= 10_000


def test_long_white_space_and_many_lost_lines(spark):
    shared = [f"line {i} that three documents share" for i in range(100_000)]
    text = "\n".join(shared)
    rows = [(1, text), (2, text), (3, "own line of the third one, kept\n" + text), (4, "word" + " " * 1_000_000 + "word"),
            (5, "\t" * 1_000_000 + "the end of a long line\n" * 2), (6, "the end of a long line"), (7, "the end of a long line")]
    began = time.time()
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert time.time() - began < 60
    assert [got[d].n_dropped for d in range(1, 8)] == [100_000, 100_000, 0, 0, 2, 1, 0]
    assert got[1].text == "" and got[3].text == rows[2][1] and got[4].text == rows[3][1] and got[5].text == ""


# Queries that SQL cannot express; they are held against plain versions, libraries or held-out rows in these tests.
WITHOUT_SQL = {"op1_fingerprints", "op3_toxicity", "op6_ann", "op7_packing", "op8_bpe", "op11_spelling", "op12_token_files",
               "op13_alignment"}


def test_queries_without_statement_are_named():
    assert set(queries.queries()) - set(queries.statements()) == WITHOUT_SQL
    assert set(queries.statements()) <= set(queries.queries())


@pytest.mark.parametrize("n", range(1, 14))
def test_one_query_an_operator(n):
    assert sum(name.startswith(f"op{n}_") for name in queries.queries()) == 1
