import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

SCHEMA = "doc_id long, text string, ka string, n_words int, kept string, score string, fingerprint int, _text string"


def frame(spark, rows, clashing=True):
    """Rows (doc_id, text), with columns whose names the operators use themselves."""
    if not clashing:
        return spark.createDataFrame(rows, "doc_id long, text string")
    return spark.createDataFrame([(d, t, "x", 1, "y", "z", 2, "u") for d, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def corpus():
    """Made texts: copies, near copies, shared passages and lines, odd white space, nulls, empties, a very long one."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    line, passage = "  A common LINE that many share\t", text(60)
    rows = [(i, text(rng.randint(0, 120))) for i in range(40)]
    rows += [(40 + i, rows[i][1]) for i in range(5)]
    base = text(400)
    for i in range(30):
        w = base.split()
        for _ in range(rng.choice((1, 3, 8, 20))):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((100 + i, " ".join(w)))
    rows += [(200 + i, text(20) + "\n" + line + "\n" + text(5) + "  " + passage + " " + text(9)) for i in range(8)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "one"), (304, "one two"), (305, "One TWO"), (None, passage),
             (None, None), (306, text(30_000)), (7, rows[7][1]), (8, "another text with the same id"), (307, "é ü 日本 😀 " * 20),
             (-5, passage + "\n" + line), (308, "x" * 5000)]
    return rows
