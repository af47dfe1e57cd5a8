"""Lines, near copies and passages against plain versions."""

from collections import Counter

import plain
import pytest
from conftest import frame

from redactory.llm import common, jaccard_join, line_dedup, phrase_dedup


def test_lines(spark, corpus):
    got = line_dedup.dedup_lines(frame(spark, corpus))
    assert got.columns[:2] == ["doc_id", "text"] and "ka" in got.columns
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == plain.without_lines(corpus)


def test_lines_of_other_bounds(spark, corpus):
    got = line_dedup.dedup_lines(frame(spark, corpus), min_chars=5, min_documents=2).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got) == plain.without_lines(corpus, 5, 2)


def test_passages(spark, corpus):
    got = phrase_dedup.remove_repeats(frame(spark, corpus)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == plain.without_passages(corpus)
    assert all(r.ka == "x" and r.score == "z" for r in got)


def test_passages_shorter_and_in_small_chunks(spark, corpus):
    got = phrase_dedup.remove_repeats(frame(spark, corpus, False), window=6, phrase=4, chunk_bytes=5000,
                                      shard_bytes=5000).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == plain.without_passages(corpus, 6)


def test_automaton_whatever_the_digits(spark, corpus, monkeypatch):
    import pyarrow as pa
    table = pa.table({"doc_id": pa.array([d for d, _ in corpus], pa.int64()), "text": pa.array([t for _, t in corpus])})
    found = []
    for digits in (phrase_dedup.DIGITS, 2, 5000):
        monkeypatch.setattr(phrase_dedup, "DIGITS", digits)
        chunk = phrase_dedup.Chunk(table, 13, 5)
        found.append(chunk.located(chunk.key_entries()[0][::2]))
    assert found[0].any() and not found[0].all() and (found[0] == found[1]).all() and (found[0] == found[2]).all()


def rows_of(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


@pytest.mark.parametrize("percent, size", [(90, 3), (80, 5)])
def test_components(spark, corpus, percent, size):
    got = jaccard_join.jaccard_components(frame(spark, corpus), percent=percent, shingle=size)
    assert rows_of(got) == plain.jaccard_components(corpus, percent, size)


def test_components_of_blocks_cut_into_parts(spark, corpus):
    got = jaccard_join.jaccard_components(frame(spark, corpus, False), percent=80, task_sets=4, task_bytes=20_000)
    assert rows_of(got) == plain.jaccard_components(corpus, 80, 3)


def test_components_of_sets_represented_by_part(spark, corpus, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MANY", 60)
    import pyarrow as pa
    import numpy as np
    sets = jaccard_join.ShingleSets(pa.array([t for _, t in corpus]))
    small, large, short = jaccard_join.universes(sets, 90, np.ones(len(sets), dtype=bool))
    assert len(small.hashes) and len(large.hashes) and (large.need[np.unique(large.doc_of)] > 0).mean() > 0.9
    assert set(short.doc_of) == set(large.doc_of[large.need[large.doc_of] <= 0]) | (
        set(np.nonzero(sets.sizes >= 60)[0]) - set(large.doc_of))


@pytest.mark.parametrize("pairs", [
    [], [(1, 1), (None, 2), (3, None)], [(k, k + 1) for k in range(300)], [(0, k) for k in range(1, 400)],
    [(900, k) for k in range(400)] + [(900, 2000), (2000, 5000), (-7, 5000)],
    [(k * 7919 % 1009, (k + 1) * 7919 % 1009) for k in range(1, 1000) if k % 90] + [(5, 5), (1, 1)]])
def test_components_of_chains_and_stars(spark, pairs):
    got = common.components(spark.createDataFrame(pairs, "a long, b long"), "test")
    known = [(a, b) for a, b in pairs if a is not None and b is not None and a != b]
    root = {x: x for pair in known for x in pair}
    while any(root[a] != root[b] for a, b in known):
        for a, b in known:
            root[a] = root[b] = min(root[a], root[b])
    assert sorted((r.id, r.root) for r in got.collect()) == sorted(root.items())


@pytest.mark.parametrize("part", [0.25, 0.11, 0.02, 0.0])
def test_linked_sets_meet_however_little_the_part_holds(corpus, part):
    import numpy as np
    import pyarrow as pa
    texts = [t for _, t in corpus]
    sets = jaccard_join.ShingleSets(pa.array(texts))
    parts = jaccard_join.universes(sets, 90, np.ones(len(sets), dtype=bool), many=20, part=part)
    keys, counts = jaccard_join.chunk_entries(parts)
    tokens = {}
    for p in parts:
        length = np.where(counts > 1, counts, 0)[np.searchsorted(keys, p.hashes)]
        for token, doc in zip(*(x.tolist() for x in p.prefixes(length, len(sets)))):
            tokens.setdefault(doc, set()).add(token)
    own = [plain.shingles(t, 3) for t in texts]
    links = [(i, j) for i, a in enumerate(own) for j, b in enumerate(own[:i])
             if a and b and 100 * len(a & b) >= 90 * len(a | b)]
    assert links and all(tokens[i] & tokens[j] for i, j in links)


def test_divide_skip_finds_every_link(corpus):
    import numpy as np
    import pyarrow as pa
    texts = [t for _, t in corpus]
    sets = jaccard_join.ShingleSets(pa.array(texts))
    found = {(q, int(x)) for q, hits in jaccard_join.divide_skip(sets, np.arange(len(sets)), 70) for x in hits}
    own = [plain.shingles(t, 3) for t in texts]
    wanted = {(i, j) for i, a in enumerate(own) for j, b in enumerate(own)
              if i != j and a and b and 100 * len(a & b) >= 70 * len(a | b)}
    assert found == wanted


@pytest.mark.parametrize("operator", [line_dedup.dedup_lines, phrase_dedup.remove_repeats, jaccard_join.jaccard_components])
def test_empty_tables(spark, operator):
    assert operator(frame(spark, [])).count() == 0
    assert operator(frame(spark, [(None, None), (None, "")])).count() == 2
