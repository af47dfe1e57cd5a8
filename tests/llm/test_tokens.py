"""BPE and packing against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import frame
from pyspark.sql import functions as F

import corpus_pipeline
from redactory.llm import bpe, packing, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a  b", "a   b", " \n b", "foo\n \nbar", "x \n", "it's we'll I'd 'S", "<|endoftext|>",
       "a <|endoftext|> b<|endoftext|>", "日本語 १२३ ½²Ⅷ", "é́ ñ x", "\t\ttab  \r\n\r\n", "\x1c\x1d a\x85b", "😀 👩‍👩‍👧",
       "a" * 500 + " " + "ab" * 300, "no\0null \0 x", "end  ", "tab\t x\t\ty", "_a_b 12ab 3.14", "&&& The*** 's"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load_vocabulary(PATH)


def test_ids_and_texts_equal_the_library(library, vocabulary, corpus):
    texts = ODD + [t or "" for _, t in corpus]
    words = [w for t in texts for w in (" " + x for x in t.split(" ") if x)]
    for lexicon in (None, bpe.compile_lexicon(words[::2], vocabulary), bpe.compile_lexicon([], vocabulary)):
        encoder = bpe.Encoder(vocabulary, lexicon)
        encoder.words.forget()
        ids, ends = encoder.encode(pa.array(texts, pa.large_string()))
        for i, text in enumerate(texts):
            wanted = library.encode(text, add_special_tokens=False).ids
            assert ids[ends[i]:ends[i + 1]].tolist() == wanted, text
        assert encoder.decode(ids, ends) == [
            library.decode(library.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for t in texts]


def test_automaton_accepts_its_words_alone(vocabulary):
    words = sorted({b"a", b"ab", b"abc", b"xbc", b"xab", "é".encode()})
    lexicon = bpe.Lexicon(*bpe.minimal_automaton(words), np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64))
    asked = [*words, b"b", b"abcd", b"xb", b"\xc3"]
    blob, sizes = np.frombuffer(b"".join(asked), dtype=np.uint8), np.array([len(w) for w in asked])
    places = lexicon.places(blob, np.cumsum(sizes) - sizes, sizes)
    assert places.tolist() == [*range(len(words)), -1, -1, -1, -1]
    back = bpe.Lexicon.of(np.frombuffer(lexicon.to_bytes(), dtype=np.int64))
    assert (np.asarray(back.keys) == lexicon.keys).all() and len(lexicon.accepting) < sum(map(len, words))


def test_words_forgotten_at_the_bound(vocabulary):
    words = bpe.Words(vocabulary, most=3)
    for some in (["ab", "cd"], ["ef", "gh"], ["ab", "x", "y", "z", "w"], ["ab"]):
        places = words.look_up(some)
        assert len(places) == len(some)
    assert len(words.place) == 1


def test_encode_documents(spark, library, corpus):
    rows = [(d, t) for d, t in corpus if d != 306] + [(900 + i, t) for i, t in enumerate(ODD)]
    got = bpe.encode_documents(frame(spark, rows), PATH, lexicon_words=50).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.decoded) for r in got) == sorted(
        (d is None, d or 0, t or "") for d, t in rows)
    assert all(r.ids == library.encode(r.decoded, add_special_tokens=False).ids for r in got)
    assert bpe.encode_digests(frame(spark, []), PATH).count() == 0


def test_every_id_lies_in_one_piece(spark, library, corpus):
    rows = [(i, t) for i, (_, t) in enumerate(corpus)]
    ids = packing.pack_documents(frame(spark, rows), PATH).collect()
    short = packing.pack_documents(frame(spark, rows), PATH, content="ids_crc32").collect()
    by_doc, sequences = {}, {}
    for r in ids:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.ids))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.length == len(r.ids)
    for d, t in rows:
        joined = [i for _, part in sorted(by_doc[d]) for i in part]
        assert joined == library.encode(t or "", add_special_tokens=False).ids + [1]
        assert [s for s, _ in sorted(by_doc[d])] == [k * 2048 for k in range(len(by_doc[d]))]
    for parts in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048
    assert sorted(sequences) == list(range(len(sequences)))
    crc = {(r.doc_id, r.start): zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) for r in ids}
    assert {(r.doc_id, r.start): r.ids_crc32 for r in short} == crc
    assert packing.pack_documents(frame(spark, []), PATH).count() == 0


def test_queries_and_pipeline_keep_the_ids(spark, library, tmp_path, monkeypatch):
    """Digests come from the operators' own ids and texts; equal ids, null ids and repeated rows included."""
    rows = [(1, "a b"), (1, "a b"), (1, "a c"), (None, None), (2, "word " * 5000), (3, "")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids
    raw = lambda some: np.array(some, dtype="<u4").tobytes()
    packed = corpus_pipeline.pack(spark, frame(spark, rows), "").collect()
    wanted = [(d, k, (ids(t) + [1])[k:k + 2048]) for d, t in rows for k in range(0, len(ids(t)) + 1, 2048)]
    order = lambda some: sorted(some, key=lambda r: (r[0] or 0, *r[1:]))
    assert order((r.doc_id, r.start, r.ids) for r in packed) == order(wanted)
    assert all(r.ids_crc32 == zlib.crc32(raw(r.ids)) and r.length == len(r.ids) for r in packed)
    monkeypatch.setattr(bpe, "encode_digests", None)
    kept = []
    monkeypatch.setattr(packing, "pieces", lambda *a, f=packing.pieces: kept.append(f(*a)) or kept[-1])
    got = queries.op7_packing(spark, str(tmp_path)).collect()
    assert "ids" in kept[0].columns
    assert order((r.doc_id, r.start, r.ids_crc32) for r in got) == order((d, k, zlib.crc32(raw(i))) for d, k, i in wanted)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert order(tuple(r) for r in queries.op8_bpe(spark, str(tmp_path)).collect()) == order(
        (d, len(ids(t)), sha(raw(ids(t))), sha((t or "").encode())) for d, t in rows)


def test_plan_uses_every_piece_once_with_little_padding():
    rng = np.random.default_rng(0)
    for counts in (np.bincount(np.clip(rng.gamma(3, 30, 20_000).astype(int), 1, 256), minlength=257),
                   np.bincount([5] * 1000, minlength=257), np.zeros(257, dtype=int)):
        used = np.zeros(257, dtype=np.int64)
        n = 0
        for pattern, repeat in packing.plan(counts, 256):
            assert sum(pattern) <= 256
            used += np.bincount(pattern, minlength=257) * repeat
            n += repeat
        assert (used == counts).all()
        filled = (counts * np.arange(257)).sum()
        assert n == 0 or filled / (256 * n) > 0.93


@pytest.mark.parametrize("window, grain", [(2048, 8), (2048, 128), (32, 8), (64, 1), (256, 64)])
def test_every_length_has_the_smallest_level_that_holds_it(spark, window, grain):
    sizes = packing.level_sizes(window, grain)
    got = [r.level for r in spark.range(1, window + 1).select(
        packing.level_of(F.col("id"), sizes, grain).alias("level"), "id").sort("id").collect()]
    assert got == np.searchsorted(sizes, np.arange(1, window + 1)).tolist()


@pytest.mark.parametrize("text, n, most", [("", 2048, 1), (None, 4096, 2), ("a b", 4096, 7)])
def test_short_texts_fill_their_windows(spark, text, n, most):
    """Also where all rows have one id, or none."""
    rows = [(None if i % 3 else 7, text) for i in range(n)]
    packed = packing.pack_documents(frame(spark, rows, clashing=False), PATH).groupBy("sequence_id").agg(
        F.sum("length").alias("ids"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count("*").alias("n")).collect()
    assert len(packed) == most and sum(r.n for r in packed) == n
    assert all(r.ids == r.end <= 2048 for r in packed)


def test_plan_with_exact_levels_uses_every_piece_once():
    sizes = packing.level_sizes(2048, 8)
    rng = np.random.default_rng(1)
    for scale in (3, 60, 900):
        counts = np.bincount(np.searchsorted(sizes, np.clip(rng.gamma(1, scale, 50_000).astype(int), 1, 2048)), minlength=len(sizes))
        used, n = np.zeros(len(sizes), dtype=np.int64), 0
        for pattern, repeat in packing.plan(counts, 256, sizes):
            assert sizes[list(pattern)].sum() <= 2048
            used += np.bincount(pattern, minlength=len(sizes)) * repeat
            n += repeat
        assert (used == counts).all()
        assert (counts * sizes).sum() / (2048 * n) > 0.97
