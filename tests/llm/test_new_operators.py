"""Spelling variants, token files and tokenizer alignment against plain versions and the libraries."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import frame
from plain import LOWER

from redactory.llm import alignment, queries, spelling, token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


# --- spelling --------------------------------------------------------------------------------

def plain_words(rows):
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{d}:{run}".encode())
            if d is not None and h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long_ = sorted((a, b), key=len)
    return any(long_[:i] + long_[i + 1:] == short for i in range(len(long_)))


def plain_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def spelled_corpus():
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdeé÷ñqr") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    rows = []
    for i in range(400):
        words = []
        for _ in range(30):
            w = rng.choice(base[:int(rng.random() ** 2 * 60) + 1])
            if rng.random() < .2:
                k = rng.randrange(len(w))
                w = rng.choice((w[:k] + w[k + 1:], w[:k] + rng.choice("abz") + w[k + 1:], w[:k] + "c" + w[k:]))
            words.append(w.upper() if rng.random() < .1 else w)
        rows.append((rng.randrange(150), rng.choice(" -,1Ā¿").join(words)))
    return rows + [(None, "Aaaaa aaaaa aaaaa AAAAB"), (3, None), (4, ""), (5, "a" * 70 + " " + ("e" * 18 + " ") * 3 + ("e" * 17 + " ") * 7),
                   (6, "abcde" * 20_000), (7, ("x" * 300 + " ") * 4 + ("x" * 301 + " ") * 9)]


def test_variants_equal_plain(spark):
    rows = spelled_corpus()
    words = plain_words(rows)
    assert len(words) > 300
    wanted = sorted(plain_variants(words))
    for block_words in (spelling.BLOCK_WORDS, 40):
        got = spelling.group_variants(frame(spark, rows), block_words)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert sorted(tuple(r) for r in got.collect()) == wanted
    assert any(f and r != f for _, f, r, *_ in wanted)
    assert spelling.group_variants(frame(spark, [])).count() == 0
    assert spelling.group_variants(frame(spark, [(1, "short"), (None, None)])).count() == 0


def test_walks_reach_all_vectors_within_the_budget():
    rng = np.random.default_rng(1)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 9, rng.integers(5, 9))) for _ in range(3000)] + ["e" * 40, "e" * 41]
    vectors = spelling.Letters(words).vectors()
    digits = (vectors[:, None] >> (4 * np.arange(16))) & 15
    trie = spelling.Trie(vectors[::2])
    got = {(int(w), int(v)) for word, leaf in trie.walk(vectors) for w, v in zip(word, leaf)}
    leaves = np.unique(vectors[::2])
    step = ((leaves[:, None] >> (4 * np.arange(16))) & 15)[None] - digits[:, None]
    within = (np.abs(step).max(axis=2) <= 1) & ((step > 0).sum(axis=2) <= 1) & ((step < 0).sum(axis=2) <= 1)
    assert got == {(i, int(leaves[j])) for i, j in zip(*np.nonzero(within))}
    cuts = np.array_split(np.sort(vectors), 37)
    borders = spelling.Borders(np.arange(37), np.array([c[0] for c in cuts]), np.array([c[-1] for c in cuts]))
    word, block = borders.reached(vectors)
    reached = set(zip(word.tolist(), block.tolist()))
    assert len(reached) == len(word)
    for i, v in got:
        for k, c in enumerate(cuts):
            assert not (c[0] <= v <= c[-1] and v in c) or (i, k) in reached


# --- token files -----------------------------------------------------------------------------

ODD = ["", " ", "  a b  ", "it's we'll I'D 'S", "<|endoftext|>", "a <|startoftext|>b<|endoftext|> c", "日本語 १२३ ½²Ⅷ", "é ñ x ΑΣ Σ",
       "\x1c\x1d a\x85b", "😀 👩‍👩‍👧", "a" * 500 + " " + "ab" * 300, "no\0null \0 x", "İstanbul ́x"]


@pytest.fixture(scope="module")
def word_library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def token_rows(corpus):
    rows = [(i if d is not None else None, t) for i, (d, t) in enumerate(corpus)] + [(900 + i, t) for i, t in enumerate(ODD)]
    return rows + [(5, "the same id"), (5, "the same id"), (-7, "below zero"), (None, "no id"), (2**62, "far away")]


def test_files_hold_the_librarys_ids_in_order(spark, word_library, token_rows):
    ids = lambda t: word_library.encode(t or "", add_special_tokens=False).ids + [1]
    for shard_bytes in (token_files.SHARD_BYTES, 300):
        folder = token_files.write_tokens(frame(spark, token_rows).repartition(3), WORD, shard_bytes=shard_bytes)
        got = sorted(token_files.read_documents(spark, folder).collect(), key=lambda r: r.start)
        keys = [r.doc_id for r in got]
        assert keys == sorted(keys, key=lambda d: (d is not None, d or 0))
        assert [r.start for r in got] == np.cumsum([0] + [len(r.ids) for r in got])[:-1].tolist()
        assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((d, tuple(ids(t))) for d, t in token_rows)
        asked = [(5, ""), (5, ""), (-7, ""), (12345, ""), (2**62, ""), (None, ""), (40, "")]
        some = token_files.fetch(spark, folder, frame(spark, asked)).collect()
        assert Counter((r.doc_id, r.start, tuple(r.ids)) for r in some) == Counter(
            (r.doc_id, r.start, tuple(r.ids)) for r in got if r.doc_id in (5, -7, 2**62, 40))
    empty = token_files.write_tokens(frame(spark, []), WORD)
    assert token_files.read_documents(spark, empty).count() == 0
    assert token_files.fetch(spark, empty, frame(spark, [(1, "")])).count() == 0
    bare = token_files.write_tokens(frame(spark, [(None, "a"), (None, None)]), WORD)
    assert sorted(len(r.ids) for r in token_files.read_documents(spark, bare).collect()) == [1, 2]


def test_hash_is_minimal_and_perfect_and_rejects_others():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000, 100_000):
        keys = np.unique(rng.integers(-2**62, 2**62, n))
        perfect = token_files.PerfectHash.of(keys)
        assert np.array_equal(np.sort(perfect.slots(keys)), np.arange(len(keys)))
        repeated = np.sort(np.concatenate([keys, keys[:5]]))
        index = token_files.Index.of(repeated, np.arange(len(repeated) + 4) * 3, 2)  # three documents without key
        index = token_files.Index.from_bytes(index.to_bytes())
        first, copies = index.lookup(keys)
        assert np.array_equal(index.keys[first - 3], keys) and copies.sum() == len(repeated) and index.n_without_key == 3
        others = np.setdiff1d(rng.integers(-2**62, 2**62, 1000), keys)
        assert (index.lookup(others)[0] == -1).all()


def test_memory_of_words_is_bounded(word_library):
    for cut, marked in ((False, ""), (True, ""), (True, "a\x01b \x01 c")):
        encoder = token_files.WordEncoder(word_library, cut, most=3, most_ids=700, longest=200)
        texts = ["a b c, d. e", "f g " + "x" * 1000, "a " + "x" * 1000 + " b", "", "a, b... c's <|endoftext|> d!" + "y" * 300, *([marked] if marked else [])]
        for _ in range(3):
            ids, counts = encoder.encode(pa.array(texts, pa.large_string()))
            ends = np.cumsum([0, *counts])
            assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [
                word_library.encode(t, add_special_tokens=False).ids for t in texts]
            assert len(encoder.words.place) <= 20 and max(map(len, encoder.words.place)) <= 200


# --- alignment -------------------------------------------------------------------------------

def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer
    a, b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    from redactory.llm.bpe import byte_symbols
    symbols = byte_symbols()
    raw_a = lambda i: bytes(symbols[c] for c in a.id_to_token(i))
    raw_b = lambda i: (bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
                       else b.id_to_piece(i).replace("▁", " ").encode())
    docs, counts = [], Counter()
    for d, t in rows:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        p, q = b"".join(map(raw_a, x)), b"".join(map(raw_b, y))
        if not (t and p == q == (" " + t).encode()):
            x, y = [], []
        ends = lambda ids, raw: np.cumsum([len(raw(i)) for i in ids]).tolist()
        ea, eb = ends(x, raw_a), ends(y, raw_b)
        groups, i, j = [], 0, 0
        for e in sorted(set(ea) & set(eb)):
            groups.append((x[i:ea.index(e) + 1], y[j:eb.index(e) + 1]))
            i, j = ea.index(e) + 1, eb.index(e) + 1
        links = Counter((u, v) for g, h in groups for u in g for v in h)
        counts.update(set(links))
        docs.append((d, x, y, groups, links))
    best = defaultdict(int)
    for (u, _), n in counts.items():
        best[u] = max(best[u], n)
    out = []
    for d, x, y, groups, links in docs:
        shown = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((d, len(x), len(y), len(groups), sum(links.values()),
                    sum(n for p, n in links.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in links.items()), shown))
    return out


def aligned_rows(corpus):
    rng = random.Random(8)
    odd = ODD + ["a  b\n c\t\td <s> </s> <0x41>", "▁x", "x▁", "﻿a", "a" * 3001 + "b", "".join(rng.choice("abcXYZ019+/") for _ in range(3000)),
                 "日本語テキスト" * 40, "the\r\nend", "ﬁ ① ｶﾞ", " lead", "trail ", "​x"]
    return [(d, (t or "")[:4000] if t else t) for d, t in corpus[:70]] + [(700 + i, t) for i, t in enumerate(odd)] + [
        (None, "no id"), (700, "an id again"), (9, "x" * 9), (9, "x" * 9)]


def test_alignment_equals_plain(spark, corpus):
    rows = aligned_rows(corpus)
    wanted = plain_alignment(rows)
    strings = {"shown": ("string", lambda x: [s.decode() for s in alignment.group_strings(x)])}
    got = alignment.score_links(frame(spark, rows).repartition(5), BYTE, PIECE, strings)
    assert Counter(tuple(r) for r in got.collect()) == Counter(wanted)
    assert sum(w[1] > 0 for w in wanted) > 80 and sum(w[1] == 0 for w in wanted) >= 3
    kept = alignment.align_documents(frame(spark, rows), BYTE, PIECE).collect()
    assert Counter((r.doc_id, len(r.ids_a), len(r.ids_b), len(r.sizes_a)) for r in kept) == Counter(w[:4] for w in wanted)
    assert all(sum(r.sizes_a) == len(r.ids_a) and sum(r.sizes_b) == len(r.ids_b) for r in kept)
    assert alignment.score_links(frame(spark, []), BYTE, PIECE).count() == 0
    assert alignment.score_links(frame(spark, [(1, None), (2, "")]), BYTE, PIECE).agg({"n_links": "sum"}).first()[0] == 0


def test_galloping_finds_what_is_shared():
    rng = np.random.default_rng(3)
    for n, m in ((0, 5), (1, 1), (3, 10_000), (200, 200), (5000, 70_000)):
        a, b = (np.unique(rng.integers(0, 3 * (n + m), k)) for k in (n, m))
        i, j = alignment.common_ends(a, b)
        assert np.array_equal(a[i], b[j]) and np.array_equal(a[i], np.intersect1d(a, b))


def test_links_in_blocks_and_packed_cells(monkeypatch):
    rng = np.random.default_rng(4)
    x = alignment.Aligned(rng.integers(0, 9, 900), rng.integers(0, 9, 700), np.array([0, 300, 300, 900]), np.array([0, 400, 400, 700]),
                          np.array([299, 1, 600]), np.array([1, 399, 300]), np.array([0, 2, 2, 3]))
    whole = alignment.links(x)
    monkeypatch.setattr(alignment, "PAIRS", 7)
    assert all(np.array_equal(p, q) for p, q in zip(whole, alignment.links(x)))
    assert whole[2].sum() == 299 + 399 + 180_000
    doc, place, times = np.array([0, 0, 2, 2, 2]), np.array([3, 900, 0, 254, 70_000]), np.array([1, 255, 254, 10**12, 2])
    back = alignment.unpacked(*alignment.packed(doc, place, times, 4))
    assert all(np.array_equal(p, q) for p, q in zip((doc, place, times), back))


def test_registered_queries(spark, tmp_path, word_library):
    rows = [(3, "A thing, the thyng"), (1, "x y"), (None, None), (2, "")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    ids = {d: word_library.encode(t or "", add_special_tokens=False).ids + [1] for d, t in rows}
    start, wanted = 0, []
    for d in (None, 1, 2, 3):
        wanted.append((d, start, len(ids[d]), zlib.crc32(np.array(ids[d], dtype="<u4").tobytes())))
        start += len(ids[d])
    got = queries.op12_token_files(spark, str(tmp_path)).collect()
    assert sorted(got, key=lambda r: r.start) == wanted
    assert queries.op11_spelling(spark, str(tmp_path)).count() == 0
    assert queries.op13_alignment(spark, str(tmp_path)).columns == [
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
