"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

A word is a vector of how often each of 16 groups of letters occurs.  One inserted, deleted or replaced letter
moves at most one count up by one and at most one down by one.  The words' vectors are a trie with one level
a group; a search walks it depth first and may take a count one higher once (a surplus) and one lower once
(a deficit).  What is left at the leaves is verified letter by letter.

Words are dealt to blocks by ranges of their vectors, so a block is a part of the whole trie.  The blocks' borders
are a trie of their own: the same walk over them tells which blocks a word has to be searched in.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.shared import written
from .common import offsets_of, ranges, text_slices

LEAST_LETTERS = 5
LEAST_TIMES = 3
EDIT_MODULUS = 97
# Words of a block, and pairs verified at once.
BLOCK_WORDS = 32_768
PAIRS = 1 << 17
# Letters by code point modulo 16; the levels of the trie begin with the groups of the commonest letters.
GROUPS = 16
LEVELS = (5, 1, 9, 15, 4, 14, 3, 2, 12, 8, 13, 0, 6, 7, 11, 10)
# Counts are cut off at the largest that fits; differences only shrink by that, and the first bit stays free.
MOST = np.array([7] + [15] * (GROUPS - 1))


# --- counting --------------------------------------------------------------------------------

def crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> np.uint32(1)) ^ np.uint32(0xEDB88320), out >> np.uint32(1))
    return out


_CRC = crc_table()


def crc32_from(before: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, longest: int = 48) -> np.ndarray:
    """CRC-32 of byte runs, each going on from a checksum."""
    state = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    live = np.nonzero(sizes <= longest)[0]
    for k in range(longest):
        live = live[sizes[live] > k]
        if not len(live):
            break
        s = state[live]
        state[live] = _CRC[(s ^ data[starts[live] + k]) & np.uint32(0xFF)] ^ (s >> np.uint32(8))
    out = state ^ np.uint32(0xFFFFFFFF)
    for i in np.nonzero(sizes > longest)[0].tolist():
        out[i] = zlib.crc32(data[starts[i]:starts[i] + sizes[i]].tobytes(), int(before[i]))
    return out


def letter_runs(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased, and the text that each is from."""
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0]:ends[-1]]
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inside = (data >= 97) & (data <= 122)
    lead = np.nonzero(data == 0xC3)[0]  # U+00C0 to U+00FF are all that begin with this byte
    inside[lead] = inside[lead + 1] = True
    first = (ends - ends[0])[:-1]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = first[first < len(data)]
    begins[first] = inside[first]
    starts = np.nonzero(begins)[0]
    before = offsets_of(inside)
    sizes = np.diff(np.append(before[starts], before[-1]))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [
        None, pa.py_buffer(offsets_of(sizes)), pa.py_buffer(data[inside])]).dictionary_encode()
    return words, np.searchsorted(ends - ends[0], starts, side="right") - 1


def slice_counts(doc_ids: pa.Array, texts: pa.Array) -> dict[str, int]:
    """Words of some texts with their number; one code point goes from runs that the checksum picks."""
    words, doc = letter_runs(texts)
    distinct = words.dictionary
    n = len(distinct)
    if not n:
        return {}
    pairs, times = np.unique(doc * n + words.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
    doc, word = pairs // n, pairs % n
    ends = np.frombuffer(distinct.buffers()[1], dtype=np.int64)[distinct.offset:distinct.offset + n + 1]
    data = np.frombuffer(distinct.buffers()[2], dtype=np.uint8)
    keyed = doc_ids.is_valid().to_numpy(zero_copy_only=False)[doc]
    prefix = np.array([zlib.crc32(b"%d:" % (d or 0)) for d in doc_ids.to_pylist()], dtype=np.uint32)
    h = crc32_from(prefix[doc], data, ends[word], ends[word + 1] - ends[word])
    picked = keyed & (h % EDIT_MODULUS == 0)
    whole = np.bincount(word[~picked], weights=times[~picked], minlength=n).astype(np.int64)
    # Code points are the bytes that do not go on a character.
    points = np.diff(offsets_of((data[ends[0]:ends[-1]] & 0xC0) != 0x80)[ends - ends[0]])
    kept = np.nonzero((whole > 0) & (points >= LEAST_LETTERS))[0]
    out = dict(zip(distinct.take(pa.array(kept)).cast(pa.large_string()).to_pylist(), whole[kept].tolist()))
    some = np.nonzero(picked & (points[word] > LEAST_LETTERS))[0]
    for w, at, k in zip(distinct.take(pa.array(word[some])).cast(pa.large_string()).to_pylist(),
                        (h[some] % points[word[some]]).tolist(), times[some].tolist()):
        w = w[:at] + w[at + 1:]
        out[w] = out.get(w, 0) + k
    return out


def count_words(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to ``(word, n)``: words of at least 5 code points that occur at least 3 times.

    The run's code point number h modulo its length is deleted where 97 divides h, the CRC-32 of
    ``<doc_id>:<run>``.  Without a doc_id there is no such number, and nothing is deleted.
    """
    def work(batches):
        for part in text_slices(batches):
            found = slice_counts(part.column("doc_id"), part.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())],
                                             names=["word", "n"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TIMES)


# --- the trie --------------------------------------------------------------------------------

class Letters:
    """Words as one byte a code point, all of which are below 256."""

    def __init__(self, words: list[str]):
        raw = [w.encode("latin-1") for w in words]
        self.sizes = np.array([len(r) for r in raw], dtype=np.int64)
        self.starts = offsets_of(self.sizes)
        self.data = np.frombuffer(b"".join(raw), dtype=np.uint8)

    def vectors(self) -> np.ndarray:
        """Counts of the groups, four bits a level."""
        n = len(self.sizes)
        word = np.repeat(np.arange(n), self.sizes)
        counts = np.bincount(word * GROUPS + self.data % GROUPS, minlength=n * GROUPS).reshape(n, GROUPS)
        counts = np.minimum(counts[:, LEVELS], MOST)
        return (counts << (4 * np.arange(GROUPS - 1, -1, -1))).sum(axis=1).astype(np.int64)

    def rows(self, which: np.ndarray, width: int) -> np.ndarray:
        """Padded with zeros."""
        columns = np.arange(width)
        at = np.minimum(self.starts[which][:, None] + columns, max(len(self.data) - 1, 0))
        return np.where(columns < self.sizes[which][:, None], self.data[at], 0)


def one_edit_apart(a: Letters, x: np.ndarray, b: Letters, y: np.ndarray) -> np.ndarray:
    """Whether word x[i] of a and word y[i] of b differ by one inserted, deleted or replaced code point."""
    out = np.zeros(len(x), dtype=bool)
    step = b.sizes[y] - a.sizes[x]
    for kind in (-1, 0, 1):
        some = np.nonzero(step == kind)[0]
        if not len(some):
            continue
        (p, u), (q, v) = ((b, y[some]), (a, x[some])) if kind < 0 else ((a, x[some]), (b, y[some]))
        order = np.argsort(q.sizes[v], kind="stable")  # words of like length side by side, so that few rows are wide
        for part in np.array_split(order, len(order) // PAIRS + 1):
            if not len(part):
                continue
            width = int(q.sizes[v[part]].max())
            for less in np.array_split(part, len(part) * width // (PAIRS * 64) + 1):
                short, long_ = p.rows(u[less], width), q.rows(v[less], width)
                differ = short != long_
                if kind == 0:
                    out[some[less]] = differ.sum(axis=1) == 1
                else:  # from the first difference on, the longer word is one behind
                    first = differ.argmax(axis=1)
                    later = (short[:, :-1] != long_[:, 1:]) & (np.arange(width - 1) >= first[:, None])
                    out[some[less]] = ~later.any(axis=1)
    return out


class Trie:
    """Sorted vectors as a trie: a node of a level is a prefix, kept in that level's sorted list."""

    def __init__(self, vectors: np.ndarray):
        self.levels = [vectors[:0], *(np.unique(vectors >> (4 * (GROUPS - d))) for d in range(1, GROUPS + 1))]

    def has(self, depth: int, prefixes: np.ndarray) -> np.ndarray:
        level = self.levels[depth]
        return level[np.minimum(np.searchsorted(level, prefixes), len(level) - 1)] == prefixes

    def walk(self, vectors: np.ndarray):
        """Depth first, all words at once: blocks ``(word, leaf vector)`` of leaves within the budget."""
        if not len(self.levels[-1]):
            return
        start = np.arange(len(vectors))
        stack = [(0, start, np.zeros(len(vectors), dtype=np.int64), 1, 1)]
        while stack:
            depth, word, prefix, surplus, deficit = stack.pop()
            if depth == GROUPS:
                yield word, prefix
                continue
            count = (vectors[word] >> (4 * (GROUPS - 1 - depth))) & 15
            for change in (-1, 0, 1):
                if (change < 0 and not deficit) or (change > 0 and not surplus):
                    continue
                taken = count + change
                fits = (taken >= 0) & (taken <= 15)
                child = (prefix << 4) | np.where(fits, taken, 0)
                alive = np.nonzero(fits & self.has(depth + 1, child))[0]
                if len(alive):
                    stack.append((depth + 1, word[alive], child[alive], surplus - (change > 0), deficit - (change < 0)))


class Borders:
    """The blocks' ranges of vectors, inclusive at both ends; blocks of one vector may follow each other."""

    def __init__(self, names: np.ndarray, low: np.ndarray, high: np.ndarray):
        order = np.lexsort((high, low))
        self.names, self.low, self.high = names[order], low[order], high[order]

    def reached(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a word and a block that may hold something within the word's budget, each once."""
        n = len(self.names)
        found = []
        stack = [(0, np.arange(len(vectors)), np.zeros(len(vectors), dtype=np.int64), 1, 1)]
        while stack:
            depth, word, prefix, surplus, deficit = stack.pop()
            bits = 4 * (GROUPS - depth)
            first = prefix << bits if depth else prefix
            last = first | ((1 << bits) - 1) if depth else np.full(len(prefix), np.iinfo(np.int64).max)
            a = np.searchsorted(self.high, first, side="left")
            b = np.searchsorted(self.low, last, side="right")
            # One block, or nothing left to spend at the end of a vector: no further choice to make.
            done = (b - a <= 1) | (depth == GROUPS)
            size = np.maximum(b - a, 0)[done]
            found.append(np.repeat(word[done], size) * n + ranges(a[done], size))
            word, prefix = word[~done], prefix[~done]
            if not len(word):
                continue
            count = (vectors[word] >> (4 * (GROUPS - 1 - depth))) & 15
            for change in (-1, 0, 1):
                if (change < 0 and not deficit) or (change > 0 and not surplus):
                    continue
                fits = (count + change >= 0) & (count + change <= MOST[depth])
                if fits.any():
                    stack.append((depth + 1, word[fits], (prefix[fits] << 4) | (count[fits] + change),
                                  surplus - (change > 0), deficit - (change < 0)))
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        return pairs // n, self.names[pairs % n]


# --- the search ------------------------------------------------------------------------------

FOUND = "word string, n long, n_near long, best_n long, best string"


def search_block(index: pa.Table, asked: pa.Table) -> pa.Table:
    """For every asked word its near words in one block: their number, and the commonest (of ties the smallest)."""
    words, times = index.column("word").to_pylist(), index.column("n").to_numpy()
    queries = asked.column("word").to_pylist()
    letters, own = Letters(words), Letters(queries)
    vectors = index.column("vector").to_numpy()
    order = np.argsort(vectors, kind="stable")
    leaves, first = np.unique(vectors[order], return_index=True)
    ends = np.append(first, len(order))
    by_rank = np.array(sorted(range(len(words)), key=lambda i: (-times[i], words[i])), dtype=np.int64)
    rank = np.empty(len(words), dtype=np.int64)
    rank[by_rank] = np.arange(len(words))
    n_near = np.zeros(len(queries), dtype=np.int64)
    best = np.full(len(queries), len(words), dtype=np.int64)
    for word, leaf in Trie(vectors).walk(asked.column("vector").to_numpy()):
        at = np.searchsorted(leaves, leaf)
        for some in np.array_split(np.arange(len(word)), int((ends[at + 1] - ends[at]).sum()) // (8 * PAIRS) + 1):
            size = ends[at[some] + 1] - ends[at[some]]
            x, y = np.repeat(word[some], size), order[ranges(ends[at[some]], size)]
            near = one_edit_apart(own, x, letters, y)
            np.add.at(n_near, x[near], 1)
            np.minimum.at(best, x[near], rank[y[near]])
    has = best < len(words)
    at = by_rank[np.where(has, best, 0)] if len(words) else np.zeros(len(queries), dtype=np.int64)
    picked = pa.array(np.where(has, at, 0), mask=~has)
    return pa.table({"word": asked.column("word"), "n": asked.column("n"), "n_near": pa.array(n_near),
                     "best_n": index.column("n").take(picked), "best": index.column("word").take(picked)})


def near_words(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``words(word, n)``, distinct and of code points below 256, to ``(word, n, n_near, best_n, best)``.

    ``n_near`` counts the words that are one edit apart, ``best`` is the one of largest n (of ties the first in code
    point order), both null where there is none.  A word's search reaches only blocks within its budget.
    """
    def add_vectors(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(Letters(b.column("word").to_pylist()).vectors())],
                                             names=[*b.schema.names, "vector"])

    words = written(words.select("word", "n").mapInArrow(add_vectors, "word string, n long, vector long"), "spelling-words")
    n_blocks = -(-words.count() // block_words) or 1
    blocks = written(words.repartitionByRange(n_blocks, "vector", "word").withColumn("block", F.spark_partition_id()),
                     "spelling-blocks")
    rows = blocks.groupBy("block").agg(F.min("vector").alias("low"), F.max("vector").alias("high")).collect()  # a row a block
    if not rows:
        return blocks.sparkSession.createDataFrame([], FOUND)
    borders = Borders(*(np.array([r[c] for r in rows], dtype=np.int64) for c in ("block", "low", "high")))

    def route(batches):
        for b in batches:
            word, block = borders.reached(b.column("vector").to_numpy(zero_copy_only=False))
            moved = b.take(pa.array(word))
            yield pa.RecordBatch.from_arrays([*(moved.column(c) for c in ("word", "n", "vector")),
                                              pa.array(block.astype(np.int32))], names=["word", "n", "vector", "block"])

    asked = words.mapInArrow(route, "word string, n long, vector long, block int")
    found = blocks.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(search_block, FOUND)
    first = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), "best")))
    return found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), first.alias("top")).select(
        "word", "n", "n_near", (-F.col("top.m")).alias("best_n"), F.col("top.best").alias("best"))


def group_variants(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs(doc_id, text)`` to ``(word, form, root, n, n_near, form_n)``, one row per word of ``count_words``.

    ``form`` is the best near word if it occurs at least twice as often as the word, else null; ``root`` is where the
    forms lead in the end.  Null and empty texts have no words; repeated rows count each; other columns are
    ignored; an empty table gives no rows.
    """
    near = written(near_words(count_words(docs), block_words), "spelling-near")
    follows = F.col("best_n") >= 2 * F.col("n")
    forms = near.select("word", "n", "n_near", F.when(follows, F.col("best")).alias("form"),
                        F.when(follows, F.col("best_n")).alias("form_n"))
    return forms.join(roots(forms), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of words with a form.  Each round doubles the steps taken; counts at least double a
    step, so chains are short and the rounds end."""
    ups = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = ups.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = written(ups.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        ups = new.select("word", "root")
        if new.where("moved").isEmpty():
            return ups
