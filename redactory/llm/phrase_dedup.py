"""Substring dedup: passages of 13 words that recur across documents, located by phrase automata.

Documents are dealt to chunks of bounded text.  Every window of 13 words contains a *key phrase*:
the one of its five-word phrases with the smallest hash, chosen by the window's content alone.

1. Each chunk sends its distinct key phrases (hash, smallest doc_id) to shards; a shard confirms those
   found in several documents.
2. Each chunk compiles its confirmed phrases into an Aho-Corasick automaton and streams its documents
   through it, which locates every occurrence.  Windows whose key phrase was located are candidates;
   their 96-bit hashes go to shards, which compare them exactly across all documents.
3. A chunk's words covered by a window that also starts in a smaller doc_id are removed.

A chunk sends one entry for a phrase or window however many of its documents hold it, so a passage that a third
of all documents share is a few bytes a chunk.  Shards answer with one bit an entry.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ODD_1, ODD_2, WordTable, by_shard, mix, offsets_of, shuffle_partitions, unused

WINDOW, PHRASE = 13, 5
CHUNK_BYTES, SHARD_BYTES = 4 << 20, 32 << 20
# A word of a chunk is a few characters of the automaton's strings, each digit of its number from an alphabet of its
# own: nodes have few children, and a match can only begin where a word does.
DIGITS = 64


class Chunk(WordTable):
    """A chunk's documents, and everything that follows from them alone."""

    def __init__(self, table: pa.Table, window: int, phrase: int):
        super().__init__(table.column("text").combine_chunks())
        self.window, self.phrase = window, phrase
        ids = table.column("doc_id").cast(pa.int64())
        self.has_id = np.array(ids.is_valid().to_numpy(), dtype=bool)
        self.doc_ids = ids.fill_null(0).to_numpy()
        left = self.word_ends[1:][self.doc_of] - np.arange(len(self.starts))
        self.at = np.nonzero((left >= window) & self.has_id[self.doc_of])[0]
        self.phrases = self._rolled(phrase, ODD_1)
        self.keys = self._lowest(self.phrases)

    def _rolled(self, size: int, odd: np.uint64) -> np.ndarray:
        """Hash of every run of ``size`` words, document borders ignored."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        acc = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            acc = acc * odd + self.hashes[k:k + n]
        return mix(acc)

    def _lowest(self, values: np.ndarray) -> np.ndarray:
        """Smallest of the window's phrases, for every window in ``at``."""
        if not len(self.at):
            return np.zeros(0, dtype=np.uint64)
        span, m, width = self.window - self.phrase + 1, values, 1
        while width * 2 <= span:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        return np.minimum(m[self.at], m[self.at + span - width])

    def window_hashes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of the windows that start at these words."""
        a, b = np.zeros(len(which), dtype=np.uint64), np.zeros(len(which), dtype=np.uint64)
        for k in range(self.window):
            h = self.hashes[which + k]
            a, b = a * ODD_1 + h, b * ODD_2 + mix(h)
        return mix(a), (mix(b) >> np.uint64(32)).astype(np.uint32)

    def key_entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct key phrases, the smallest doc_id with each, and whether several documents have it."""
        return _grouped(self.keys, self.doc_ids[self.doc_of[self.at]])

    def located(self, confirmed: np.ndarray) -> np.ndarray:
        """Starts of windows (within ``at``, as a mask) whose key phrase the automaton finds.

        ``confirmed`` is the sorted hashes of this chunk's confirmed phrases.
        """
        if not len(confirmed) or not len(self.at):
            return np.zeros(len(self.at), dtype=bool)
        inside = np.zeros(len(self.phrases), dtype=bool)  # phrases within one document
        inside[:] = self.doc_of[:len(inside)] == self.doc_of[self.phrase - 1:]
        place = np.minimum(np.searchsorted(confirmed, self.phrases), len(confirmed) - 1)
        hit = np.nonzero((confirmed[place] == self.phrases) & inside)[0]
        _, one = np.unique(self.phrases[hit], return_index=True)
        per_word = 1
        while DIGITS**per_word < self.n_distinct:
            per_word += 1
        symbols = np.stack([self.ids // DIGITS**k % DIGITS + DIGITS * k for k in range(per_word)], axis=1)
        text = (symbols.ravel() + 1).astype("<u4").tobytes().decode("utf-32-le")
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for i in hit[one].tolist():
            automaton.add_word(text[i * per_word:(i + self.phrase) * per_word])
        automaton.make_automaton()
        found = np.zeros(len(self.phrases), dtype=bool)
        for first, last in zip(self.word_ends[:-1].tolist(), self.word_ends[1:].tolist()):
            one_text = text[first * per_word:last * per_word]
            ends = np.fromiter((end for end, _ in automaton.iter(one_text)), dtype=np.int64)
            found[first + (ends + 1) // per_word - self.phrase] = True
        lowest = self._lowest(np.where(found, self.phrases, np.uint64(2**64 - 1)))
        return lowest == self.keys

    def kept(self, gone: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Words covered by windows starting at ``gone`` removed: removed words and joined text by document."""
        step = np.zeros(len(self.starts) + 1, dtype=np.int64)
        np.add.at(step, gone, 1)
        np.add.at(step, gone + self.window, -1)
        stays = np.cumsum(step[:-1]) == 0
        before = offsets_of(stays)
        per_doc = before[self.word_ends[1:]] - before[self.word_ends[:-1]]
        mask = np.zeros(len(self.data), dtype=bool)
        mask[np.nonzero(self.inside)[0]] = np.repeat(stays, self.lengths)
        data = self.data.copy()
        # A kept word brings the white space before it, as one space, unless it is its document's first kept word.
        later = stays & (before[:-1] > before[self.word_ends[:-1]][self.doc_of])
        data[self.starts[later] - 1] = 32
        mask[self.starts[later] - 1] = True
        ends = offsets_of(mask)[self.doc_ends]
        text = pa.Array.from_buffers(pa.large_string(), self.n_docs, [
            None, pa.py_buffer(ends), pa.py_buffer(data[mask])])
        return self.n_words - per_doc, text


def _grouped(keys: np.ndarray, docs: np.ndarray, more: np.ndarray | None = None):
    """Sorted distinct keys (with ``more`` as their second part), smallest document, several documents?"""
    order = np.argsort(keys, kind="stable") if more is None else np.lexsort((more, keys))
    keys, docs = keys[order], docs[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    if more is not None:
        more = more[order]
        new[1:] |= more[1:] != more[:-1]
    first = np.nonzero(new)[0]
    if not len(first):
        none = np.zeros(0, dtype=np.int64)
        return (keys, none, none.astype(bool)) if more is None else (keys, more, none, none.astype(bool))
    low, high = np.minimum.reduceat(docs, first), np.maximum.reduceat(docs, first)
    return (keys[first], low, low != high) if more is None else (keys[first], more[first], low, low != high)


REQUEST = "shard long, chunk long, keys binary, more binary, low binary, several binary"
ANSWER = "chunk long, step int, shard long, bits binary"


def _requests(chunk: int, n_shards: int, keys, more, low, several) -> pa.Table:
    order, shards, at = by_shard(keys, n_shards)
    keys, low, several = keys[order], low[order], several[order]
    more = None if more is None else more[order]
    cuts = list(zip(at[:-1], at[1:]))
    return pa.table({
        "shard": pa.array(shards, pa.int64()), "chunk": pa.array(np.full(len(shards), chunk), pa.int64()),
        "keys": pa.array([keys[a:b].tobytes() for a, b in cuts], pa.binary()),
        "more": pa.array([b"" if more is None else more[a:b].tobytes() for a, b in cuts], pa.binary()),
        "low": pa.array([low[a:b].tobytes() for a, b in cuts], pa.binary()),
        "several": pa.array([np.packbits(several[a:b]).tobytes() for a, b in cuts], pa.binary())})


def _answers(step: int, requests: pa.Table, decide) -> pa.Table:
    """One shard: groups all chunks' entries and answers each with one bit."""
    def column(name, dtype):
        return np.frombuffer(b"".join(requests.column(name).to_pylist()), dtype=dtype)

    keys, low = column("keys", np.uint64), column("low", np.int64)
    sizes = np.array([len(k) // 8 for k in requests.column("keys").to_pylist()], dtype=np.int64)
    several = np.concatenate([np.unpackbits(np.frombuffer(s, dtype=np.uint8))[:n].astype(bool)
                              for s, n in zip(requests.column("several").to_pylist(), sizes)])
    more = column("more", np.uint32)
    if len(more):
        order = np.lexsort((more, keys))
        new = (keys[order][1:] != keys[order][:-1]) | (more[order][1:] != more[order][:-1])
    else:
        order = np.argsort(keys, kind="stable")
        new = keys[order][1:] != keys[order][:-1]
    group = np.concatenate([[0], np.cumsum(new)])
    first = np.concatenate([[0], np.nonzero(new)[0] + 1])
    lows = low[order]
    smallest, largest = np.minimum.reduceat(lows, first), np.maximum.reduceat(lows, first)
    many = np.logical_or.reduceat(several[order], first)
    bits = np.zeros(len(keys), dtype=bool)
    bits[order] = decide(lows, smallest[group], largest[group], many[group])
    at = offsets_of(sizes)
    return pa.table({
        "chunk": requests.column("chunk"), "step": pa.array(np.full(len(sizes), step), pa.int32()),
        "shard": requests.column("shard"),
        "bits": pa.array([np.packbits(bits[a:b]).tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())})


def _flags(answers: pa.Table, step: int, keys: np.ndarray, n_shards: int) -> np.ndarray:
    """The shards' bits in the order of ``keys``."""
    order, shards, at = by_shard(keys, n_shards)
    got = {s: b for t, s, b in zip(answers.column("step").to_pylist(), answers.column("shard").to_pylist(),
                                   answers.column("bits").to_pylist()) if t == step}
    out = np.zeros(len(keys), dtype=bool)
    for s, a, b in zip(shards.tolist(), at[:-1], at[1:]):
        out[order[a:b]] = np.unpackbits(np.frombuffer(got[s], dtype=np.uint8))[:b - a].astype(bool)
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, chunk_bytes: int = CHUNK_BYTES,
                   shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept``: the words left, joined by one space.

    Words are runs free of ASCII white space, unchanged.  A word goes if a window of ``window`` words
    that covers it also starts in a document with a smaller doc_id; windows are judged on the input.
    Null and empty texts have no words.  Rows without doc_id keep all words and count nowhere.  Rows that
    share a doc_id are one document as regards "smaller", and each is worked on by itself.  An empty table
    gives no rows.  Columns with the three names are replaced; all others are passed on.
    """
    if not 0 < phrase <= window:
        raise ValueError("the phrase must fit into the window")
    own = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept")]
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_chunks = max(shuffle_partitions(spark), -(-size // chunk_bytes))
    n_shards = max(shuffle_partitions(spark), -(-size // shard_bytes))
    at = unused("chunk", own)
    dealt = docs.select(*own).withColumn(at, F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 64)),
                                                      F.lit(n_chunks)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields if f.name in own)

    def ask_phrases(table: pa.Table) -> pa.Table:
        c = Chunk(table, window, phrase)
        keys, low, several = c.key_entries()
        return _requests(table.column(at)[0].as_py(), n_shards, keys, None, low, several)

    def confirm_phrases(requests: pa.Table) -> pa.Table:
        return _answers(1, requests, lambda low, least, most, many: many | (least != most))

    def candidates(c: Chunk, answers: pa.Table):
        keys, _, _ = c.key_entries()
        starts = c.at[c.located(keys[_flags(answers, 1, keys, n_shards)])]
        a, b = c.window_hashes(starts)
        return starts, a, b, c.doc_ids[c.doc_of[starts]] if len(starts) else np.zeros(0, dtype=np.int64)

    def ask_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _requests(0, n_shards, *[np.zeros(0, dtype=t) for t in (np.uint64, np.uint32, np.int64, bool)])
        _, a, b, ids = candidates(Chunk(table, window, phrase), answers)
        keys, more, low, several = _grouped(a, ids, b)
        return _requests(table.column(at)[0].as_py(), n_shards, keys, more, low, several)

    def earlier_windows(requests: pa.Table) -> pa.Table:
        return _answers(2, requests, lambda low, least, most, many: least < low)

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        c = Chunk(table, window, phrase)
        starts, a, b, ids = candidates(c, answers)
        keys, more, low, _ = _grouped(a, ids, b)
        earlier = _flags(answers, 2, keys, n_shards)
        # Where this occurrence stands among the distinct windows.
        order = np.lexsort((b, a))
        new = np.zeros(len(order), dtype=np.int64)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        place = np.zeros(len(order), dtype=np.int64)
        place[order] = np.cumsum(new)
        gone = starts[earlier[place] | (ids > low[place])] if len(starts) else starts
        removed, text = c.kept(gone)
        return pa.table([*(table.column(n) for n in own), pa.array(c.n_words, pa.int64()),
                         pa.array(removed, pa.int64()), text.cast(pa.string())],
                        names=[*own, "n_words", "n_removed", "kept"])

    chunks = dealt.groupBy(at)
    confirmed = chunks.applyInArrow(ask_phrases, REQUEST).groupBy("shard").applyInArrow(confirm_phrases, ANSWER)
    windows = chunks.cogroup(confirmed.groupBy("chunk")).applyInArrow(ask_windows, REQUEST)
    earlier = windows.groupBy("shard").applyInArrow(earlier_windows, ANSWER)
    answers = confirmed.unionByName(earlier)
    return chunks.cogroup(answers.groupBy("chunk")).applyInArrow(
        finish, f"{fields}, n_words long, n_removed long, kept string")
