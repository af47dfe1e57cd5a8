"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A text is all its overlapping windows of ``WINDOW`` words.  A word's input is its embedding and the mean of
the embeddings of its character trigrams, so words never seen before still have a shape.  Runs of scripts without
spaces are read as pairs of neighbouring characters, and words beyond ``LETTERS`` bytes as overlapping parts, so that
no letter of a text is left out.  Each window is
read in both directions, attention weighs the states, and a logistic unit scores the pooled state; a text
scores as its worst window.  Labels are of whole texts: in training, each text's highest window takes its label.

The network is fitted on the driver to a bounded sample of labelled rows; scoring runs in the tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WordTable, offsets_of, ranges, text_slices

WINDOW, STEP = 32, 16
WORD_DIM, CHAR_DIM, HIDDEN = 8, 8, 8
VOCABULARY = 20_000        # words with an embedding of their own
TRIGRAMS, LETTERS = 2048, 24   # no word is longer, see word_table
UNKNOWN, PAD = 0, 1
SAMPLE = 1500              # labelled texts of each class that the network is fitted to, at most about
SAMPLE_CHARS = 12_000      # of them, only texts up to this length
STEPS, BATCH = 120, 24
ROWS = 8192                # windows, or distinct words, worked on at once


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def word_table(texts: pa.Array) -> WordTable:
    return WordTable(texts, lower=True, signs=False, longest=LETTERS)


def trigrams(words: pa.Array) -> np.ndarray:
    """Bucket numbers of the trigrams around each byte, -1 beyond a word's end."""
    return np.concatenate([np.zeros((0, LETTERS), np.int16), *(
        _trigrams(words.slice(a, ROWS)) for a in range(0, len(words), ROWS))])


def _trigrams(words: pa.Array) -> np.ndarray:
    n = len(words)
    ends = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset:words.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(words.buffers()[2] or b"\0", dtype=np.uint8)
    size = np.diff(ends)
    at = ends[:-1, None] + np.arange(LETTERS + 1)[None, :]
    grid = np.where(np.arange(LETTERS + 1)[None, :] < size[:, None], data[np.minimum(at, len(data) - 1)], 0).astype(np.uint64)
    before = np.concatenate([np.full((n, 1), 1, dtype=np.uint64), grid[:, :-2]], axis=1)
    code = (before * np.uint64(65_599) + grid[:, :-1]) * np.uint64(65_599) + grid[:, 1:]
    code = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    return np.where(np.arange(LETTERS)[None, :] < size[:, None], (code % np.uint64(TRIGRAMS)).astype(np.int16), np.int16(-1))


def windows_of(n_words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every text's windows: which text, and the words' positions, -1 for padding.  A text without words has one."""
    count = np.maximum(1, -(-(n_words - (WINDOW - STEP)) // STEP))
    doc = np.repeat(np.arange(len(n_words)), count)
    start = ranges(np.zeros(len(n_words), dtype=np.int64), count) * STEP
    inside = start[:, None] + np.arange(WINDOW)[None, :]
    return doc, np.where(inside < n_words[doc][:, None], first[doc][:, None] + inside, -1)


class Network:
    """Parameters by name; inputs are rows of word features."""

    def __init__(self, vocabulary: dict[bytes, int], params: dict[str, np.ndarray]):
        self.vocabulary, self.p = vocabulary, params

    @classmethod
    def fresh(cls, vocabulary: dict[bytes, int], odds: np.ndarray, seed: int) -> Network:
        """Random weights; a word's first number starts at its log odds among toxic and other texts."""
        rng = np.random.default_rng(seed)
        dim = WORD_DIM + CHAR_DIM
        p = {"word": rng.normal(0, 0.1, (len(odds), WORD_DIM)), "char": rng.normal(0, 0.1, (TRIGRAMS, CHAR_DIM)),
             "attend": rng.normal(0, 0.3, 2 * HIDDEN), "out": rng.normal(0, 0.3, 2 * HIDDEN), "bias": np.zeros(1)}
        p["word"][:, 0] = odds
        for way in "fb":
            p[f"W{way}"] = rng.normal(0, dim**-0.5, (dim, 3 * HIDDEN))
            p[f"U{way}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN))
            p[f"c{way}"] = np.zeros(3 * HIDDEN)
        return cls(vocabulary, {k: v.astype(np.float32) for k, v in p.items()})

    def word_rows(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Embedding numbers and trigram buckets of distinct words; the last row is padding."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, UNKNOWN) for w in words.to_pylist()), dtype=np.int64, count=len(words))
        return np.append(ids, PAD), np.concatenate([trigrams(words), np.full((1, LETTERS), -1, np.int16)])

    def features(self, ids: np.ndarray, grams: np.ndarray) -> np.ndarray:
        has = (grams >= 0)[..., None]
        chars = (self.p["char"][np.maximum(grams, 0)] * has).sum(axis=-2) / np.maximum(1, has.sum(axis=-2))
        return np.concatenate([self.p["word"][ids], chars], axis=-1).astype(np.float32)

    def read(self, inputs: np.ndarray, places: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """States along the windows; ``inputs`` are gate inputs by word row, ``places`` windows of word rows."""
        U, h = self.p[f"U{way}"], np.zeros((len(places), HIDDEN), dtype=np.float32)
        out = np.zeros((places.shape[1], len(places), HIDDEN), dtype=np.float32)
        steps = range(places.shape[1]) if way == "f" else range(places.shape[1] - 1, -1, -1)
        for t in steps:
            x, g = inputs[places[:, t]], h @ U
            zr = sigmoid(x[:, :2 * HIDDEN] + g[:, :2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(x[:, 2 * HIDDEN:] + r * g[:, 2 * HIDDEN:])
            if keep is not None:
                keep.append((t, h, z, r, new, g[:, 2 * HIDDEN:]))
            h = new + z * (h - new)
            out[t] = h
        return out

    def logits(self, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Logit of every window."""
        gates = [rows @ self.p[f"W{way}"] + self.p[f"c{way}"] for way in "fb"]
        out = np.zeros(len(places), dtype=np.float32)
        for a in range(0, len(places), ROWS):
            some = places[a:a + ROWS]
            h = np.concatenate([self.read(g, some, way) for g, way in zip(gates, "fb")], axis=2)
            e = h @ self.p["attend"]
            e = np.exp(e - e.max(axis=0))
            out[a:a + ROWS] = (e * (h @ self.p["out"])).sum(axis=0) / e.sum(axis=0) + self.p["bias"][0]
        return out

    def gradients(self, ids: np.ndarray, grams: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over windows: ``ids`` (n, WINDOW), ``grams`` (n, WINDOW, LETTERS)."""
        p, n = self.p, len(ids)
        x = self.features(ids, grams)
        flat = x.reshape(n * WINDOW, -1)
        places = np.arange(n * WINDOW).reshape(n, WINDOW)
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        logs, hs = {}, []
        for way in "fb":
            logs[way] = []
            hs.append(self.read(flat @ p[f"W{way}"] + p[f"c{way}"], places, way, logs[way]))
        h = np.concatenate(hs, axis=2)
        e = h @ p["attend"]
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        u = h @ p["out"]
        logit = (a * u).sum(axis=0) + p["bias"][0]
        d = (sigmoid(logit) - y) / n
        grads["bias"][0] = d.sum()
        du, de = a * d, a * d * (u - (a * u).sum(axis=0))
        grads["out"] = np.einsum("tn,tnh->h", du, h)
        grads["attend"] = np.einsum("tn,tnh->h", de, h)
        dh = du[..., None] * p["out"] + de[..., None] * p["attend"]
        dx = np.zeros_like(x)
        for k, way in enumerate("fb"):
            U, carry = p[f"U{way}"], np.zeros((n, HIDDEN), dtype=np.float32)
            for t, before, z, r, new, g in reversed(logs[way]):
                total = dh[t, :, k * HIDDEN:(k + 1) * HIDDEN] + carry
                dnew = total * (1 - z) * (1 - new * new)
                dz = total * (before - new) * z * (1 - z)
                dr = dnew * g * r * (1 - r)
                dgate = np.concatenate([dz, dr, dnew], axis=1)
                dback = np.concatenate([dz, dr, dnew * r], axis=1)
                grads[f"U{way}"] += before.T @ dback
                grads[f"c{way}"] += dgate.sum(axis=0)
                grads[f"W{way}"] += x[:, t].T @ dgate
                dx[:, t] += dgate @ p[f"W{way}"].T
                carry = total * z + dback @ U.T
        np.add.at(grads["word"], ids.ravel(), dx[..., :WORD_DIM].reshape(-1, WORD_DIM))
        has = grams >= 0
        share = dx[..., None, WORD_DIM:] / np.maximum(1, has.sum(axis=-1))[..., None, None] * has[..., None]
        np.add.at(grads["char"], np.maximum(grams, 0).ravel(), share.reshape(-1, CHAR_DIM))
        return grads

    def scores(self, texts: pa.Array) -> np.ndarray:
        words = word_table(texts)
        ids, grams = self.word_rows(words.distinct)
        doc, at = windows_of(words.n_words, words.word_ends[:-1])
        places = np.where(at >= 0, words.ids[np.maximum(at, 0)] if len(words.ids) else 0, len(ids) - 1)
        rows = np.concatenate([self.features(ids[a:a + ROWS], grams[a:a + ROWS]) for a in range(0, len(ids), ROWS)])
        logit = self.logits(rows, places)
        first = np.searchsorted(doc, np.arange(len(words.n_words)))
        return sigmoid(np.maximum.reduceat(logit, first).astype(np.float64)) if len(first) else np.zeros(0)


def train(texts: list[str], y: np.ndarray, seed: int = 5, steps: int = STEPS) -> Network:
    """Fit to labelled texts; without both classes the score is the share of toxic texts, smoothed."""
    words = word_table(pa.array(texts, pa.large_string()))
    y = np.asarray(y, dtype=np.float32)
    vocabulary, odds = _vocabulary(words, y)
    net = Network.fresh(vocabulary, odds, seed)
    if not len(texts) or y.min() == y.max():
        for k in ("attend", "out"):
            net.p[k][:] = 0
        net.p["bias"][0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        return net
    ids, grams = net.word_rows(words.distinct)
    doc, at = windows_of(words.n_words, words.word_ends[:-1])
    places = np.where(at >= 0, words.ids[np.maximum(at, 0)], len(ids) - 1)
    first = np.append(np.searchsorted(doc, np.arange(len(texts))), len(doc))
    rng = np.random.default_rng(seed)
    toxic, clean = np.nonzero(y == 1)[0], np.nonzero(y == 0)[0]
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        some = np.concatenate([rng.choice(toxic, BATCH), rng.choice(clean, BATCH)])
        n = first[some + 1] - first[some]
        mine = ranges(first[some], n)
        used, back = np.unique(places[mine], return_inverse=True)
        logit = net.logits(net.features(ids[used], grams[used]), back.reshape(-1, WINDOW))
        ends = offsets_of(n)
        worst = np.array([a + logit[a:b].argmax() for a, b in zip(ends[:-1], ends[1:])])
        chosen = places[mine[worst]]
        grads = net.gradients(ids[chosen], grams[chosen], y[some])
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            net.p[k] -= (rate * mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def _vocabulary(words: WordTable, y: np.ndarray) -> tuple[dict[bytes, int], np.ndarray]:
    """Words in at least three texts, the most frequent first, and half their log odds."""
    pairs = np.unique(words.doc_of * np.int64(max(1, words.n_distinct)) + words.ids)
    doc, word = pairs // max(1, words.n_distinct), pairs % max(1, words.n_distinct)
    in_toxic = np.bincount(word, weights=y[doc] if len(doc) else None, minlength=words.n_distinct)
    total = np.bincount(word, minlength=words.n_distinct)
    order = np.argsort(-total, kind="stable")
    order = order[total[order] >= 3][:VOCABULARY]
    names = words.distinct.take(pa.array(order)).to_pylist()
    a, b = in_toxic[order] + 0.5, total[order] - in_toxic[order] + 0.5
    odds = np.log(a / (y.sum() + 1)) - np.log(b / (len(y) - y.sum() + 1))
    return {w: i + 2 for i, w in enumerate(names)}, np.concatenate([[0.0, 0.0], np.clip(odds / 2, -1, 2)])


def training_sample(docs: DataFrame, labels: DataFrame, usable, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Labelled texts for the driver: about ``sample`` of each class at most, chosen by a hash of the id.

    ``labels`` is ``(doc_id, toxic)``; a document is toxic if any of its labels says so, and null labels are none.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(usable).groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic"))
    count = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    parts = 1 << 20
    chance = F.when(F.col("toxic") == 1, F.lit(int(parts * min(1.0, sample / max(1, count.get(1, 0)))))).otherwise(
        F.lit(int(parts * min(1.0, sample / max(1, count.get(0, 0))))))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < chance)
    found = docs.where(F.char_length("text") <= SAMPLE_CHARS).select("doc_id", "text").join(
        F.broadcast(picked), "doc_id").orderBy("doc_id", "text").limit(2 * 2 * sample).collect()
    return [r["text"] for r in found], np.array([r["toxic"] for r in found], dtype=np.float32)


def score_texts(docs: DataFrame, network: Network) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) of each whole text; a null text counts as empty and comes back so.

    All columns are passed on.  A column named ``score`` is replaced.  An empty table gives no rows.
    """
    own = [c for c in docs.columns if c != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(network)  # bounded by VOCABULARY and TRIGRAMS

    def work(batches):
        for part in text_slices(batches):
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) if c != "text" else part.column(c).cast(pa.string()) for c in own),
                 pa.array(shared.value.scores(part.column("text")))], names=[*own, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in own)
    return docs.select(*own).mapInArrow(work, f"{fields}, score double")


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``score`` (see ``score_texts``), by a network fitted to the labelled rows that are not held out."""
    texts, y = training_sample(docs, labels.select("doc_id", "toxic"), ~held_out())
    return score_texts(docs, train(texts, y))
