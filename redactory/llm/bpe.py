"""Byte-level BPE through a minimal acyclic transducer, with exact merging of unseen words.

A text is cut into *units*: each space begins one.  Units repeat a lot, so a slice of
texts is cut and dictionary-encoded by Arrow and only its distinct units are encoded.
Frequent units (counted over all documents) are compiled into a minimal acyclic automaton
with shared suffixes; the numbers on its arcs add up to a word's place in an id table.
The automaton is one flat file that every worker maps into memory, and it is walked by all
distinct units of a slice at once.  Units it does not accept are split by the tokenizer's
pattern and merged exactly, rank by rank, again all at once.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.shared import written
from ..plans.unnest import explode_rows
from .common import offsets_of, ranges, text_slices

# The pre-tokenisation pattern of byte-level BPE files: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPLIT = regex.compile(PATTERN)
# Units of these characters need no Unicode classes.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"[{_LETTERS}!-~ \n]+")
_PLAIN_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^ \n0-9{_LETTERS}]+"
                          r"|[ \n]+(?![^ \n])|[ \n]+")
# A space amid or at the end of a white-space run: there a unit would begin inside a token.
_INNER_SPACE = regex.compile(r"\s (?:\s|\Z)")

NO_PAIR = np.int32(2**31 - 1)
LEXICON_WORDS = 65_536
LONGEST_ROW = 64


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    for i, b in enumerate(b for b in range(256) if b not in set(shown)):
        out[chr(256 + i)] = b
    return out


@dataclass
class Vocabulary:
    """Arrays of a byte-level BPE file; the size of the vocabulary bounds them."""
    byte_ids: np.ndarray      # id of each single byte
    pair_keys: np.ndarray     # left id * size + right id, sorted
    pair_ranks: np.ndarray    # rank of the merge, in the order of pair_keys
    merged_ids: np.ndarray    # by rank
    token_bytes: np.ndarray   # all tokens' bytes
    token_ends: np.ndarray    # by id, one more than ids
    special: dict[str, int]
    size: int


def load_vocabulary(path: str) -> Vocabulary:
    """Read on the driver; executors get the arrays and never open the path."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    symbols, ids = byte_symbols(), spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    size = max([*ids.values(), *special.values()]) + 1
    raw: list[bytes] = [b""] * size
    for token, i in ids.items():
        raw[i] = token.encode() if token in special else bytes(symbols[c] for c in token)
    for token, i in special.items():
        raw[i] = token.encode()
    byte_ids = np.zeros(256, dtype=np.int32)
    for c, b in symbols.items():
        byte_ids[b] = ids[c]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    keys = np.array([ids[a] * size + ids[b] for a, b in pairs], dtype=np.int64)
    order = np.argsort(keys, kind="stable")
    return Vocabulary(byte_ids, keys[order], order.astype(np.int32),
                      np.array([ids[a + b] for a, b in pairs], dtype=np.int32),
                      np.frombuffer(b"".join(raw), dtype=np.uint8), offsets_of(np.array([len(r) for r in raw])),
                      special, size)


class Merger:
    """Exact BPE of many pre-tokens at once."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        v = self.v
        keys = left.astype(np.int64) * v.size + right
        at = np.minimum(np.searchsorted(v.pair_keys, keys), len(v.pair_keys) - 1)
        return np.where((v.pair_keys[at] == keys) & (left >= 0) & (right >= 0), v.pair_ranks[at], NO_PAIR)

    def one(self, word: bytes) -> np.ndarray:
        """A long pre-token: a heap of pairs over a linked list."""
        ids = self.v.byte_ids[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        first = self.ranks(np.array(ids[:-1], dtype=np.int32), np.array(ids[1:], dtype=np.int32)).tolist()
        known = {(ids[i], ids[i + 1]): r for i, r in enumerate(first)}

        def rank(a: int, b: int) -> int:
            if (a, b) not in known:
                known[a, b] = int(self.ranks(np.array([a], dtype=np.int32), np.array([b], dtype=np.int32))[0])
            return known[a, b]

        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NO_PAIR]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i] = int(self.v.merged_ids[r])
            alive[j] = False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (s := rank(ids[x], ids[y])) != NO_PAIR:
                    heapq.heappush(heap, (s, x, ids[x], ids[y]))
        return np.array([t for t, keep in zip(ids, alive) if keep], dtype=np.int32)

    def _rows(self, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of byte ids padded with -1: merged rows in the same shape, and their lengths."""
        n, width = grid.shape
        cols = np.arange(width)
        done = grid.copy()
        rows = np.arange(n)
        rank = self.ranks(grid[:, :-1], grid[:, 1:]) if width > 1 else np.full((n, 1), NO_PAIR, dtype=np.int32)
        while len(rows):
            best = rank.argmin(axis=1)
            low = rank[np.arange(len(rows)), best]
            going = low != NO_PAIR
            if not going.all():
                done[rows[~going]] = grid[~going]
                rows, grid, rank, best, low = rows[going], grid[going], rank[going], best[going], low[going]
                if not len(rows):
                    break
            here = np.arange(len(rows))
            shift = cols[None, :] + (cols[None, :] > best[:, None])
            padded = np.concatenate([grid, np.full((len(rows), 1), -1, dtype=grid.dtype)], axis=1)
            grid = np.take_along_axis(padded, shift, axis=1)
            grid[here, best] = self.v.merged_ids[low]
            padded = np.concatenate([rank, np.full((len(rows), 1), NO_PAIR, dtype=rank.dtype)], axis=1)
            rank = np.take_along_axis(padded, shift[:, :-1], axis=1)
            edge = np.concatenate([grid, np.full((len(rows), 1), -1, dtype=grid.dtype)], axis=1)
            fits = best < width - 1
            rank[here[fits], best[fits]] = self.ranks(grid[here[fits], best[fits]], edge[here[fits], best[fits] + 1])
            left = best > 0
            rank[here[left], best[left] - 1] = self.ranks(grid[here[left], best[left] - 1], grid[here[left], best[left]])
        return done, (done >= 0).sum(axis=1)

    def many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        blob = np.frombuffer(b"".join(words), dtype=np.uint8)
        starts = offsets_of(size)[:-1]
        counts = np.zeros(len(words), dtype=np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        low = 0
        for high in (4, 6, 8, 10, 12, 16, 24, LONGEST_ROW):
            which = np.nonzero((size > low) & (size <= high))[0]
            low = high
            for some in np.array_split(which, len(which) // 100_000 + 1):
                if not len(some):
                    continue
                at = starts[some, None] + np.arange(high)[None, :]
                inside = np.arange(high)[None, :] < size[some, None]
                grid = np.where(inside, self.v.byte_ids[blob[np.minimum(at, len(blob) - 1)]], -1).astype(np.int32)
                rows, n = self._rows(grid)
                counts[some] = n
                parts.append((some, rows[rows >= 0], n))
        for i in np.nonzero(size > LONGEST_ROW)[0]:
            ids = self.one(words[i])
            counts[i] = len(ids)
            parts.append((np.array([i]), ids, np.array([len(ids)])))
        ends = offsets_of(counts)
        out = np.zeros(int(ends[-1]), dtype=np.int32)
        for which, ids, n in parts:
            out[ranges(ends[which], n)] = ids
        return out, counts


def pre_tokens(unit: str) -> list[str]:
    return (_PLAIN_SPLIT if _PLAIN.fullmatch(unit) else _SPLIT).findall(unit)


class Words:
    """Ids of pre-tokens met so far in this worker, so that each is merged about once.

    Emptied when it holds ``most`` words or ``most_chars`` letters: memory stays bounded and results do not depend on it.
    """

    def __init__(self, vocabulary: Vocabulary, most: int = 300_000, most_chars: int = 8_000_000):
        self.merger, self.most, self.most_chars = Merger(vocabulary), most, most_chars
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.n_chars = 0
        self.ids, self.ends, self.n_ids = np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 16, dtype=np.int64), 0

    def look_up(self, words: list[str]) -> np.ndarray:
        """Places of distinct words; ``spans`` gives their ids until the next call."""
        if len(self.place) > self.most or self.n_chars > self.most_chars:
            self.forget()
        new = [w for w in words if w not in self.place]
        if self.place and len(self.place) + len(new) > self.most:  # only words not met before count
            self.forget()
            new = words
        place = self.place
        if new:
            self.n_chars += sum(map(len, new))
            ids, counts = self.merger.many([w.encode() for w in new])
            first = len(place)
            while first + len(new) + 1 > len(self.ends):
                self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            while self.n_ids + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.n_ids:self.n_ids + len(ids)] = ids
            self.ends[first + 1:first + len(new) + 1] = self.n_ids + np.cumsum(counts)
            self.n_ids += len(ids)
            place.update(zip(new, range(first, first + len(new))))
        return np.fromiter(map(place.__getitem__, words), dtype=np.int64, count=len(words))


# A unit that is one pre-token, and one that is letters and then signs.
_LETTERS_ONLY = r"^ ?\pL+$"
_LETTERS_SIGNS = r"^(?P<a> ?\pL+)(?P<b>[^\s\pL\pN\pZ\pC']+)$"


def merged_units(units: pa.Array, words: Words, special: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and id counts of units: pre-tokens by the pattern, merged once per distinct pre-token."""
    n = len(units)
    one = pc.match_substring_regex(units, _LETTERS_ONLY).to_numpy(zero_copy_only=False).astype(bool)
    rest = np.nonzero(~one)[0]
    pairs = pc.extract_regex(units.take(pa.array(rest)), _LETTERS_SIGNS)
    two = pairs.is_valid().to_numpy(zero_copy_only=False).astype(bool)
    marked = [s for s in special if bool(pc.any(pc.match_substring(units, s)).as_py())]
    cut = re.compile("(" + "|".join(map(re.escape, sorted(marked, key=len, reverse=True))) + ")") if marked else None
    others = rest[~two]
    per_unit = np.where(one, 1, 2).astype(np.int64)
    tokens: list[str] = []
    fixed: dict[int, int] = {}
    for i, unit in zip(others.tolist(), units.take(pa.array(others)).to_pylist()):
        before = len(tokens)
        if cut is None:
            tokens += pre_tokens(unit)
        else:
            for k, piece in enumerate(cut.split(unit)):
                if k % 2:
                    fixed[len(tokens)] = special[piece]
                    tokens.append("\0")
                else:
                    tokens += pre_tokens(piece)
        per_unit[i] = len(tokens) - before
    kind = units.type
    found = pairs.filter(pa.array(two))
    every = pa.concat_arrays([units.filter(pa.array(one)), found.field("a").cast(kind), found.field("b").cast(kind),
                              pa.array(tokens, kind)]).dictionary_encode()
    places = words.look_up(every.dictionary.to_pylist())[every.indices.to_numpy(zero_copy_only=False)]
    edges = offsets_of(per_unit)
    order = np.zeros(int(edges[-1]), dtype=np.int64)
    n_one, n_two = int(one.sum()), int(two.sum())
    order[edges[:-1][one]] = np.arange(n_one)
    order[edges[:-1][rest[two]]] = n_one + np.arange(n_two)
    order[edges[:-1][rest[two]] + 1] = n_one + n_two + np.arange(n_two)
    order[ranges(edges[:-1][others], per_unit[others])] = n_one + 2 * n_two + np.arange(len(tokens))
    at = places[order]
    starts, counts = words.ends[at], words.ends[at + 1] - words.ends[at]
    ids = words.ids[ranges(starts, counts)]
    ends = offsets_of(counts)
    if fixed:
        back = np.zeros(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        for k, token in fixed.items():
            ids[ends[back[n_one + 2 * n_two + k]]] = token
    return ids, ends[edges[1:]] - ends[edges[:-1]]


# --- the lexicon -----------------------------------------------------------------------------

def minimal_automaton(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct words to a minimal acyclic automaton.

    Gives sorted arc keys (state * 256 + byte), arc targets, arc numbers and accepting
    flags by state.  State 0 is the start.  The numbers along a word's arcs, plus one for
    each accepting state passed, add up to its place among the words.
    """
    register: dict[tuple, int] = {}
    frozen: list[tuple] = []          # (accepting, ((byte, state), ...)) by state
    path: list[tuple[list, list]] = [([False], [])]  # open states: accepting flag, arcs
    previous = b""

    def freeze(node: tuple[list, list]) -> int:
        key = (node[0][0], tuple(node[1]))
        if key not in register:
            register[key] = len(frozen)
            frozen.append(key)
        return register[key]

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            node = path.pop()
            path[-1][1].append((previous[len(path) - 1], freeze(node)))

    for word in words:
        same = len(os.path.commonprefix([previous, word]))
        close(same)
        path.extend(([False], []) for _ in word[same:])
        path[-1][0][0] = True
        previous = word
    close(0)
    start = freeze(path[0])
    below = np.zeros(len(frozen), dtype=np.int64)
    for s, (accepts, arcs) in enumerate(frozen):  # targets come before their sources
        below[s] = int(accepts) + sum(int(below[t]) for _, t in arcs)
    swap = {0: start, start: 0}
    keys, targets, numbers = [], [], []
    accepting = np.zeros(len(frozen), dtype=np.uint8)
    for s, (accepts, arcs) in enumerate(frozen):
        name = swap.get(s, s)
        accepting[name] = accepts
        passed = 0
        for byte, t in arcs:
            keys.append(name * 256 + byte)
            targets.append(swap.get(t, t))
            numbers.append(passed)
            passed += int(below[t])
    order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
    return (np.array(keys, dtype=np.int64)[order], np.array(targets, dtype=np.int64)[order],
            np.array(numbers, dtype=np.int64)[order], accepting)


@dataclass
class Lexicon:
    """Arrays over one buffer, which is a mapped file on the workers."""
    keys: np.ndarray
    targets: np.ndarray
    numbers: np.ndarray
    accepting: np.ndarray
    id_ends: np.ndarray
    ids: np.ndarray

    def to_bytes(self) -> bytes:
        arrays = (self.keys, self.targets, self.numbers, self.accepting.astype(np.int64), self.id_ends,
                  self.ids.astype(np.int64))
        head = np.array([len(a) for a in arrays], dtype=np.int64)
        return b"".join(a.astype(np.int64).tobytes() for a in (head, *arrays))

    @classmethod
    def of(cls, flat: np.ndarray) -> Lexicon:
        ends = offsets_of(np.asarray(flat[:6])) + 6
        return cls(*(flat[a:b] for a, b in zip(ends[:-1], ends[1:])))

    def places(self, blob: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Place of each word among the lexicon's words, -1 where it is not one of them."""
        n = len(starts)
        state, place = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        out = np.full(n, -1, dtype=np.int64)
        live = np.nonzero(sizes > 0)[0] if len(self.keys) else np.zeros(0, dtype=np.int64)
        step = 0
        while len(live):
            place[live] += self.accepting[state[live]]
            wanted = state[live] * 256 + blob[starts[live] + step]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            found = self.keys[at] == wanted
            live, at = live[found], at[found]
            state[live] = self.targets[at]
            place[live] += self.numbers[at]
            step += 1
            ended = sizes[live] == step
            accepted = live[ended][self.accepting[state[live[ended]]] > 0]
            out[accepted] = place[accepted]
            live = live[~ended]
        return out


def compile_lexicon(words: list[str], vocabulary: Vocabulary) -> Lexicon:
    """Frequent units with their ids, merged exactly here."""
    words = sorted({w for w in words if w}, key=lambda w: w.encode())
    if not words:
        none = np.zeros(0, dtype=np.int64)
        return Lexicon(none, none, none, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), none)
    ids, counts = merged_units(pa.array(words, pa.large_string()), Words(vocabulary), vocabulary.special)
    return Lexicon(*minimal_automaton([w.encode() for w in words]), offsets_of(counts), ids)


def frequent_units(docs: DataFrame, n: int) -> list[str]:
    """About the n most frequent units over all documents, never more than n.

    Counted as Spark counts words.  The cut is a count: all units seen more often than some power of 2^(1/8), the
    lowest that leaves at most n of them, so no task sends more than that part of the n.  A text's first unit has no
    space before it and is counted with one: that can only cost time, as unseen units are merged exactly.
    """
    words = explode_rows(docs, [], F.split("text", " "), "w")
    step = F.floor(8 * F.log2("n")).cast("int")
    counts = written(words.where("w <> ''").groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "w", step.alias("step")), "unit-counts")
    lowest, total = None, 0
    for row in sorted(counts.groupBy("step").count().collect(), reverse=True):  # some hundred rows
        total += row["count"]
        if total > n:
            break
        lowest = row["step"]
    return [] if lowest is None else [" " + r["w"] for r in counts.where(F.col("step") >= lowest).select("w").collect()]


def share_file(spark: SparkSession, blob: bytes, kind: str) -> str:
    """Give a file to every executor through Spark's own file distribution; gives its name there.

    The name is a digest of the content, so the same content is added once.  The driver's copy
    lies in the session's own folder for such files, which Spark removes at the end.
    """
    name = f"{kind}-{hashlib.sha256(blob).hexdigest()[:24]}.bin"
    if not any(f.endswith("/" + name) for f in spark.sparkContext.listFiles):
        folder = os.path.join(SparkFiles.getRootDirectory(), "out")
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, name), "wb") as f:
            f.write(blob)
        spark.sparkContext.addFile(os.path.join(folder, name))
    return name


_WORDS: dict[str, Words] = {}


def words_of(vocabulary: Vocabulary) -> Words:
    """This worker's words; kept between tasks, for one vocabulary at a time."""
    key = hashlib.sha256(vocabulary.pair_keys.tobytes() + vocabulary.merged_ids.tobytes()).hexdigest()
    if key not in _WORDS:
        _WORDS.clear()
        _WORDS[key] = Words(vocabulary)
    return _WORDS[key]


class Encoder:
    """Texts to ids and back; one per worker task."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None):
        self.v, self.lexicon, self.words = vocabulary, lexicon, words_of(vocabulary)

    def _units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of distinct units."""
        n = len(units)
        counts = np.zeros(n, dtype=np.int64)
        found = np.full(n, -1, dtype=np.int64)
        if self.lexicon is not None and n:
            ends = np.frombuffer(units.buffers()[1], dtype=np.int64)[units.offset:units.offset + n + 1]
            blob = np.frombuffer(units.buffers()[2] or b"", dtype=np.uint8)
            found = self.lexicon.places(blob, ends[:-1], np.diff(ends))
        known, unseen = np.nonzero(found >= 0)[0], np.nonzero(found < 0)[0]
        if len(known):
            ends = np.asarray(self.lexicon.id_ends)
            counts[known] = ends[found[known] + 1] - ends[found[known]]
        ids, n_ids = merged_units(units.take(pa.array(unseen)), self.words, self.v.special)
        counts[unseen] = n_ids
        edges = offsets_of(counts)
        out = np.zeros(int(edges[-1]), dtype=np.int32)
        out[ranges(edges[unseen], n_ids)] = ids
        if len(known):
            out[ranges(edges[known], counts[known])] = self.lexicon.ids[
                ranges(ends[found[known]], counts[known])]
        return out, counts

    def encode(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids end (one more than texts)."""
        lists = pc.split_pattern(pc.replace_substring(texts, " ", " \0 "), " \0")  # keeps the space on the right
        # A unit that would begin inside a token, or a special token with a space: the whole text is one unit.
        spaced = [s for s in self.v.special if " " in s]
        whole = np.array([bool(_INNER_SPACE.search(t)) or any(s in t for s in spaced) or "\0" in t
                          for t in texts.to_pylist()], dtype=bool)
        ends = np.frombuffer(lists.buffers()[1], dtype=np.int32 if pa.types.is_list(lists.type) else np.int64)
        ends = ends[lists.offset:lists.offset + len(texts) + 1].astype(np.int64)
        per_text = np.diff(ends)
        units = lists.values
        if whole.any():
            mark = np.repeat(whole, per_text)
            kept = units.slice(ends[0], ends[-1] - ends[0]).filter(pa.array(~mark))
            extra = texts.filter(pa.array(whole))
            order = np.zeros(len(texts), dtype=np.int64)
            per_text = np.where(whole, 1, per_text)
            edges = offsets_of(per_text)
            order = np.zeros(int(edges[-1]), dtype=np.int64)
            split = np.nonzero(~whole)[0]
            order[ranges(edges[split], per_text[split])] = np.arange(len(kept))
            order[edges[np.nonzero(whole)[0]]] = len(kept) + np.arange(len(extra))
            units = pa.concat_arrays([kept, extra]).take(pa.array(order))
        else:
            units = units.slice(ends[0], ends[-1] - ends[0])
        coded = units.dictionary_encode()
        ids, counts = self._units(coded.dictionary)
        refs = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        starts = offsets_of(counts)
        flat = ids[ranges(starts[refs], counts[refs])]
        edges = offsets_of(counts[refs])
        return flat, edges[offsets_of(per_text)]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of id runs; bytes that are not UTF-8 become replacement characters."""
        v = self.v
        size = (v.token_ends[1:] - v.token_ends[:-1])[ids]
        raw = v.token_bytes[ranges(v.token_ends[ids], size)].tobytes()
        at = offsets_of(size)[ends].tolist()
        return [raw[a:b].decode("utf-8", errors="replace") for a, b in zip(at[:-1], at[1:])]


def mapped_lexicon(name: str) -> Lexicon:
    return Lexicon.of(np.memmap(SparkFiles.get(name), dtype=np.int64, mode="r"))


def encode_documents(docs: DataFrame, tokenizer_path: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, ids array<int>, decoded string)``.

    Ids equal the tokenizers library's, special tokens in a text included; null text is empty.
    ``lexicon_words`` bounds the lexicon, which only saves time: words beyond it are merged exactly.
    Other columns are ignored; repeated rows are encoded each; an empty table gives no rows.
    """
    return _encoded(docs, tokenizer_path, lexicon_words, "doc_id long, ids array<int>, decoded string", _full_rows)


def encode_digests(docs: DataFrame, tokenizer_path: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """As ``encode_documents``, with counts and SHA-256 digests in place of ids and text."""
    return _encoded(docs, tokenizer_path, lexicon_words,
                    "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _digest_rows)


def _full_rows(doc_ids, ids, ends, texts):
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
    return [doc_ids, lists, pa.array(texts, pa.string())]


def _digest_rows(doc_ids, ids, ends, texts):
    raw = memoryview(ids.astype("<u4").tobytes())
    at = (ends * 4).tolist()
    return [doc_ids, pa.array(np.diff(ends)),
            pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])]),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])]


def _encoded(docs, tokenizer_path, lexicon_words, schema, rows):
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    vocabulary = load_vocabulary(tokenizer_path)
    lexicon = compile_lexicon(frequent_units(docs, lexicon_words), vocabulary)
    shared = spark.sparkContext.broadcast(vocabulary)
    file = share_file(spark, lexicon.to_bytes(), "lexicon")
    names = [part.split()[0] for part in schema.split(", ")]

    def work(batches):
        encoder = Encoder(shared.value, mapped_lexicon(file))
        for part in text_slices(batches):
            ids, ends = encoder.encode(part.column("text"))
            columns = rows(part.column("doc_id"), ids, ends, encoder.decode(ids, ends))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(work, schema)
