"""The recognisers over Arrow batches, for texts that nearly all hold several spans.

The rules are those of ``detect.recogniser_spans``: match, clear edges, validator, context, threshold.  There each span
costs some hundred interpreted expressions; here matching is Arrow's regular expressions over a batch, and edges,
validators, context words and offsets are numpy.  Only windows that cut a word or hold other than ASCII, and runs of three
and more spans that overlap, are read one by one.  Patterns use ASCII classes alone, so they match the same bytes in any UTF-8 text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from .. import registry as reg
from ..policy import Policy
from ..schema import SPANS_DDL

# Bytes that no UTF-8 text holds mark where a match begins and ends.
OPEN, CLOSE = 0xFE, 0xFF
SLICE_BYTES = 8 * 1024 * 1024

_ALNUM = np.zeros(256, bool)
_ALNUM[[ord(c) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
_WORD = _ALNUM.copy()
_WORD[ord("_")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TOKEN = re.compile(r"[^\W_]+")
_DOUBLED = np.array([sum(divmod(2 * d, 10)) for d in range(10)])


# Validators take the bytes of a slice and where the matches begin and end in them.

def _columns(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each match, one match a row, filled up with zeros; and where it has bytes."""
    width = int((b - a).max(initial=0))
    at = a[:, None] + np.arange(width)
    has = at < b[:, None]
    return np.where(has, data[np.minimum(at, len(data) - 1)], 0), has


def _digits_at(data: np.ndarray, a: np.ndarray, places: tuple[int, ...]) -> list[np.ndarray]:
    return [data[a + i].astype(np.int64) - 48 for i in places]


def _luhn(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    chars, _ = _columns(data, a, b)
    digit = _DIGIT[chars]
    value = np.where(digit, chars, 48).astype(np.int64) - 48
    n = digit.sum(1)
    behind = n[:, None] - digit.cumsum(1)  # digits after each
    total = (np.where(behind % 2 == 1, _DOUBLED[value], value) * digit).sum(1)
    return (n >= 13) & (n <= 19) & (total % 10 == 0)


def _iban(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    chars, has = _columns(data, a, b)
    rest = np.zeros(len(a), np.int64)
    for i in (*range(4, chars.shape[1]), *range(4)) if len(a) else ():
        c = chars[:, i].astype(np.int64)
        rest = np.where(has[:, i], np.where(c < 58, rest * 10 + c - 48, rest * 100 + c - 55) % 97, rest)
    return rest == 1


def _octets(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    chars, _ = _columns(data, a, b)
    value, ok = np.zeros(len(a), np.int64), np.ones(len(a), bool)
    for c in chars.T:
        value = np.where(_DIGIT[c], value * 10 + c - 48, 0)
        ok &= value <= 255
    return ok


def _ssn(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = _digits_at(data, a, (0, 1, 2, 4, 5, 7, 8, 9, 10))
    return (d[0] + d[1] + d[2] > 0) & (d[3] + d[4] > 0) & (d[5] + d[6] + d[7] + d[8] > 0)


def _dea(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = _digits_at(data, a, tuple(range(2, 9)))
    return (d[0] + d[2] + d[4] + 2 * (d[1] + d[3] + d[5])) % 10 == d[6]


def _date(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    ok = np.ones(len(a), bool)
    at = np.flatnonzero((b - a == 10) & (data[np.minimum(a + 4, len(data) - 1)] == ord("-")))  # the others have slashes
    d = _digits_at(data, a[at], (0, 1, 2, 3, 5, 6, 8, 9))
    year, month, day = d[0] * 1000 + d[1] * 100 + d[2] * 10 + d[3], d[4] * 10 + d[5], d[6] * 10 + d[7]
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    most = np.array([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(month, 1, 12) - 1] + (leap & (month == 2))
    ok[at] = (month >= 1) & (month <= 12) & (day >= 1) & (day <= most)
    return ok


VALID = {"luhn": _luhn, "iban": _iban, "octets": _octets, "ssn": _ssn, "dea": _dea, "date": _date}


class _Words:
    """Runs of ASCII letters and digits of a slice, to look for words before a place."""

    def __init__(self, data: np.ndarray, places: np.ndarray):
        self.raw, self.low = data.tobytes(), _LOWER[data]
        inside = np.concatenate([[False], _ALNUM[data], [False]])
        at = np.flatnonzero(inside[1:] != inside[:-1])
        cuts = places[(places > 0) & (places < len(data))]  # a run ends with its text
        cuts = np.unique(cuts[inside[cuts] & inside[cuts + 1]])
        self.begins, self.ends = np.sort(np.concatenate([at[::2], cuts])), np.sort(np.concatenate([at[1::2], cuts]))
        self.sizes = self.ends - self.begins
        self.strange = np.concatenate([[0], np.cumsum(data >= 0x80)]) if (data >= 0x80).any() else None

    def numbers(self, word: bytes) -> np.ndarray:
        """Which runs are the word, case aside."""
        found = np.flatnonzero(self.sizes == len(word))
        for i, c in enumerate(word):
            found = found[self.low[self.begins[found] + i] == c]
        return found

    def before(self, first: np.ndarray, start: np.ndarray, words: tuple[str, ...]) -> np.ndarray:
        """For each place: one of the words is among the last few of the ``CONTEXT_CHARS`` code points before it.

        A run that the window cuts, and windows with other than ASCII, are read one by one.
        """
        n = reg.CONTEXT_WORDS
        past = np.maximum(first, start - reg.CONTEXT_CHARS)
        hits = np.sort(np.concatenate([self.numbers(w.encode()) for w in words]))
        stop, whole = np.searchsorted(self.begins, start), np.searchsorted(self.begins, past)
        low = np.maximum(stop - n, whole)
        near = np.searchsorted(hits, stop) > np.searchsorted(hits, low)
        cut = (past > first) & (whole > 0) & (stop - whole < n)
        if len(self.ends):
            cut &= self.ends[np.maximum(whole - 1, 0)] > past
        if self.strange is not None:
            cut |= self.strange[start] > self.strange[past]
        listed = frozenset(words)
        for i in np.flatnonzero(cut).tolist():
            near[i] = not listed.isdisjoint(self._last(int(past[i]), int(first[i]), int(start[i])))
        return near

    def _last(self, past: int, first: int, start: int) -> list[str]:
        if not self.raw[past:start].isascii():  # a code point has at most four bytes
            past = max(first, start - 4 * reg.CONTEXT_CHARS)
        window = self.raw[past:start].decode("utf-8", "ignore")[-reg.CONTEXT_CHARS:]
        return _TOKEN.findall(window.lower())[-reg.CONTEXT_WORDS:]


def matches(texts: pa.LargeBinaryArray, pattern: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte and byte after the last of every match, in order."""
    rows = np.flatnonzero(pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False))
    marked = pc.replace_substring_regex(texts.take(pa.array(rows)), pattern, bytes([OPEN]) + rb"\0" + bytes([CLOSE]))
    places, data = _buffers(marked)
    marks = np.flatnonzero(data >= OPEN)
    start, end = marks[::2], marks[1::2]
    row = np.searchsorted(places, start, "right") - 1
    # Marks before a match in its text move it by two bytes each.
    moved = places[row] + 2 * (np.arange(len(row)) - np.searchsorted(row, row))
    return rows[row], start - moved, end - moved - 1


def _buffers(texts: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], whole[at[0]:at[-1]]


def _rationale(r: reg.Recogniser, score: float) -> str:
    parts = [r.name, f"pattern={r.pattern_name}"]
    if r.score != score:
        parts.append(f"raw_score={r.score:.2f}")
    if r.validator:
        parts.append(f"validator={r.validator}")
    return "; ".join(parts)


def _best(row: np.ndarray, start: np.ndarray, end: np.ndarray, rank: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Which spans, in order, ``resolve.keep_best`` keeps: greedy by score, length, start, type inside runs that overlap."""
    keep = np.ones(len(row), bool)
    if not len(row):
        return keep
    room = row * (int(end.max()) + 1)
    begins = np.flatnonzero(np.concatenate([[True], (room + start)[1:] >= np.maximum.accumulate(room + end)[:-1]]))
    sizes = np.diff(np.concatenate([begins, [len(row)]]))
    i = begins[sizes == 2]  # of two, one stays; in order, so the second never starts or ranks first but by score or length
    j = i + 1
    second = (score[j] > score[i]) | ((score[j] == score[i]) & (end[j] - start[j] > end[i] - start[i]))
    keep[np.where(second, i, j)] = False
    for at, n in zip(begins[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        run = zip(*(c[at:at + n].tolist() for c in (score, start, end, rank)), range(at, at + n))
        kept = []
        for _, _, s, _, e, i in sorted((-sc, s - e, s, k, e, i) for sc, s, e, k, i in run):
            if any(a < e and s < b for a, b in kept):
                keep[i] = False
            else:
                kept.append((s, e))
    return keep


def _texts(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.StringArray:
    """The bytes from ``a`` to ``b`` as strings."""
    ends = np.concatenate([[0], np.cumsum(b - a)])
    joined = data[np.arange(ends[-1]) + np.repeat(a - ends[:-1], b - a)]
    if ends[-1] < 2**31 and (joined < 0x80).all():
        return pa.StringArray.from_buffers(len(a), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(joined))
    return pa.array([joined[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())],
                    pa.string())


def _slice_spans(texts: pa.LargeBinaryArray, policy: Policy, best: bool) -> pa.ListArray:
    places, array = _buffers(texts)
    if (array >= OPEN).any():  # not UTF-8
        return _slice_spans(pa.array([t.decode("utf-8", "replace").encode() for t in texts.to_pylist()], pa.large_binary()),
                            policy, best)
    # Of texts in ASCII alone bytes are code points.
    words = _Words(array, places)
    points = None if words.strange is None else np.concatenate([[0], np.cumsum((array & 0xC0) != 0x80)])
    padded = np.concatenate([array, np.zeros(1, np.uint8)])
    chosen = sorted(reg.select(policy.entities, policy.threshold), key=lambda r: r.entity)
    whys, found = [], []
    for rank, r in enumerate(chosen):
        row, start, end = matches(texts, r.pattern)
        first = places[row]
        a, b = first + start, first + end
        clear = ~((start > 0) & _WORD[padded[a - 1]] & _ALNUM[padded[a]]) & ~(
            (b < places[row + 1]) & _ALNUM[padded[b - 1]] & _WORD[padded[b]])
        row, first, a, b = row[clear], first[clear], a[clear], b[clear]
        if r.validator:
            ok = VALID[r.validator](array, a, b)
            row, first, a, b = row[ok], first[ok], a[ok], b[ok]
        low, high = round(r.score, 3), round(min(1.0, round(r.score + reg.CONTEXT_BOOST, 3)), 3)
        if r.validator in reg.SCORE_LIFTING_VALIDATORS:
            low = high = 1.0
        score = np.full(len(row), low)
        if r.context and low < high:
            score[words.before(first, a, r.context)] = high
        if low < policy.threshold:
            strong = score >= policy.threshold
            row, first, a, b, score = row[strong], first[strong], a[strong], b[strong], score[strong]
        why = len(whys) + (score != low)
        whys += [_rationale(r, low), _rationale(r, high)] if policy.explain else ["", ""]
        found.append((row, a, b, np.full(len(row), rank), score, why, a - first if points is None else points[a] - points[first],
                      b - first if points is None else points[b] - points[first]))
    if not found:
        found = [tuple(np.zeros(0, t) for t in (int, int, int, int, float, int, int, int))]
    row, a, b, rank, score, why, start, end = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((rank, end, start, row))
    row, a, b, rank, score, why, start, end = (c[order] for c in (row, a, b, rank, score, why, start, end))
    if best:
        keep = _best(row, start, end, rank, score)
        row, a, b, rank, score, why, start, end = (c[keep] for c in (row, a, b, rank, score, why, start, end))
    entity, name = pa.array([r.entity for r in chosen], pa.string()), pa.array(
        [r.name if policy.explain else "" for r in chosen], pa.string())
    spans = pa.StructArray.from_arrays(
        [entity.take(pa.array(rank)), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(score),
         _texts(array, a, b),
         name.take(pa.array(rank)), pa.array(whys, pa.string()).take(pa.array(why))],
        ["entity_type", "start", "end", "score", "text", "recognizer", "rationale"])
    ends = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), spans)


def spans_of_batch(texts: pa.Array, policy: Policy, best: bool = False) -> pa.Array:
    """Spans of each text, or only those to rewrite, ordered by start, end, type; none for null."""
    whole = texts.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    places, _ = _buffers(whole)
    out, at = [], 0
    while at < len(whole):
        past = max(at + 1, int(np.searchsorted(places, places[at] + SLICE_BYTES, "right")) - 1)
        out.append(_slice_spans(whole.slice(at, past - at), policy, best))
        at = past
    return pa.concat_arrays(out) if out else _slice_spans(whole, policy, best)


def scanned(text: Column, policy: Policy, best: bool = False) -> Column:
    """The recognisers' spans of a text column, or only those to rewrite."""
    def scan(texts: pa.Array) -> pa.Array:
        return spans_of_batch(texts, policy, best)

    return F.arrow_udf(scan, SPANS_DDL)(text)
