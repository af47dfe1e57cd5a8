"""Texts to byte-level BPE ids by a compiled encoder, with the exact merging of ``bpe`` for texts it is not made for."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import bpe
from .common import offsets_of

# Longest run without ASCII white space, or of it alone, that the compiled encoder gets, in bytes: its split backtracks.
LONGEST_RUN = 4096
# Splits as ``bpe.PATTERN`` does, without going back inside a run.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
# The compiled encoder looks for special tokens first; with none it would look for the empty string, at every place.
# This one is never allowed, so a text that holds it is encoded like any other.
NO_SPECIAL = "<|\0none\0|>"
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[*range(9, 14), 32]] = True

_COMPILED: dict[str, object] = {}


def _compiled(vocabulary: bpe.Vocabulary):
    """The compiled encoder of this worker, or None if the vocabulary's ids do not stand in the order of its merges."""
    v = vocabulary
    key = hashlib.sha256(v.pair_keys.tobytes() + v.merged_ids.tobytes() + v.byte_ids.tobytes()).hexdigest()
    if key not in _COMPILED:
        _COMPILED.clear()
        in_order = bool((np.diff(v.merged_ids) > 0).all()) and (
            not len(v.merged_ids) or int(v.byte_ids.max()) < int(v.merged_ids[0]))
        _COMPILED[key] = None
        if in_order:
            import tiktoken
            raw = v.token_bytes.tobytes()
            known = np.concatenate([v.byte_ids, v.merged_ids]).tolist()
            ranks = {raw[v.token_ends[i]:v.token_ends[i + 1]]: i for i in known}
            if len(ranks) == len(known):
                _COMPILED[key] = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks,
                                                   special_tokens={NO_SPECIAL: max(known, default=0) + 1})
    return _COMPILED[key]


def longest_runs(texts: pa.LargeStringArray) -> np.ndarray:
    """Of each text the bytes of its longest run without ASCII white space, or of ASCII white space alone."""
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + n + 1]
    size = np.diff(ends)
    out = np.zeros(n, dtype=np.int64)
    filled = np.nonzero(size > 0)[0]
    if not len(filled):
        return out
    space = _SPACE[np.frombuffer(texts.buffers()[2], dtype=np.uint8)[ends[0]:ends[-1]]]
    begins = ends[filled] - ends[0]
    border = np.concatenate([[True], space[1:] != space[:-1]])
    border[begins] = True
    at = np.nonzero(border)[0]
    run = np.diff(np.append(at, len(space)))
    out[filled] = np.maximum.reduceat(run, np.searchsorted(at, begins))
    return out


class TextEncoder:
    """Ids of whole texts, special tokens inside them included; they equal those of ``bpe.Encoder``."""

    def __init__(self, vocabulary: bpe.Vocabulary, longest_run: int = LONGEST_RUN):
        self.v, self.longest_run, self.compiled = vocabulary, longest_run, _compiled(vocabulary)
        self.exact = None

    def _others(self, texts: pa.LargeStringArray) -> np.ndarray:
        """Texts with a special token or a very long run."""
        other = pc.greater(pc.binary_length(texts), self.longest_run).to_numpy(zero_copy_only=False)
        other[other] = longest_runs(texts.filter(pa.array(other))) > self.longest_run
        for token in self.v.special:
            other |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False).astype(bool)
        return other

    def encode(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids end (one more than texts)."""
        n = len(texts)
        other = np.ones(n, dtype=bool) if self.compiled is None else self._others(texts)
        parts: list[np.ndarray] = [np.zeros(0, dtype=np.int32)] * n
        if other.any():
            self.exact = self.exact or bpe.Encoder(self.v)
            ids, ends = self.exact.encode(texts.filter(pa.array(other)))
            for i, a, b in zip(np.nonzero(other)[0].tolist(), ends[:-1].tolist(), ends[1:].tolist()):
                parts[i] = ids[a:b]
        plain = np.nonzero(~other)[0]
        for i, text in zip(plain.tolist(), texts.take(pa.array(plain)).to_pylist()):
            parts[i] = self.compiled.encode_to_numpy(text, disallowed_special=())
        ends = offsets_of(np.fromiter(map(len, parts), dtype=np.int64, count=n))
        flat = np.empty(int(ends[-1]), dtype=np.int32)
        if n:
            np.concatenate(parts, out=flat, casting="unsafe")
        return flat, ends
