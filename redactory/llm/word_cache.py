"""Ids of words that a library has encoded before, kept by a worker between slices and tasks."""

from __future__ import annotations

from itertools import chain, repeat

import numpy as np

from .common import offsets_of


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers one after another, and how many each list has."""
    counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    return np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(counts.sum())), counts


class WordCache:
    """Each distinct word is encoded about once; ``encode`` gives ids as ``flat`` does.  Emptied at ``most`` words or ``most_ids`` ids: memory stays bounded,
    and results do not depend on it.  Words of more than ``longest`` code points are not kept."""

    def __init__(self, encode, most: int = 400_000, most_ids: int = 4_000_000, longest: int = 128):
        self.encode, self.most, self.most_ids, self.longest = encode, most, most_ids, longest
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.int32)
        self.ends = np.zeros(1 << 14, dtype=np.int64)
        self.n, self.n_ids = 0, 0

    @staticmethod
    def _room(values: np.ndarray, n: int) -> np.ndarray:
        return values if n <= len(values) else np.concatenate([values, np.zeros(max(n - len(values), len(values)), values.dtype)])

    def look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``ids`` the ids of each word start, and how many there are; good until the next call."""
        if self.n_ids > self.most_ids:
            self.forget()
        at = np.fromiter(map(self.place.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        new = np.nonzero(at < 0)[0]
        if len(new):
            if self.n and self.n + len(new) > self.most:
                self.forget()
                return self.look_up(words)
            some = [words[i] for i in new.tolist()]
            ids, counts = self.encode(some)
            at[new] = np.arange(self.n, self.n + len(new))
            self.place.update((w, p) for w, p in zip(some, at[new].tolist()) if len(w) <= self.longest)
            self.ids = self._room(self.ids, self.n_ids + len(ids))
            self.ends = self._room(self.ends, self.n + len(new) + 1)
            self.ids[self.n_ids:self.n_ids + len(ids)] = ids
            self.ends[self.n + 1:self.n + len(new) + 1] = self.n_ids + np.cumsum(counts)
            self.n, self.n_ids = self.n + len(new), self.n_ids + len(ids)
        return self.ends[at], self.ends[at + 1] - self.ends[at]
