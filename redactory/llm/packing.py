"""Packing token sequences: repeat counts of window-filling combinations by non-negative least squares.

Every document's ids (with an end id) are cut into full windows and one remainder.  Piece
lengths up to ``EXACT`` are levels of their own, longer ones are rounded up to ``GRAIN`` ids, so the histogram of
all pieces is a few hundred numbers whatever the corpus.  Combinations of at most ``DEPTH`` levels that fill a window
are enumerated, their repeat counts solved by non-negative least squares against the
histogram and rounded down; what remains is packed greedily, pattern by pattern.  Only the
histogram reaches the driver.  Pieces find their place by their rank within their level.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.shared import written
from . import bpe
from .common import offsets_of, ranges, text_slices
from .text_encoder import TextEncoder

WINDOW = 2048
GRAIN = 8
EXACT = 64  # pieces up to here lose no id to the grain, so very short texts fill their windows
DEPTH = 3
END_ID = 1
BUCKETS, FULL_BUCKETS = 256, 4096  # parts that a level, and that of full windows, is ranked in; bound the broadcast table of their sizes


def combinations(levels: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Non-increasing combinations of at most ``depth`` levels (1..levels) that add up to ``levels``."""
    out: list[tuple[int, ...]] = []

    def grow(parts: tuple[int, ...], left: int) -> None:
        if left == 0:
            out.append(parts)
        elif len(parts) < depth:
            for level in range(min(left, parts[-1] if parts else left), 0, -1):
                if level * (depth - len(parts)) < left:
                    break
                grow((*parts, level), left - level)

    grow((), levels)
    return out


def nonnegative_least_squares(parts: list[tuple[int, ...]], counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |Ax - counts|, where column j of A counts the levels of parts[j].

    Accelerated projected gradient; A is kept as index arrays.
    """
    rows = np.array([level for p in parts for level in p])
    cols = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    size = len(counts)
    apply = lambda x: np.bincount(rows, weights=x[cols], minlength=size)
    back = lambda r: np.bincount(cols, weights=r[rows], minlength=len(parts))
    v = np.ones(len(parts))
    for _ in range(30):  # largest eigenvalue of A'A
        v = back(apply(v))
        v /= np.linalg.norm(v)
    step = 1 / max(np.linalg.norm(back(apply(v))), 1e-9)
    x = y = np.zeros(len(parts))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(apply(y) - counts))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def level_sizes(window: int, grain: int, exact: int = EXACT) -> np.ndarray:
    """Ids that a piece of each level takes, ascending; level 0 is none."""
    every = np.arange(window + 1)
    return every[(every < min(exact, window)) | (every % grain == 0)]


def level_of(length: Column, sizes: np.ndarray, grain: int) -> Column:
    """The smallest level that holds a piece."""
    exact = int(np.argmax(np.diff(sizes, append=sizes[-1] + grain) > 1))  # the last level before the steps of the grain
    return F.when(length <= exact, length).otherwise(exact - exact // grain + F.ceil(length / F.lit(grain))).cast("int")


def plan(counts: np.ndarray, levels: int, sizes: np.ndarray | None = None) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used; together they use every piece of ``counts`` (by level) exactly once.

    A pattern's pieces take at most the size of the last level, and ``levels`` parts of that size are combined;
    by default a level's size is its number.
    """
    sizes = np.arange(levels + 1) if sizes is None else sizes
    window, last = int(sizes[-1]), len(sizes) - 1
    left = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...], most: int | None = None) -> None:
        need = np.bincount(pattern, minlength=last + 1)
        n = int((left[need > 0] // need[need > 0]).min())
        n = n if most is None else min(n, most)
        if n > 0:
            left[:] -= need * n
            out.append((pattern, n))

    of_part = np.searchsorted(sizes, np.arange(levels + 1) * (window // levels))
    parts = [tuple(of_part[list(p)].tolist()) for p in combinations(levels)]
    x = np.floor(nonnegative_least_squares(parts, counts.astype(float)) + 1e-6).astype(np.int64)
    for j in np.argsort(-x, kind="stable"):
        if x[j] <= 0:
            break
        use(parts[j], int(x[j]))
    while left.any():  # every round uses up at least one level
        pattern: list[int] = []
        room, taken = window, np.zeros(last + 1, dtype=np.int64)
        while True:
            fits = np.nonzero((left - taken)[:np.searchsorted(sizes, room, side="right")] > 0)[0]
            if not len(fits):
                break
            level = int(fits[-1])
            k = min(room // int(sizes[level]), int(left[level] - taken[level]))
            pattern += [level] * k
            taken[level] += k
            room -= int(sizes[level]) * k
        use(tuple(pattern))
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (level, first rank, first sequence, slot) sorted by level and rank."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, n in patterns:
        for slot, level in enumerate(pattern):
            out.append((level, used.get(level, 0), sequence, slot))
            used[level] = used.get(level, 0) + n
        sequence += n
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 4)


def pieces(docs: DataFrame, tokenizer_path: str, content: str = "ids", window: int = WINDOW,
           end_id: int = END_ID) -> DataFrame:
    """Full windows and the remainder of every document, in rows
    ``(doc_id, start, length, <content>, doc_tokens)``; content is ``ids`` or ``ids_crc32``."""
    if content not in ("ids", "ids_crc32"):
        raise ValueError(f"unknown content {content!r}")
    shared = docs.sparkSession.sparkContext.broadcast(bpe.load_vocabulary(tokenizer_path))

    def work(batches):
        encoder = TextEncoder(shared.value)
        for part in text_slices(batches):
            bare, ends = encoder.encode(part.column("text"))
            n = np.diff(ends) + 1
            at = offsets_of(n)
            ids = np.full(int(at[-1]), end_id, dtype=np.int32)
            ids[ranges(at[:-1], n - 1)] = bare
            per_doc = -(-n // window)
            doc = np.repeat(np.arange(len(n)), per_doc)
            start = ranges(np.zeros(len(n), dtype=np.int64), per_doc) * window
            length = np.minimum(window, n[doc] - start)
            first = at[:-1][doc] + start
            if content == "ids":
                column = pa.ListArray.from_arrays(pa.array(offsets_of(length).astype(np.int32)), pa.array(ids))
            else:
                raw = memoryview(ids.astype("<u4").tobytes())
                column = pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(first, first + length)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), column,
                 pa.array(n[doc])], names=["doc_id", "start", "length", content, "doc_tokens"])

    kind = "array<int>" if content == "ids" else "long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        work, f"doc_id long, start long, length long, {content} {kind}, doc_tokens long")


def pack_documents(docs: DataFrame, tokenizer_path: str, content: str = "ids", window: int = WINDOW,
                   end_id: int = END_ID, grain: int = GRAIN) -> DataFrame:
    """``docs(doc_id, text)`` to pieces with ``sequence_id`` (from 0) and ``offset`` in it.

    Null and empty texts are the end id alone.  A null doc_id and repeated rows are packed like any
    other row.  An empty table gives no rows.  Other columns are ignored.  Ids are shuffled once, to the
    places that were worked out without them.
    """
    if window % grain:
        raise ValueError("the grain must divide the window")
    sizes = level_sizes(window, grain)
    cut = pieces(docs, tokenizer_path, content, window, end_id)
    fields = cut.columns
    if content == "ids":
        # Fixed once written, so it stands for the row; the hash keeps ties in one order however rows are dealt.
        cut = written(cut.withColumn("_piece", F.monotonically_increasing_id()), "pieces")
        slim, tie = cut.withColumn("_tie", F.xxhash64("ids")).drop("ids"), "_tie"
    else:
        cut = written(cut, "pieces")
        slim, tie = cut, content
    level = level_of(F.col("length"), sizes, grain)
    # Rows of one id, or of none, are told apart by their content too.
    parts = F.when(F.col("length") == window, FULL_BUCKETS).otherwise(BUCKETS)
    placed = slim.withColumn("_level", level).withColumn(
        "_bucket", F.pmod(F.xxhash64("doc_id", "start", tie), parts).cast("int"))
    in_bucket = placed.groupBy("_level", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    counts = np.zeros(len(sizes), dtype=np.int64)
    for row in in_bucket.groupBy("_level").agg(F.sum("_n").alias("n")).collect():  # one row a level
        counts[row["_level"]] = row["n"]
    table = slots(plan(counts, window // grain, sizes))

    earlier = W.partitionBy("_level").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    before = in_bucket.select("_level", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = W.partitionBy("_level", "_bucket").orderBy("doc_id", "start", "length", "doc_tokens", tie)
    ranked = placed.withColumn("_in", F.row_number().over(inside) - 1).join(
        F.broadcast(before), ["_level", "_bucket"])  # at most len(sizes) * BUCKETS + FULL_BUCKETS rows
    ranked = ranked.select(*slim.columns, "_level", (F.col("_in") + F.col("_before")).alias("_rank"))

    names = slim.columns

    def seat(batches):
        span = np.int64(1) << 48
        keys = table[:, 0] * span + table[:, 1]
        for b in batches:
            rank = b.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(keys, b.column("_level").to_numpy(zero_copy_only=False) * span + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), pa.array(table[at, 2] + rank - table[at, 1]),
                 pa.array(table[at, 3])], names=[*names, "sequence_id", "_slot"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields)
    seated = ranked.mapInArrow(seat, f"{kinds}, sequence_id long, _slot long")
    so_far = W.partitionBy("sequence_id").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    seated = seated.select(*names, "sequence_id",
                           F.coalesce(F.sum("length").over(so_far), F.lit(0)).cast("long").alias("offset"))
    if content == "ids":
        seated = seated.join(cut.select("_piece", "ids"), "_piece")
    return seated.select(*fields, "sequence_id", "offset")
