"""What several operators of this package share: inputs, hashing in numpy, connected components."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.salting import salted_join
from ..plans.shared import written

# Words as most operators here understand them: runs free of ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
NOT_WORD = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Bytes of text that a Python step works on at once.
SLICE_BYTES = 3 << 20
# Odd multipliers of rolling hashes.
ODD_1, ODD_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(name: str, columns: list[str]) -> str:
    """The name, with underscores until it differs from all columns' names."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def text_slices(batches, column: str = "text"):
    """Arrow batches cut into slices of about SLICE_BYTES of text, with null text made empty.

    A single longer text is a slice of its own.  Memory that Arrow holds back is given up after each slice, as a
    worker lives on through many tasks.
    """
    pool = pa.default_memory_pool()
    for batch in batches:
        at = batch.schema.get_field_index(column)
        sizes = pc.binary_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = offsets_of(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + SLICE_BYTES, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            part = batch.slice(start, stop - start)
            texts = part.column(at).cast(pa.large_string()).fill_null("")
            yield pa.RecordBatch.from_arrays(
                [texts if i == at else part.column(i) for i in range(part.num_columns)], names=part.schema.names)
            start = stop
            pool.release_unused()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i]+1, ... (lengths[i] numbers) one after another."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


# Borders of code point ranges [first, after the last), one after another.
# Scripts written without spaces between words (Thai to Tibetan, Myanmar, Khmer, Tai, kana, bopomofo, Han), and emoji.
UNSPACED = np.array([
    0x0E00, 0x1000, 0x1000, 0x10A0, 0x1780, 0x1800, 0x1950, 0x1AB0, 0x3005, 0x3008, 0x3040, 0x3130, 0x31A0, 0x31C0,
    0x31F0, 0x3200, 0x3400, 0xA000, 0xA9E0, 0xAA00, 0xAA60, 0xAAE0, 0xF900, 0xFB00, 0xFF66, 0xFFA0,
    0x1B000, 0x1B170, 0x1F000, 0x1FB00, 0x20000, 0x40000])
# Signs and spaces beyond ASCII, without joiners inside words.
SIGNS = np.array([
    0xA0, 0xAA, 0xAB, 0xB5, 0xB6, 0xBA, 0xBB, 0xC0, 0x60C, 0x60D, 0x61B, 0x61C, 0x61F, 0x620, 0x6D4, 0x6D5,
    0x964, 0x966, 0x2000, 0x200C, 0x200E, 0x2070, 0x2E00, 0x2E80, 0x3000, 0x3005, 0x3008, 0x3021, 0x30FB, 0x30FC,
    0xFE30, 0xFE70, 0xFF01, 0xFF10, 0xFF1A, 0xFF21, 0xFF3B, 0xFF41, 0xFF5B, 0xFF66])


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, sizes in bytes and code points of the characters beyond ASCII."""
    at = np.nonzero(data >= 0xC0)[0]
    size = 2 + (data[at] >= 0xE0).astype(np.int64) + (data[at] >= 0xF0)
    code = data[at].astype(np.int64) & (0x7F >> size)
    for k in range(1, 4):
        more = np.nonzero(size > k)[0]
        code[more] = (code[more] << 6) | (data[np.minimum(at[more] + k, len(data) - 1)] & 63)
    return at, np.minimum(size, len(data) - at), code


def within(code: np.ndarray, borders: np.ndarray) -> np.ndarray:
    return np.searchsorted(borders, code, side="right") % 2 == 1


def cut_words(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, unspaced: np.ndarray,
              longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of words no longer than ``longest`` bytes: every two neighbouring characters where
    ``unspaced`` marks the bytes, and parts of longer words that overlap by about half."""
    bare = unspaced[starts]
    long_ = ~bare & (lengths > longest)
    if not bare.any() and not long_.any():
        return starts, lengths
    ends = starts + lengths
    inner = lambda at: (data[np.minimum(at, len(data) - 1)] & 0xC0) == 0x80

    at = np.nonzero(unspaced & ((data & 0xC0) != 0x80))[0]
    run = np.searchsorted(starts, at, side="right") - 1
    beyond = np.append(at, [len(data), len(data)])
    second, third = np.minimum(beyond[1:-1], ends[run]), np.minimum(beyond[2:], ends[run])
    pair = (second < ends[run]) | (at == starts[run])  # a single character is a word

    half = longest // 2
    count = -(-(lengths[long_] - longest) // half) + 1
    end = np.repeat(ends[long_], count)
    a = np.repeat(starts[long_], count) + ranges(np.zeros(len(count), dtype=np.int64), count) * half
    b = np.minimum(a + longest, end)
    for _ in range(3):  # to the borders of characters
        a = a + inner(a)
        b = b - ((b < end) & inner(b))

    keep = ~bare & ~long_
    first = np.concatenate([starts[keep], at[pair], a])
    size = np.concatenate([lengths[keep], (third - at)[pair], b - a])
    order = np.argsort(first, kind="stable")
    return first[order], size[order]


class WordTable:
    """The words of some texts, side by side: runs free of ASCII white space, or without ``signs`` runs of
    ASCII letters, digits and characters beyond ASCII that are no signs.  With ``longest``, see ``cut_words``.

    ``data`` is all texts' bytes and ``inside`` marks those of words; word i starts at ``starts[i]``, has
    ``lengths[i]`` bytes, the small number ``ids[i]`` and the 64-bit hash ``hashes[i]``, and belongs to text
    ``doc_of[i]``.  Text d has the words ``word_ends[d]`` up to ``word_ends[d + 1]``.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, signs: bool = True, longest: int | None = None):
        pa.default_memory_pool().release_unused()
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + n + 1] if n \
            else np.zeros(1, dtype=np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0]:ends[-1]] if n \
            else np.zeros(0, dtype=np.uint8)
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        self.data, self.doc_ends, self.n_docs = data, ends - ends[0], n
        if signs:
            self.inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        else:
            self.inside = (data >= 128) | ((data >= 48) & (data <= 57)) | (((data | 32) >= 97) & ((data | 32) <= 122))
            at, size, code = characters(data)
            sign = within(code, SIGNS)
            self.inside[ranges(at[sign], size[sign])] = False
        begins = self.inside.copy()
        begins[1:] &= ~self.inside[:-1]
        if longest:
            at, size, code = characters(data)
            bare = within(code, UNSPACED)
            unspaced = np.zeros(len(data), dtype=bool)
            unspaced[ranges(at[bare], size[bare])] = True
            unspaced &= self.inside
            begins[1:] |= self.inside[1:] & (unspaced[1:] != unspaced[:-1])
        first = self.doc_ends[:-1][self.doc_ends[:-1] < len(data)]
        begins[first] = self.inside[first]
        self.starts = np.nonzero(begins)[0]
        before = offsets_of(self.inside)
        self.lengths = np.diff(np.append(before[self.starts], before[-1]))
        if longest:
            self.starts, self.lengths = cut_words(data, self.starts, self.lengths, unspaced, longest)
            letters = data[ranges(self.starts, self.lengths)]
        else:
            letters = data[self.inside]
        words = pa.Array.from_buffers(pa.large_binary(), len(self.starts), [
            None, pa.py_buffer(offsets_of(self.lengths)), pa.py_buffer(letters)]).dictionary_encode()
        self.ids = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.distinct = words.dictionary
        self.n_distinct = len(words.dictionary)
        self.word_ends = np.searchsorted(self.starts, self.doc_ends)
        self.n_words = np.diff(self.word_ends)
        self.doc_of = np.repeat(np.arange(n), self.n_words)

    @cached_property
    def hashes(self) -> np.ndarray:
        return byte_hashes(self.distinct)[self.ids]


def byte_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of large_binary words; short ones all at once, byte by byte."""
    n = len(words)
    ends = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset:words.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)
    size = np.diff(ends)
    acc = mix(size.astype(np.uint64) + ODD_2)
    left = np.nonzero(size <= 32)[0]
    for k in range(32):
        left = left[size[left] > k]
        if not len(left):
            break
        h = (acc[left] ^ data[ends[left] + k]) * ODD_1
        acc[left] = h ^ (h >> np.uint64(29))
    long_ = np.nonzero(size > 32)[0]
    acc[long_] = np.fromiter((xxhash.xxh64_intdigest(words[i].as_py()) for i in long_.tolist()), dtype=np.uint64,
                             count=len(long_))
    return mix(acc)


def by_shard(keys: np.ndarray, n_shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order of entries by shard, and the shards with their borders."""
    shard = (keys % np.uint64(n_shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    shards, first = np.unique(shard[order], return_index=True)
    return order, shards, np.append(first, len(order))


def _follow(rows: DataFrame, column: str, step: DataFrame, spread_by: str) -> DataFrame:
    """``column`` replaced by its root in ``step(id, root)``, if it has one; any value may be hot."""
    moved = step.where("id <> root").select(F.col("id").alias("_at"), F.col("root").alias("_to"))
    return salted_join(rows.withColumn("_at", F.col(column)), moved, "_at", spread_by, "left").withColumn(
        column, F.coalesce("_to", column)).drop("_at", "_to")


def components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge table ``(a long, b long)``: rows ``(id, root)``.

    ``root`` is the smallest id of the component.  Every round each node points to the smallest among itself and
    its neighbours, pointers are followed to their ends by doubling, and the edges are contracted to edges between
    those ends.  Ends have only larger neighbours, so at least half of the nodes go each round.  Roots and edges stay
    distributed; each table is written to the shared folder, and only whether rows are left reaches the driver.
    Edges with a null end, loops and repeated edges change nothing.
    """
    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    left, roots = written(ordered(edges), f"{name}-edges"), None
    for _ in range(max_rounds):
        lowest = left.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root"))
        ends = left.select(F.col("b").alias("id"), F.col("b").alias("root"))
        step = written(lowest.unionByName(ends).groupBy("id").agg(F.min("root").alias("root")), f"{name}-roots")
        for _ in range(max_rounds):
            far = written(_follow(step.withColumn("near", F.col("root")), "root", step, "id"), f"{name}-roots")
            step = far.select("id", "root")
            if far.where("near <> root").isEmpty():
                break
        roots = step if roots is None else written(_follow(roots, "root", step, "id"), f"{name}-roots")
        left = written(ordered(_follow(_follow(left, "a", step, "b"), "b", step, "a")), f"{name}-edges")
        if left.isEmpty():
            return roots
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
