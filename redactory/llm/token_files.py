"""Files of raw token ids with keyed access through a minimal perfect hash.

Documents are dealt by ranges of doc_id, so that every task writes a stretch of the whole order.  A shard is two
files: ``<name>.ids`` holds the raw little-endian ids of its documents and nothing else; ``<name>.mph`` maps a
doc_id to the place of its ids.  The index is a minimal perfect hash in levels: a key takes a bit of the first level,
colliding keys go on to the next one, and the rank of a key's bit is its slot.  A slot stores a fingerprint
of the key, the first document with that key and how many there are, so a lookup costs the same in any file.

A manifest, written by Spark after the shards, names the files of successful tasks only: what a lost executor left
behind is never read.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..plans.shared import work_dir
from .common import WordTable, mix, offsets_of, ranges, text_slices
from .word_cache import WordCache, flat

END_ID = 1
SHARD_BYTES = 256 << 20
READ_BYTES = 1 << 20
MAGIC = 0x31_4850_4D53_4449  # the format and its version
# Bits of a level for each key that is still without one.
ROOM = 2
MANIFEST = "part long, nth long, name string, first_key long, last_key long, n_docs long, n_ids long"


# --- the hash --------------------------------------------------------------------------------

def _seeded(keys: np.ndarray, seed: int) -> np.ndarray:
    return mix(keys.astype(np.int64).view(np.uint64) ^ mix(np.array([seed + 1], dtype=np.uint64)))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_seeded(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


@dataclass
class PerfectHash:
    """Distinct keys to 0..n-1.  ``sizes`` are the levels' bits, ``words`` all levels' bits, 64 a word."""
    sizes: np.ndarray
    words: np.ndarray
    ranks: np.ndarray  # bits before each word

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        left = keys
        while len(left):
            n = -(-len(left) * ROOM // 64) * 64
            at = (_seeded(left, len(sizes)) % np.uint64(n)).astype(np.int64)
            count = np.bincount(at, minlength=n)
            levels.append(np.packbits(count == 1, bitorder="little").view(np.uint64))
            sizes.append(n)
            left = left[count[at] > 1]
            if len(sizes) > 500:
                raise ValueError("keys have to be distinct")
        words = np.concatenate(levels) if levels else np.zeros(0, dtype=np.uint64)
        return cls(np.array(sizes, dtype=np.int64), words, offsets_of(np.bitwise_count(words).astype(np.int64)))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key; a key that is none of the keys has any slot or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left, before = np.arange(len(keys)), 0
        for level, n in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = (_seeded(keys[left], level) % np.uint64(n)).astype(np.int64) + before
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            found = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            slot = self.ranks[word] + np.bitwise_count(below)
            out[left[found]] = slot[found]
            left, before = left[~found], before + n
        return out


# --- the files -------------------------------------------------------------------------------

@dataclass
class Index:
    """What ``<name>.mph`` holds.  Documents without key come first and are in no slot."""
    width: int                # bytes of an id
    keys: np.ndarray          # of all documents with a key, in their order
    ends: np.ndarray          # ids before each document, and their number
    hash: PerfectHash
    fingerprints: np.ndarray  # by slot
    first: np.ndarray         # by slot: the first document with the key
    copies: np.ndarray        # by slot: how many there are

    @property
    def n_docs(self) -> int:
        return len(self.ends) - 1

    @property
    def n_without_key(self) -> int:
        return self.n_docs - len(self.keys)

    @classmethod
    def of(cls, keys: np.ndarray, ends: np.ndarray, width: int) -> Index:
        own, first, copies = np.unique(keys, return_index=True, return_counts=True)
        perfect = PerfectHash.of(own)
        slots = perfect.slots(own)
        marks, start, many = (np.zeros(len(own), dtype=t) for t in (np.uint32, np.int64, np.int64))
        marks[slots], start[slots], many[slots] = fingerprints(own), first + len(ends) - 1 - len(keys), copies
        return cls(width, keys, ends, perfect, marks, start, many)

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of every key; -1 and 0 for keys that the shard does not hold."""
        if not len(self.first):
            return np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        slots = self.hash.slots(keys)
        found = (slots >= 0) & (self.fingerprints[slots] == fingerprints(keys))
        return np.where(found, self.first[slots], -1), np.where(found, self.copies[slots], 0)

    def to_bytes(self) -> bytes:
        arrays = (self.keys, self.ends, self.hash.sizes, self.hash.words.view(np.int64), self.hash.ranks,
                  self.fingerprints.astype(np.int64), self.first, self.copies)
        head = [MAGIC, self.width, *(len(a) for a in arrays)]
        return b"".join(np.asarray(a, dtype="<i8").tobytes() for a in (head, *arrays))

    @classmethod
    def from_bytes(cls, raw: bytes) -> Index:
        flat = np.frombuffer(raw, dtype="<i8")
        if len(flat) < 10 or flat[0] != MAGIC:
            raise ValueError("no index of token files")
        at = offsets_of(flat[2:10]) + 10
        keys, ends, sizes, words, ranks, marks, first, copies = (flat[a:b] for a, b in zip(at[:-1], at[1:]))
        return cls(int(flat[1]), keys, ends, PerfectHash(sizes, words.view(np.uint64), ranks), marks.astype(np.uint32),
                   first, copies)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI that Arrow knows (file, hdfs, s3, gs) and the path in it."""
    return fs.FileSystem.from_uri(path)


class Shard:
    """A shard being written: ids go to the file as they come, only keys and lengths are held."""

    def __init__(self, folder: str, width: int):
        self.name, self.width = f"shard-{uuid.uuid4().hex}", width
        self.store, self.path = opened(folder)
        self.stream = self.store.open_output_stream(f"{self.path}/{self.name}.ids")
        self.keys, self.counts, self.n_bytes = [], [], 0

    def add(self, keys: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        raw = ids.astype(f"<u{self.width}").tobytes()
        self.stream.write(raw)
        self.keys.append(keys.drop_null().to_numpy())
        self.counts.append(counts)
        self.n_bytes += len(raw)

    def close(self) -> list:
        self.stream.close()
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        index = Index.of(keys, offsets_of(counts), self.width)
        with self.store.open_output_stream(f"{self.path}/{self.name}.mph") as f:
            f.write(index.to_bytes())
        border = (int(keys[0]), int(keys[-1])) if len(keys) else (None, None)
        return [self.name, *border, len(counts), int(counts.sum())]


# How the word tokenizer cuts letters from signs: a fixed value of its file.  It lower-cases letters before.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS_SIGNS = r"^(?P<a>[A-Za-z]+)(?P<b>[!-&(-/:-@\[-`{-~]*)$"


class WordEncoder:
    """Ids of texts for tokenizers that drop white space: each distinct word is encoded about once in a worker.

    Words are runs free of ASCII white space; such a tokenizer never joins what stands on both sides of it, so ids
    equal those of the whole text.  With ``cut``, ASCII letters, in lower case, and the signs after them are words of
    their own.
    """

    # A word that stands between others in one call, if it has one id; 64 words a call.
    MARK, JOINED = "\x01", 64

    def __init__(self, tokenizer, cut: bool = False, **bounds):
        self.tokenizer, self.words, self.cut = tokenizer, WordCache(self._new, **bounds), cut
        self.mark = tokenizer.encode(self.MARK, add_special_tokens=False).ids

    def _batch(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return flat([c.ids for c in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)])

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and how many each has.  Many short words go in one call."""
        if len(self.mark) != 1 or any(self.MARK in w for w in words):
            return self._batch(words)
        between = f" {self.MARK} "
        ids, _ = self._batch([between.join(words[i:i + self.JOINED]) + between for i in range(0, len(words), self.JOINED)])
        marks = ids == self.mark[0]
        return ids[~marks], np.diff(np.nonzero(marks)[0], prepend=-1) - 1

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        table = WordTable(texts)
        words = table.distinct.cast(pa.large_string())
        starts, counts = np.zeros((len(words), 2), dtype=np.int64), np.zeros((len(words), 2), dtype=np.int64)
        two = np.zeros(len(words), dtype=bool)
        parts = [words]
        if self.cut:
            pairs = pc.extract_regex(words, _LETTERS_SIGNS)
            two = pairs.is_valid().to_numpy(zero_copy_only=False).astype(bool)
            pairs = pairs.filter(pa.array(two))
            letters, signs = (pairs.field(c).cast(pa.large_string()) for c in "ab")
            parts = [words.filter(pa.array(~two)), pc.ascii_lower(letters), signs]
        coded = pa.concat_arrays(parts).dictionary_encode()
        at, n = (x[coded.indices.to_numpy(zero_copy_only=False)] for x in self.words.look_up(coded.dictionary.to_pylist()))
        one, more = int((~two).sum()), int(two.sum())
        for column, where, low in ((0, ~two, 0), (0, two, one), (1, two, one + more)):
            starts[where, column], counts[where, column] = (x[low:low + int(where.sum())] for x in (at, n))
        n = counts[table.ids]
        return (self.words.ids[ranges(starts[table.ids].ravel(), n.ravel())],
                np.diff(offsets_of(n.sum(axis=1))[table.word_ends]))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(spec: str) -> WordEncoder:
    """This worker's encoder, kept between tasks, for one tokenizer at a time."""
    if spec not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_str(spec)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _ENCODERS.clear()
        steps = json.loads(spec)
        first = (steps.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        lower = {"type": "Lowercase"} in (steps.get("normalizer") or {}).get("normalizers", [])
        _ENCODERS[spec] = WordEncoder(tokenizer, lower and first.get("pattern") == {"Regex": CUT} and first.get("invert") is True)
    return _ENCODERS[spec]


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = END_ID,
                 shard_bytes: int = SHARD_BYTES) -> str:
    """Encode ``docs(doc_id, text)`` and write them in ascending doc_id order; gives the folder.

    The tokenizer's file is read on the driver and has to be of a kind that drops white space.  ``folder``
    is a new path that all executors share (default: under ``spark.checkpoint.dir``).  Null and empty
    texts are the end id alone.  Rows without doc_id come first and have no key.  Rows that share a doc_id stand side
    by side in the order of their texts' hashes.  Other columns are ignored; an empty table gives a manifest without rows.
    """
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "tokens")
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    from tokenizers import Tokenizer
    width = 2 if Tokenizer.from_str(spec).get_vocab_size() <= 1 << 16 else 4
    shared = spark.sparkContext.broadcast(spec)
    store, path = opened(folder)
    store.create_dir(path)

    def write(batches):
        part, nth, shard = TaskContext.get().partitionId(), 0, None
        done = []
        encoder = encoder_of(shared.value)
        for some in text_slices(batches):
            bare, n = encoder.encode(some.column("text"))
            ids = np.full(len(bare) + len(n), end_id, dtype=np.int64)
            ids[ranges(offsets_of(n + 1)[:-1], n)] = bare
            shard = shard or Shard(folder, width)
            shard.add(some.column("doc_id"), ids, n + 1)
            if shard.n_bytes >= shard_bytes:
                done.append([part, nth, *shard.close()])
                nth, shard = nth + 1, None
        if shard:
            done.append([part, nth, *shard.close()])
        names = [c.split()[0] for c in MANIFEST.split(", ")]
        kinds = [pa.string() if "string" in c else pa.int64() for c in MANIFEST.split(", ")]
        yield pa.RecordBatch.from_arrays(
            [pa.array([row[i] for row in done], kind) for i, kind in enumerate(kinds)], names=names)

    # Equal rows are told apart by their number, so that no doc_id has to fit into one task.
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumns(
        {"_tie": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    order = ["doc_id", "_tie", "_row"]
    manifest = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(
        write, MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return folder


def manifest_of(spark: SparkSession, folder: str) -> DataFrame:
    """Shards in order, ``start`` the ids before each.  One row for ``SHARD_BYTES`` of ids or a task."""
    earlier = W.orderBy("part", "nth").rowsBetween(W.unboundedPreceding, -1)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").withColumn(
        "start", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))


def read_index(folder: str, name: str) -> Index:
    store, path = opened(folder)
    with store.open_input_stream(f"{path}/{name}.mph") as f:
        return Index.from_bytes(f.read())


def _payload(folder: str, name: str, index: Index, first: np.ndarray, last: np.ndarray):
    """Documents [first, last), run by run: ``(run, document, ids, ends)`` in blocks of about READ_BYTES."""
    store, path = opened(folder)
    with store.open_input_file(f"{path}/{name}.ids") as f:
        for run, (a, b) in enumerate(zip(first.tolist(), last.tolist())):
            while a < b:
                most = int(np.searchsorted(index.ends, index.ends[a] + READ_BYTES // index.width, side="right")) - 1
                stop = min(max(most, a + 1), b)
                low, high = int(index.ends[a]), int(index.ends[stop])
                raw = f.read_at((high - low) * index.width, low * index.width)
                yield run, np.arange(a, stop), np.frombuffer(raw, dtype=f"<u{index.width}"), index.ends[a:stop + 1] - low
                a = stop


DOCUMENT = "doc_id long, start long, ids array<int>"
RAW_DOCUMENT = "doc_id long, start long, ids binary"


def _rows(keys: pa.Array, start: np.ndarray, ids: np.ndarray, ends: np.ndarray, raw: bool = False) -> pa.RecordBatch:
    if raw:
        cells = pa.Array.from_buffers(pa.binary(), len(keys), [
            None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(ids.astype("<u4").tobytes())])
    else:
        cells = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
    return pa.RecordBatch.from_arrays([keys, pa.array(start), cells], names=["doc_id", "start", "ids"])


def read_documents(spark: SparkSession, folder: str, raw: bool = False) -> DataFrame:
    """All documents of a folder: ``(doc_id, start, ids)``, ``start`` being the ids before the document.

    With ``raw`` the ids are binary, as little-endian 32-bit numbers.  Every key of a shard is looked up in its index, and the ids are read from where the index says.
    """
    manifest = manifest_of(spark, folder).select("name", "start")
    n = max(1, min(manifest.count(), spark.sparkContext.defaultParallelism * 8))

    def read(batches):
        for b in batches:
            for name, before in zip(b.column("name").to_pylist(), b.column("start").to_pylist()):
                index = read_index(folder, name)
                own = np.unique(index.keys)
                first, copies = index.lookup(own)
                last = first + copies
                bare = index.n_without_key
                joined = first[1:] == last[:-1]  # neighbours are read in one go
                a = np.append(first[:1], first[1:][~joined])
                z = np.append(last[:-1][~joined], last[-1:])
                for _, at, ids, ends in _payload(folder, name, index, np.append([0], a), np.append([bare], z)):
                    named = at >= bare
                    keys = pa.array(index.keys[np.maximum(at - bare, 0)] if len(index.keys) else at, pa.int64(), mask=~named)
                    yield _rows(keys, before + index.ends[at], ids, ends, raw)

    return manifest.repartition(n, "name").mapInArrow(read, RAW_DOCUMENT if raw else DOCUMENT)


def fetch(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """Keyed access: ``(doc_id, start, ids)`` of the documents whose ids are in ``keys(doc_id)``.

    Each distinct key is asked once, of the shards whose borders hold it; repeated documents are all given.
    Null keys and keys of no document give no rows.  A key that is not there is taken for another one
    with a chance of 2^-32 by the fingerprint, so the key of what was found is compared as well.
    """
    shards = manifest_of(spark, folder).where("first_key IS NOT NULL").select("name", "start", "first_key", "last_key")
    asked = keys.select(F.col("doc_id").cast("long")).where("doc_id IS NOT NULL").distinct()
    # Keys and shards are dealt by ranges of keys; a shard goes to every range that it reaches into.
    store, path = opened(folder)
    listing = f"directory-{uuid.uuid4().hex}.arrow"

    def list_shards(batches):
        some = list(batches)
        n = sum(b.num_rows for b in some)
        if n:
            table = pa.Table.from_batches(some).sort_by([("first_key", "ascending"), ("last_key", "ascending")])
            with store.open_output_stream(f"{path}/{listing}") as f, pa.ipc.new_file(f, table.schema) as out:
                out.write_table(table)
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    # The directory, some 60 bytes for a shard, is one sorted file that tasks search.
    n = shards.coalesce(1).mapInArrow(list_shards, "n long").agg(F.sum("n")).first()[0] or 0
    if not n:
        return spark.createDataFrame([], DOCUMENT)

    def route(batches):
        with store.open_input_file(f"{path}/{listing}") as f:
            table = pa.ipc.open_file(f).read_all()
        first, last = (table.column(c).to_numpy() for c in ("first_key", "last_key"))
        for b in batches:
            key = b.column("doc_id").to_numpy(zero_copy_only=False)
            low = np.searchsorted(last, key, side="left")
            size = np.maximum(np.searchsorted(first, key, side="right") - low, 0)
            at = ranges(low, size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(key, size)), *(table.column(c).take(pa.array(at)).combine_chunks() for c in ("name", "start"))],
                names=["doc_id", "name", "start"])

    def read(batches):
        held, index = None, None
        for b in batches:
            order = {}
            for i, name in enumerate(b.column("name").to_pylist()):
                order.setdefault(name, []).append(i)
            for name, rows in order.items():
                if name != held:
                    held, index = name, read_index(folder, name)
                own = b.column("doc_id").take(pa.array(rows)).to_numpy(zero_copy_only=False)
                before = b.column("start")[rows[0]].as_py()
                first, copies = index.lookup(own)
                same = (first >= 0) & (index.keys[np.maximum(first - index.n_without_key, 0)] == own)
                own, first, copies = own[same], first[same], copies[same]
                for run, at, ids, ends in _payload(folder, name, index, first, first + copies):
                    yield _rows(pa.array(np.full(len(at), own[run])), before + index.ends[at], ids, ends)

    return asked.mapInArrow(route, "doc_id long, name string, start long").repartition("name").sortWithinPartitions(
        "name", "doc_id").mapInArrow(read, DOCUMENT)
