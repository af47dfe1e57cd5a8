"""Alignment of two tokenizers' ids over the same bytes, and how often two ids go together.

Each text is encoded by a byte-level BPE (A) and by a piece model (B).  The byte offsets at which tokens of
both end cut them into groups.  The two sorted lists of ends are intersected by galloping: the shorter one drives an
exponential and then binary search into the longer.  A group's tokens are the differences of the ranks of two
neighbouring common ends.

All pairs of an A and a B token in one group are linked.  A document counts once for a pair.  Documents are
kept in slices with the distinct pairs of each slice beside them, so that only those pairs are counted across slices and
sent back, and never a document's links.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.shared import written
from .bpe import Encoder, Vocabulary, load_vocabulary
from .common import offsets_of, ranges, text_slices
from .word_cache import WordCache, flat

# Bits of an id in a pair; ends that one lane of the search goes through; pairs worked on at once.
ID_BITS = 20
LANE = 64
PAIRS = 1 << 21


# --- tokens and their bytes ------------------------------------------------------------------

@dataclass
class Tokens:
    """Bytes of every id: ``data[ends[i]:ends[i + 1]]``."""
    data: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, raw: list[bytes]) -> Tokens:
        return cls(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets_of(np.array([len(r) for r in raw])))

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        return self.ends[ids + 1] - self.ends[ids]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ranges(self.ends[ids], self.sizes(ids))]


def byte_tokens(vocabulary: Vocabulary) -> Tokens:
    return Tokens(vocabulary.token_bytes, vocabulary.token_ends)


def piece_tokens(model: bytes) -> Tokens:
    """Pieces in UTF-8, U+2581 as a space, and <0xHH> as a byte."""
    import sentencepiece
    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    return Tokens.of([bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i)
                      else pieces.id_to_piece(i).replace("▁", " ").encode() for i in range(pieces.get_piece_size())])


class PieceEncoder:
    """Ids of texts by the piece model, which sets a space before each text.

    No piece has a space after anything else, so no piece goes beyond a word and the one space before it: words between
    single spaces are encoded about once in a worker.  Texts with other spaces, or all if there is
    such a piece, are encoded whole.
    """

    def __init__(self, model: bytes):
        import sentencepiece
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.words = WordCache(lambda some: flat(self.pieces.encode(some, num_threads=1)))
        every = (self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size()))
        self.apart = not any("▁" in p.lstrip("▁") for p in every)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        whole = pc.or_(pc.match_substring_regex(texts, "  |^ | $"), pc.equal(pc.binary_length(texts), 0))
        whole = whole.to_numpy(zero_copy_only=False).astype(bool) | (not self.apart)
        lists = pc.split_pattern(texts.filter(pa.array(~whole)), " ")
        coded = lists.flatten().dictionary_encode()
        starts, counts = self.words.look_up(coded.dictionary.to_pylist())
        at = coded.indices.to_numpy(zero_copy_only=False)
        ids = self.words.ids[ranges(starts[at], counts[at])]
        per_text = np.diff(offsets_of(counts[at])[offsets_of(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        if not whole.any():
            return ids, per_text
        more, n = flat(self.pieces.encode(texts.filter(pa.array(whole)).to_pylist(), num_threads=1))
        size = np.zeros(len(texts), dtype=np.int64)
        size[~whole], size[whole] = per_text, n
        ends = offsets_of(size)
        out = np.empty(int(ends[-1]), dtype=np.int32)
        out[ranges(ends[:-1][~whole], per_text)], out[ranges(ends[:-1][whole], n)] = ids, more
        return out, size


_PIECES: dict[bytes, PieceEncoder] = {}


def pieces_of(model: bytes) -> PieceEncoder:
    """This worker's encoder, kept between tasks, for one model at a time."""
    if model not in _PIECES:
        _PIECES.clear()
        _PIECES[model] = PieceEncoder(model)
    return _PIECES[model]


# --- galloping -------------------------------------------------------------------------------

def gallop(drive: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each of the sorted ``drive`` its place in the sorted ``other``, or -1 where it is not there.

    Lanes of ``LANE`` ends go side by side.  A lane remembers where it stands, doubles its stride
    until it has passed the wanted end, and then halves the stretch that it has jumped over.
    """
    n = len(drive)
    out = np.full(n, -1, dtype=np.int64)
    if not n or not len(other):
        return out
    lanes = np.arange(0, n, LANE)
    low = np.searchsorted(other, drive[lanes])  # where a lane sets out
    last = len(other)
    for k in range(LANE):
        at = lanes + k
        live = np.nonzero(at < n)[0]
        if not len(live):
            break
        wanted, a = drive[at[live]], low[live]
        stride = np.ones(len(live), dtype=np.int64)
        b = a.copy()  # everything before a is smaller; b grows until it is not
        going = np.nonzero((b < last) & (other[np.minimum(b, last - 1)] < wanted))[0]
        while len(going):
            a[going] = b[going] + 1
            b[going] = np.minimum(b[going] + stride[going], last)
            stride[going] *= 2
            going = going[(b[going] < last) & (other[np.minimum(b[going], last - 1)] < wanted[going])]
        open_ = np.nonzero(a < b)[0]
        while len(open_):
            middle = (a[open_] + b[open_]) // 2
            smaller = other[middle] < wanted[open_]
            a[open_] = np.where(smaller, middle + 1, a[open_])
            b[open_] = np.where(smaller, b[open_], middle)
            open_ = open_[a[open_] < b[open_]]
        low[live] = a
        hit = other[np.minimum(a, last - 1)] == wanted
        out[at[live[hit]]] = a[hit]
    return out


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in both lists of the ends that they share."""
    drive, other = (a, b) if len(a) <= len(b) else (b, a)
    found = gallop(drive, other)
    here = np.nonzero(found >= 0)[0]
    return (here, found[here]) if drive is a else (found[here], here)


# --- documents -------------------------------------------------------------------------------

@dataclass
class Aligned:
    """Some documents side by side.  Group g of ids_a is [cut_a[g], cut_a[g + 1]), and likewise of ids_b."""
    ids_a: np.ndarray
    ids_b: np.ndarray
    ends_a: np.ndarray   # tokens before each document
    ends_b: np.ndarray
    sizes_a: np.ndarray  # tokens of each group
    sizes_b: np.ndarray
    groups: np.ndarray   # groups before each document

    @property
    def doc_of_group(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.groups) - 1), np.diff(self.groups))

    def n_links(self) -> np.ndarray:
        return np.diff(offsets_of(self.sizes_a * self.sizes_b)[self.groups])


def align(texts: pa.Array, encoder_a: Encoder, encoder_b: PieceEncoder, tokens_a: Tokens, tokens_b: Tokens) -> Aligned:
    """Null and empty texts, and those that a tokenizer does not give back byte by byte, have no tokens."""
    texts = texts.cast(pa.large_string()).fill_null("")
    none, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    spaced = pc.binary_join_element_wise(none, texts, space)  # the last one goes between
    ids_a, ends = encoder_a.encode(spaced)
    n_a = np.diff(ends)
    ids_b, n_b = encoder_b.encode(texts)
    size = pc.binary_length(spaced).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.frombuffer(spaced.buffers()[1], dtype=np.int64)[spaced.offset:spaced.offset + len(spaced) + 1]
    data = np.frombuffer(spaced.buffers()[2] or b"", dtype=np.uint8)
    whole = size > 1
    for tokens, ids, n in ((tokens_a, ids_a, n_a), (tokens_b, ids_b, n_b)):
        got = offsets_of(tokens.sizes(ids))[offsets_of(n)]
        whole &= np.diff(got) == size
        bytes_ = tokens.joined(ids)
        same = np.nonzero(whole)[0]
        differ = bytes_[ranges(got[same], size[same])] != data[ranges(at[same], size[same])]
        whole[same[np.diff(offsets_of(differ)[offsets_of(size[same])]) > 0]] = False
    ids_a, n_a = ids_a[np.repeat(whole, n_a)].astype(np.int64), np.where(whole, n_a, 0)
    ids_b, n_b = ids_b[np.repeat(whole, n_b)].astype(np.int64), np.where(whole, n_b, 0)
    # Texts follow each other in one run of bytes, so a text's end is common and no group goes beyond it.
    at_a, at_b = common_ends(np.cumsum(tokens_a.sizes(ids_a)), np.cumsum(tokens_b.sizes(ids_b)))
    ends_a = offsets_of(n_a)
    groups = np.searchsorted(at_a + 1, ends_a, side="right")
    return Aligned(ids_a, ids_b, ends_a, offsets_of(n_b), np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1), groups)


_DIGITS = {}


def group_strings(x: Aligned) -> list[bytes]:
    """Each document's ``a1,a2|b1;a3|b2,b3``, all built at once: a token's digits and the sign after it."""
    n_a, n_b = len(x.ids_a), len(x.ids_b)
    cut_a, cut_b = np.cumsum(x.sizes_a), np.cumsum(x.sizes_b)
    g_a, g_b = np.repeat(np.arange(len(cut_a)), x.sizes_a), np.repeat(np.arange(len(cut_b)), x.sizes_b)
    place_a = np.arange(n_a) + (cut_b - x.sizes_b)[g_a]
    place_b = np.arange(n_b) + cut_a[g_b]
    ids, sign = np.empty(n_a + n_b, dtype=np.int64), np.full(n_a + n_b, ord(","), dtype=np.uint8)
    ids[place_a], ids[place_b] = x.ids_a, x.ids_b
    sign[place_a[cut_a - 1]], sign[place_b[cut_b - 1]] = ord("|"), ord(";")
    top = int(ids.max(initial=0)) + 1
    if _DIGITS.get("n", 0) < top:
        shown = [b"%d" % i for i in range(top)]
        _DIGITS.update(n=top, ends=offsets_of(np.array([len(s) for s in shown])),
                       data=np.frombuffer(b"".join(shown), dtype=np.uint8))
    starts = _DIGITS["ends"][ids]
    size = _DIGITS["ends"][ids + 1] - starts
    ends = offsets_of(size + 1)
    out = np.empty(int(ends[-1]), dtype=np.uint8)
    out[ranges(ends[:-1], size)] = _DIGITS["data"][ranges(starts, size)]
    out[ends[1:] - 1] = sign
    raw = out.tobytes()
    at = ends[x.ends_a + x.ends_b].tolist()
    return [raw[a:max(a, b - 1)] for a, b in zip(at[:-1], at[1:])]


def links(x: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``(document, pair)`` in order, and how many links each stands for.

    A large group's tokens are counted by id before they are paired, and groups are paired some at a time.
    """
    def by_id(sizes, ids):
        group = np.repeat(np.arange(len(sizes)), sizes)
        own, times = np.unique((group << ID_BITS) | ids, return_counts=True)
        return own >> ID_BITS, own & ((1 << ID_BITS) - 1), times

    group_a, ids_a, times_a = by_id(x.sizes_a, x.ids_a)
    group_b, ids_b, times_b = by_id(x.sizes_b, x.ids_b)
    first_b = np.searchsorted(group_b, np.arange(len(x.sizes_a) + 1))
    doc_of = x.doc_of_group
    width = (first_b[1:] - first_b[:-1])[group_a]
    before = offsets_of(width)
    parts, low = [], 0
    while low < len(group_a):
        high = max(low + 1, int(np.searchsorted(before, before[low] + PAIRS, side="right")) - 1)
        rows = np.repeat(np.arange(low, high), width[low:high])
        other = ranges(first_b[group_a[low:high]], width[low:high])
        parts.append(summed(doc_of[group_a[rows]], (ids_a[rows] << ID_BITS) | ids_b[other], times_a[rows] * times_b[other]))
        low = high
    if len(parts) == 1:
        return parts[0]
    return summed(*(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, dtype=np.int64) for i in range(3)))


def summed(doc: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own, at = np.unique(pair, return_inverse=True)
    key, place = np.unique(doc * max(len(own), 1) + at, return_inverse=True)
    total = np.bincount(place, weights=times, minlength=len(key)).astype(np.int64)
    return key // max(len(own), 1), own[key % max(len(own), 1)], total


def packed(doc: np.ndarray, place: np.ndarray, times: np.ndarray, n_docs: int) -> tuple[pa.Array, pa.Array]:
    """Two binary cells a document: a byte for each gap between places and then for each number of times, and what
    does not fit into a byte (marked by 255) as 64-bit numbers."""
    n = np.bincount(doc, minlength=n_docs)
    ends = offsets_of(n)
    gap = np.diff(place, prepend=0)
    gap[ends[:-1][n > 0]] = place[ends[:-1][n > 0]]
    inner = ranges(np.zeros(n_docs, dtype=np.int64), n)
    at = 2 * ends[doc] + inner
    values = np.empty(2 * len(doc), dtype=np.int64)
    values[at], values[at + n[doc]] = gap, times
    big = values >= 255
    return (_cells(np.where(big, 255, values), 2 * ends, "u1"), _cells(values[big], offsets_of(big)[2 * ends], "<i8"))


def unpacked(marks: pa.Array, large: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document, place, times)`` of ``packed`` cells."""
    values, ends = _values(marks, "u1")
    values[values == 255] = _values(large, "<i8")[0]
    n = np.diff(ends) // 2
    doc = np.repeat(np.arange(len(n)), n)
    at = ends[:-1][doc] + ranges(np.zeros(len(n), dtype=np.int64), n)
    total = offsets_of(values[at])
    first = offsets_of(n)[:-1]
    return doc, total[1:] - total[first][doc], values[at + n[doc]]


# --- Spark -----------------------------------------------------------------------------------

GROUPED = "doc_id long, ids_a array<int>, ids_b array<int>, sizes_a array<int>, sizes_b array<int>"
NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _aligned_slices(spark: SparkSession, byte_path: str, piece_path: str):
    """Both files are read on the driver."""
    with open(piece_path, "rb") as f:
        model = f.read()
    vocabulary = load_vocabulary(byte_path)
    vocabulary.special = {}  # their strings are plain text here
    shared = spark.sparkContext.broadcast((vocabulary, model, piece_tokens(model)))

    def slices(batches):
        vocabulary, model, tokens_b = shared.value
        a, b = Encoder(vocabulary), pieces_of(model)
        for part in text_slices(batches):
            yield part.column("doc_id"), align(part.column("text"), a, b, byte_tokens(vocabulary), tokens_b)

    return slices


def align_documents(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, ids_a, ids_b, sizes_a, sizes_b)``: both tokenizers' ids, and how many of them
    each group takes.

    A reads a space and the text by the byte-level file, B the text by the piece model, which adds the space; the strings
    of special tokens are plain text.  Texts that are null or empty, or whose tokens' bytes are not those of
    the space and the text, have empty lists.  Repeated rows are given each, null ids kept; other
    columns are ignored.
    """
    slices = _aligned_slices(docs.sparkSession, byte_path, piece_path)

    def work(batches):
        for doc_ids, x in slices(batches):
            lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32)))
                     for ends, values in ((x.ends_a, x.ids_a), (x.ends_b, x.ids_b), (x.groups, x.sizes_a),
                                          (x.groups, x.sizes_b))]
            yield pa.RecordBatch.from_arrays([doc_ids, *lists], names=[c.split()[0] for c in GROUPED.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, GROUPED)


def _cells(values: np.ndarray, ends: np.ndarray, kind: str) -> pa.Array:
    """A binary cell of little-endian numbers for each stretch."""
    width = np.dtype(kind).itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [
        None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(values.astype(kind).tobytes())])


def _values(cells: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    cells = cells.cast(pa.large_binary())
    ends = np.frombuffer(cells.buffers()[1], dtype=np.int64)[cells.offset:cells.offset + len(cells) + 1]
    data = np.frombuffer((cells.buffers()[2] or b"")[ends[0]:ends[-1]] if len(cells) else b"", dtype=kind)
    return data.astype(np.int64), (ends - ends[0]) // np.dtype(kind).itemsize


def _stored(docs: DataFrame, byte_path: str, piece_path: str, extra: dict) -> DataFrame:
    """One row a document, and for each slice of documents one row with its distinct pairs (``doc_id`` null) and how many
    of its documents hold each.  ``slice`` names the slice, ``marks`` and ``large`` are ``packed`` places of pairs."""
    slices = _aligned_slices(docs.sparkSession, byte_path, piece_path)
    kinds = {"slice": "long", "doc_id": "long", **dict.fromkeys(NUMBERS, "long"), "marks": "binary", "large": "binary",
             "pairs": "binary", "pair_docs": "binary", **{name: kind for name, (kind, _) in extra.items()}}
    schema = ", ".join(f"`{name}` {kind}" for name, kind in kinds.items())

    def work(batches):
        first = TaskContext.get().partitionId() << 32
        for nth, (doc_ids, x) in enumerate(slices(batches)):
            n = len(doc_ids)
            doc, pair, times = links(x)
            own, place, n_docs = np.unique(pair, return_inverse=True, return_counts=True)
            columns = {"doc_id": doc_ids, "slice": pa.array(np.full(n, first + nth)),
                       **dict(zip(NUMBERS, map(pa.array, (np.diff(x.ends_a), np.diff(x.ends_b), np.diff(x.groups), x.n_links())))),
                       **dict(zip(("marks", "large"), packed(doc, place, times, n))),
                       **{name: pa.array(f(x)) for name, (_, f) in extra.items()}}
            whole = np.array([0, len(own)])
            of_slice = {"slice": pa.array([first + nth]), "pairs": _cells(own, whole, "<i8"),
                        "pair_docs": _cells(n_docs, whole, "<i8")}
            types = {name: columns.get(name, of_slice.get(name)).type for name in kinds}
            for some, size in ((columns, n), (of_slice, 1)):
                yield pa.RecordBatch.from_arrays([some.get(name, pa.nulls(size, types[name])) for name in kinds],
                                                 names=list(kinds))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)


def _slice_pairs(rows: DataFrame) -> DataFrame:
    """``(slice, a, b, n)``: the distinct pairs of each slice, with the documents that hold them."""
    def work(batches):
        for batch in batches:
            pairs, ends = _values(batch.column("pairs"), "<i8")
            times, _ = _values(batch.column("pair_docs"), "<i8")
            name = np.repeat(batch.column("slice").to_numpy(zero_copy_only=False), np.diff(ends))
            yield pa.RecordBatch.from_arrays(
                [pa.array(name), pa.array((pairs >> ID_BITS).astype(np.int32)),
                 pa.array((pairs & ((1 << ID_BITS) - 1)).astype(np.int32)), pa.array(times)], names=["slice", "a", "b", "n"])

    return rows.where("pairs IS NOT NULL").select("slice", "pairs", "pair_docs").mapInArrow(
        work, "slice long, a int, b int, n long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``(a, b, n)`` rows to ``(a, b, n_docs, best)``: the sum of two ids' rows, and the highest sum of the id a.

    ``best`` has one row an id of A, so the vocabulary bounds what is broadcast.
    """
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("n_docs"))
    return counts.join(F.broadcast(counts.groupBy("a").agg(F.max("n_docs").alias("best"))), "a")


def score_links(docs: DataFrame, byte_path: str, piece_path: str, extra: dict | None = None) -> DataFrame:
    """``docs(doc_id, text)`` to one row each: numbers of tokens, groups and links, how many links have the highest
    count of their A id (``n_best``), and the sum of the links' counts (``count_sum``).

    ``extra`` maps names of further columns to their type and a function from some documents' ``Aligned`` to values.
    See ``align_documents`` for what has no tokens.  Rows that share a doc_id count each.  An empty table gives
    no rows.
    """
    extra = extra or {}
    rows = written(_stored(docs, byte_path, piece_path, extra), "aligned")
    pairs = written(_slice_pairs(rows), "pairs")
    counts = written(pair_counts(pairs), "pair-counts")
    known = pairs.select("slice", "a", "b").join(counts, ["a", "b"]).select(
        "slice", ((F.col("a").cast("long") * (1 << ID_BITS)) + F.col("b")).alias("pair"), "n_docs",
        (F.col("n_docs") == F.col("best")).alias("top"))
    kept = ["doc_id", *NUMBERS, *extra]
    schema = ", ".join(["doc_id long", *(f"{c} long" for c in (*NUMBERS, "n_best", "count_sum")),
                        *(f"`{name}` {kind}" for name, (kind, _) in extra.items())])

    def score(table: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(known.column("pair").to_numpy(), kind="stable")
        n_docs, top = known.column("n_docs").to_numpy()[order], known.column("top").to_numpy()[order]
        doc, place, times = unpacked(*(table.column(c).combine_chunks() for c in ("marks", "large")))
        n_best, total = np.zeros(table.num_rows, dtype=np.int64), np.zeros(table.num_rows, dtype=np.int64)
        np.add.at(n_best, doc, times * top[place])
        np.add.at(total, doc, times * n_docs[place])
        own = {c: table.column(c) for c in kept}
        return pa.table({"doc_id": own.pop("doc_id"), **{c: own.pop(c) for c in NUMBERS}, "n_best": pa.array(n_best),
                         "count_sum": pa.array(total), **own})

    documents = rows.where("pairs IS NULL").select("slice", *kept, "marks", "large")
    return documents.groupBy("slice").cogroup(known.groupBy("slice")).applyInArrow(score, schema)
