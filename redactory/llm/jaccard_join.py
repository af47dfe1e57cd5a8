"""N-gram Jaccard join by T-occurrence search, and the components of its links.

1. Documents are dealt to chunks.  Every chunk sends its shingles to shards, which answer with the lengths of
   their inverted lists.  A set of n shingles that links must share all but (1 - 0.9) n of them, so a set with too few
   shared shingles is out.  One that stays meets others by its *rarest* shared shingles: as many as must include one of
   any partner's.  Sets of many shingles use a fixed part of all shingles instead of all, by hash.
2. Connected components of these meetings are *blocks*; no link leaves a block.  Equal sets are one class, and
   only one document a class goes on.
3. In a block, inverted lists of shingles are searched by DivideSkip: a set of size n needs T = 0.9 n
   common shingles, so its longest lists are left aside, the short ones are merged by count, and what is still in
   the running is probed in the long ones by binary search.  Exact counts decide.
4. A block too large for one task first compares all its sets with one pivot; sets linked to it are one
   component already, and only the rest is searched against the whole block, part by part.

Links within a component that add nothing to it are not written out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..plans.salting import salted_join
from ..plans.shared import written
from .common import ODD_1, ODD_2, WordTable, by_shard, components, mix, offsets_of, ranges, shuffle_partitions

SHINGLE = 3
PERCENT = 90
CHUNK_BYTES = 4 << 20           # of text in one chunk
SHARD_BYTES = 32 << 20          # of text behind one shard of shingles
TASK_BYTES, TASK_SETS = 4 << 20, 1000  # of text and sets searched in one task
MEETS = 8                       # tasks at least that shards' tokens meet in, whatever the partitions
MANY = 400                      # from this size on, a set meets others by part of its shingles, if that is enough
MERGE_COST = 0.01               # DivideSkip's weight of a merge against a probe


class ShingleSets:
    """Distinct shingles of some texts: set d is ``hashes[ends[d]:ends[d + 1]]``, sorted."""

    def __init__(self, texts: pa.Array, size: int = SHINGLE):
        words = WordTable(texts, lower=True)
        h, n = words.hashes, len(words.hashes)
        left = words.word_ends[1:][words.doc_of] - np.arange(n)
        full = np.nonzero(left >= size)[0]
        acc = np.zeros(len(full), dtype=np.uint64)
        for k in range(size):
            acc = acc * ODD_1 + h[full + k]
        hashes, docs = mix(acc + np.uint64(size)), words.doc_of[full]
        short = np.nonzero((words.n_words > 0) & (words.n_words < size))[0]  # the whole sequence as one
        if len(short):
            acc = np.zeros(len(short), dtype=np.uint64)
            for k in range(size - 1):
                more = words.n_words[short] > k
                acc[more] = acc[more] * ODD_1 + h[words.word_ends[short[more]] + k]
            hashes = np.concatenate([hashes, mix(acc + words.n_words[short].astype(np.uint64))])
            docs = np.concatenate([docs, short])
        order = np.lexsort((hashes, docs))
        hashes, docs = hashes[order], docs[order]
        new = np.ones(len(hashes), dtype=bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
        self.hashes, self.doc_of = hashes[new], docs[new]
        self.sizes = np.bincount(self.doc_of, minlength=words.n_docs).astype(np.int64)
        self.ends = offsets_of(self.sizes)

    def __len__(self) -> int:
        return len(self.sizes)

    def set_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each set, the same in any order."""
        out = []
        for odd in (ODD_1, ODD_2):
            total = np.zeros(len(self), dtype=np.uint64)
            np.add.at(total, self.doc_of, mix(self.hashes * odd))
            out.append(mix(total + self.sizes.astype(np.uint64)).astype(np.int64))
        return out[0], out[1]


def part_of_all(percent: int) -> float:
    """Share of all shingles that stands for large sets: well above what a linked set may miss."""
    return min(1.0, 2.5 * (100 - percent) / 100)


class Universe:
    """Those sets (``takes``) and shingles (``within``) of a chunk that meet under one rule."""

    def __init__(self, sets: ShingleSets, name: int, percent: int, takes: np.ndarray, within: np.ndarray):
        mask = takes[sets.doc_of] & within
        self.hashes, self.doc_of = sets.hashes[mask], sets.doc_of[mask]
        held = np.bincount(self.doc_of, minlength=len(sets))
        self.need = held - sets.sizes * (100 - percent) // 100  # shared shingles of a linked set
        self.name = np.uint64(name)

    def prefixes(self, length: np.ndarray, n_sets: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and their sets: the rarest shared shingles of each set that can have a link.

        ``length`` is the list length of each shingle here, as a code; 0 is a shingle of one document only.
        """
        shared = length > 0
        h, doc, code = self.hashes[shared], self.doc_of[shared], length[shared]
        order = np.lexsort((h, code, doc))
        h, doc = h[order], doc[order]
        count = np.bincount(doc, minlength=n_sets)
        place = np.arange(len(doc)) - offsets_of(count)[doc]
        keep = place < (count - np.maximum(self.need, 1) + 1)[doc]
        return mix(h[keep] + self.name), doc[keep]


def universes(sets: ShingleSets, percent: int, has_id: np.ndarray, many: int | None = None,
              part: float | None = None) -> list[Universe]:
    """The rules that sets meet under; any two linked sets share a token of one of them.

    Small sets meet by all shingles, large ones by a part of all shingles; sizes between belong to both.  A linked
    set misses at most (100 - percent) % of its shingles.  If the part of one of two linked large sets holds more
    than that, they share one of its shingles.  Sets whose part holds no more meet by all shingles as well, so two
    of them find each other there.
    """
    n = sets.sizes
    takes = (n > 0) & has_id
    everything = np.ones(len(sets.hashes), dtype=bool)
    many = MANY if many is None else many
    part = part_of_all(percent) if part is None else part
    in_part = sets.hashes < np.uint64(min(part * 2.0**64, 2.0**64 - 2.0**12))
    held = np.bincount(sets.doc_of[in_part], minlength=len(sets))
    large = takes & (n >= many)
    return [Universe(sets, 1, percent, takes & (n * percent < 100 * many), everything),
            Universe(sets, 2, percent, large, in_part),
            Universe(sets, 3, percent, large & (held <= n * (100 - percent) // 100), everything)]


LISTS = "shard long, chunk long, keys binary, counts binary"
LENGTHS = "chunk long, shard long, codes binary"


def chunk_entries(parts: list[Universe]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a chunk, and how many of its documents hold each."""
    hashes = np.concatenate([p.hashes for p in parts])
    docs = np.concatenate([p.doc_of for p in parts])
    order = np.lexsort((docs, hashes))
    hashes, docs = hashes[order], docs[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1]))[:len(hashes)]
    return np.unique(hashes[new], return_counts=True)


def _lengths(requests: pa.Table) -> pa.Table:
    """One shard: each chunk's shingles with a code of their list length, 0 for a single document."""
    blobs = requests.column("keys").to_pylist()
    sizes = np.array([len(b) // 8 for b in blobs], dtype=np.int64)
    keys = np.frombuffer(b"".join(blobs), dtype=np.uint64)
    counts = np.frombuffer(b"".join(requests.column("counts").to_pylist()), dtype=np.uint32)
    _, group = np.unique(keys, return_inverse=True)
    total = np.bincount(group, weights=counts)
    codes = np.minimum(255, np.round(6 * np.log2(np.maximum(total, 1)))).astype(np.uint8)[group]
    at = offsets_of(sizes)
    return pa.table({"chunk": requests.column("chunk"), "shard": requests.column("shard"),
                     "codes": pa.array([codes[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())})


SURVEYED = ("kind int, doc_id long, n_shingles long, n_bytes long, set_a long, set_b long, a long, b long, "
            "shard long, chunk long, keys binary, low binary")


def _table(**columns) -> pa.RecordBatch:
    """A batch of SURVEYED rows; columns not given are null."""
    n = len(next(v for k, v in columns.items() if k != "kind"))
    arrays, names = [], []
    for field in SURVEYED.split(", "):
        name, kind = field.split()
        kind = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[kind]
        value = columns.get(name)
        arrays.append(pa.nulls(n, kind) if value is None else
                      pa.array(np.full(n, value), kind) if name == "kind" else pa.array(value, kind))
        names.append(name)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def survey(docs: DataFrame, n_chunks: int, n_shards: int, size: int, percent: int) -> DataFrame:
    """Kind 0 a document's set, kind 1 a meeting within a chunk, kind 2 a chunk's tokens for a shard."""
    dealt = docs.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 64)), F.lit(n_chunks)))

    def opened(table: pa.Table):
        sets = ShingleSets(table.column("text").combine_chunks(), size)
        ids = table.column("doc_id")
        has_id = np.array(ids.is_valid().to_numpy(), dtype=bool)
        return sets, has_id, ids.fill_null(0).to_numpy(), universes(sets, percent, has_id)

    def ask(table: pa.Table) -> pa.Table:
        *_, parts = opened(table)
        keys, counts = chunk_entries(parts)
        order, shards, at = by_shard(keys, n_shards)
        keys, counts = keys[order], counts[order].astype(np.uint32)
        cuts = list(zip(at[:-1], at[1:]))
        return pa.table({"shard": pa.array(shards, pa.int64()),
                         "chunk": pa.array(np.full(len(shards), table.column("_chunk")[0].as_py()), pa.int64()),
                         "keys": pa.array([keys[a:b].tobytes() for a, b in cuts], pa.binary()),
                         "counts": pa.array([counts[a:b].tobytes() for a, b in cuts], pa.binary())})

    def meet(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_batches([_table(kind=0, doc_id=pa.array([], pa.int64()))])
        sets, has_id, ids, parts = opened(table)
        keys, _ = chunk_entries(parts)
        order, shards, at = by_shard(keys, n_shards)
        codes = np.zeros(len(keys), dtype=np.uint8)
        got = dict(zip(answers.column("shard").to_pylist(), answers.column("codes").to_pylist()))
        for s, x, y in zip(shards.tolist(), at[:-1], at[1:]):
            codes[order[x:y]] = np.frombuffer(got[s], dtype=np.uint8)
        found = [p.prefixes(codes[np.searchsorted(keys, p.hashes)], len(sets)) for p in parts]
        tokens, who = np.concatenate([f[0] for f in found]), ids[np.concatenate([f[1] for f in found])]
        a, b = sets.set_hashes()
        texts = table.column("text").combine_chunks()
        n_bytes = np.nan_to_num(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
        out = [_table(kind=0, doc_id=table.column("doc_id").combine_chunks(), n_shingles=sets.sizes, n_bytes=n_bytes,
                      set_a=a, set_b=b)]
        order = np.lexsort((who, tokens))
        tokens, who = tokens[order], who[order]
        new = np.append(True, tokens[1:] != tokens[:-1])[:len(tokens)]
        low = who[new]
        met = low[np.cumsum(new) - 1]
        pairs = spanning(who[who != met], met[who != met])
        out.append(_table(kind=1, a=pairs[:, 0], b=pairs[:, 1]))
        keys = tokens[new]
        order, shards, at = by_shard(keys, n_shards)
        keys, low = keys[order], low[order]
        cuts = list(zip(at[:-1], at[1:]))
        out.append(_table(kind=2, shard=shards, chunk=np.full(len(shards), table.column("_chunk")[0].as_py()), keys=[keys[x:y].tobytes() for x, y in cuts],
                          low=[low[x:y].tobytes() for x, y in cuts]))
        return pa.Table.from_batches(out)

    chunks = dealt.groupBy("_chunk")
    lengths = chunks.applyInArrow(ask, LISTS).groupBy("shard").applyInArrow(_lengths, LENGTHS)
    return chunks.cogroup(lengths.groupBy("chunk")).applyInArrow(meet, SURVEYED)


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs that join the same documents as the pairs (a, b), at most one a document.

    Documents that share many tokens meet once and not once a token.
    """
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(ids))
    x, y = ends[:len(a)], ends[len(a):]
    while len(x):  # smaller roots spread along the pairs, then along the roots
        before = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        np.minimum.at(root, before, root)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    joined = np.nonzero(root != np.arange(len(ids)))[0]
    return np.stack([ids[joined], ids[root[joined]]], axis=1) if len(ids) else np.zeros((0, 2), dtype=np.int64)


LEAST = "chunk long, shard long, least binary"


def _least(requests: pa.Table) -> pa.Table:
    """One shard: for each chunk's tokens the smallest document that they lead to within the shard.

    That is the root of all documents which the shard's tokens join, and not only of those with the same token, so the
    chunks of a large group hear of one document and not of one a token.
    """
    blobs = requests.column("keys").to_pylist()
    at = offsets_of(np.array([len(b) // 8 for b in blobs], dtype=np.int64))
    _, group = np.unique(np.frombuffer(b"".join(blobs), dtype=np.uint64), return_inverse=True)
    low = np.frombuffer(b"".join(requests.column("low").to_pylist()), dtype=np.int64)
    least = np.full(int(group.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, low)
    least = least[group]
    other = low != least
    joined = spanning(low[other], least[other])
    if len(joined):
        place = np.minimum(np.searchsorted(joined[:, 0], least), len(joined) - 1)
        least = np.where(joined[place, 0] == least, joined[place, 1], least)
    return pa.table({"chunk": requests.column("chunk"), "shard": requests.column("shard"),
                     "least": pa.array([least[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())})


def _meetings(sent: pa.Table, answers: pa.Table) -> pa.Table:
    """One chunk: its documents' meetings with smaller ones of other chunks.

    A spanning forest over all shards' answers, so that the number of shards does not multiply it.
    """
    got = dict(zip(answers.column("shard").to_pylist(), answers.column("least").to_pylist()))
    least = np.frombuffer(b"".join(got[s] for s in sent.column("shard").to_pylist()), dtype=np.int64)
    low = np.frombuffer(b"".join(sent.column("low").to_pylist()), dtype=np.int64)
    other = low != least
    pairs = spanning(low[other], least[other])
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


def linked(overlap: np.ndarray, one: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    return 100 * overlap >= percent * (one + other - overlap)


def divide_skip(sets: ShingleSets, queries: np.ndarray, percent: int):
    """Links of each query set to sets of the table: yields (query, linked sets).

    Lists hold set numbers in order.  A set linked to a query of size n shares at least percent * n shingles.
    """
    order = np.argsort(sets.hashes, kind="stable")
    shingles, first = np.unique(sets.hashes[order], return_index=True)
    members = sets.doc_of[order]
    ends = np.append(first[1:], len(members)) if len(first) else first
    list_of = np.searchsorted(shingles, sets.hashes)
    for q in queries:
        lists = list_of[sets.ends[q]:sets.ends[q + 1]]
        n = len(lists)
        if not n:
            continue
        need = -(-percent * n // 100)
        length = ends[lists] - first[lists]
        by_length = np.argsort(length, kind="stable")
        longest = int(length[by_length[-1]])
        n_long = min(int(need / (MERGE_COST * np.log2(longest + 1) + 1)), need - 1)
        short, long_ = lists[by_length[:n - n_long]], lists[by_length[n - n_long:]]
        merged = members[ranges(first[short], ends[short] - first[short])]
        seen = np.bincount(merged, minlength=len(sets))
        found = np.nonzero(seen >= need - n_long)[0]
        found = found[(found != q) & (sets.sizes[found] * percent <= 100 * n) & (sets.sizes[found] * 100 >= percent * n)]
        count = seen[found]
        for k, one in enumerate(long_):  # binary probes, dropping what can no longer reach T
            if not len(found):
                break
            held = members[first[one]:ends[one]]
            at = np.minimum(np.searchsorted(held, found), len(held) - 1)
            count = count + (held[at] == found)
            if k % 16 == 15:
                going = count + (n_long - k - 1) >= need
                found, count = found[going], count[going]
        yield q, found[linked(count, n, sets.sizes[found], percent)]


def overlaps_with(sets: ShingleSets, q: int) -> np.ndarray:
    """Common shingles of one set with every set."""
    own = sets.hashes[sets.ends[q]:sets.ends[q + 1]]
    if not len(own):
        return np.zeros(len(sets), dtype=np.int64)
    at = np.minimum(np.searchsorted(own, sets.hashes), len(own) - 1)
    return np.bincount(sets.doc_of, weights=own[at] == sets.hashes, minlength=len(sets)).astype(np.int64)


def _edges(a, b) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _search(ids: np.ndarray, sets: ShingleSets, percent: int) -> tuple[list, list]:
    """Links that hold a block together.

    Sets linked to the pivot are one component, and links among them add nothing; all others are searched
    against all.
    """
    pivot = int(np.argmin(ids))
    near = linked(overlaps_with(sets, pivot), int(sets.sizes[pivot]), sets.sizes, percent) & (sets.sizes > 0)
    near[pivot] = True
    a, b = list(ids[near]), [ids[pivot]] * int(near.sum())
    for q, found in divide_skip(sets, np.nonzero(~near)[0], percent):
        a += [ids[q]] * len(found)
        b += list(ids[found])
    return a, b


def jaccard_components(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE,
                       task_bytes: int = TASK_BYTES, task_sets: int = TASK_SETS) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_shingles, component_id)``, one row per row of ``docs``.

    Two documents link when 100 * intersection >= percent * union of their shingle sets;
    ``component_id`` is the smallest doc_id reachable by links.  A-Z is lower-cased, words are runs free
    of ASCII white space; fewer words than ``shingle`` are one shingle; a text without words or a null one has
    none and links with nothing.  Rows that share a doc_id are one node.  A null doc_id links with nothing
    and has a null component.  Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = max(shuffle_partitions(spark), -(-total // SHARD_BYTES))
    n_chunks = max(shuffle_partitions(spark), -(-total // CHUNK_BYTES))
    found = written(survey(docs, n_chunks, n_shards, shingle, percent), "survey")
    sets = found.where("kind = 0").select("doc_id", "n_shingles", "n_bytes", "set_a", "set_b")

    # Equal sets are one class with its smallest document.
    nodes = sets.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = nodes.groupBy("set_a", "set_b", "n_shingles").agg(
        F.min("doc_id").alias("rep"), F.max("n_bytes").alias("n_bytes"))
    copies = nodes.join(classes.select("set_a", "set_b", "n_shingles", "rep"), ["set_a", "set_b", "n_shingles"]).where(
        "doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    copies = written(copies, "copies")

    within = found.where("kind = 1").select("a", "b")
    sent = found.where("kind = 2")
    # Tokens are far fewer than shingles: several shards go together, and so join more of what belongs together.
    n_meets = max(MEETS, -(-total // (8 * SHARD_BYTES)))
    answers = sent.select("chunk", "shard", "keys", "low", F.pmod("shard", F.lit(n_meets)).alias("_meet")).groupBy(
        "_meet").applyInArrow(lambda table: _least(table), LEAST)
    across = sent.select("chunk", "shard", "low").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _meetings, "a long, b long")
    blocks = components(within.unionByName(across).unionByName(copies), "blocks")

    # Representatives by block; blocks with a single one need no search.
    reps = blocks.join(classes.groupBy(F.col("rep").alias("id")).agg(F.max("n_bytes").alias("n_bytes")), "id")
    shape = reps.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("bytes"),
                                     F.min("id").alias("pivot")).where("n > 1")
    parts = F.greatest(F.ceil(F.col("bytes") / task_bytes), F.ceil(F.col("n") / task_sets))
    searched = written(reps.join(shape, "root").select(F.col("id").alias("doc_id"), "root", parts.cast("long").alias("parts"),
                                                       "pivot", F.col("n_bytes").alias("size")), "searched")
    row = searched.agg(F.sum(F.when(F.col("parts") == 1, F.col("size"))).alias("small"), F.max("parts").alias("most")).first()
    rooms = max(shuffle_partitions(spark), -(-(row["small"] or 0) // task_bytes))
    texts = docs.join(searched.select("doc_id", "root", "parts", "pivot"), "doc_id")

    def search_room(table: pa.Table) -> pa.Table:
        roots, all_ids = table.column("root").to_numpy(), table.column("doc_id").to_numpy()
        order = np.argsort(roots, kind="stable")
        cuts = np.append(np.unique(roots[order], return_index=True)[1], len(order))
        a, b = [], []
        for x, y in zip(cuts[:-1], cuts[1:]):
            some = order[x:y]
            more = _search(all_ids[some], ShingleSets(table.column("text").take(pa.array(some)).combine_chunks(), shingle),
                           percent)
            a += more[0]
            b += more[1]
        return _edges(a, b)

    links = texts.where("parts = 1").withColumn("_room", F.pmod(F.xxhash64("root"), F.lit(rooms))).groupBy(
        "_room").applyInArrow(search_room, "a long, b long")
    if (row["most"] or 0) > 1:
        links = links.unionByName(_large_blocks(texts.where("parts > 1"), shingle, percent, task_bytes, task_sets))
    joined = components(links.unionByName(copies), "linked")
    return sets.select("doc_id", "n_shingles").join(joined, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def _large_blocks(texts: DataFrame, shingle: int, percent: int, task_bytes: int, task_sets: int) -> DataFrame:
    """Links of blocks that are cut into parts: against the pivot first, the rest against every part."""
    texts = written(texts.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.col("parts"))), "large")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    pivots = texts.where("doc_id = pivot").withColumn("_part", every)

    def against_pivot(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_numpy()
        sets = ShingleSets(table.column("text").combine_chunks(), shingle)
        pivot = int(np.nonzero(table.column("is_pivot").to_numpy(zero_copy_only=False))[0][0])
        near = linked(overlaps_with(sets, pivot), int(sets.sizes[pivot]), sets.sizes, percent)
        near[pivot] = True
        return pa.table({"doc_id": pa.array(ids), "near": pa.array(near)})

    first = written(texts.withColumn("is_pivot", F.lit(False)).where("doc_id <> pivot").unionByName(
        pivots.withColumn("is_pivot", F.lit(True))).groupBy("root", "_part").applyInArrow(
            against_pivot, "doc_id long, near boolean"), "pivots")
    near = first.where("near").join(texts.select("doc_id", "pivot"), "doc_id").select(
        F.col("doc_id").alias("a"), F.col("pivot").alias("b"))
    rest = texts.join(first.where("NOT near").select("doc_id").distinct(), "doc_id")
    sizes = rest.groupBy("root").agg(F.greatest(F.ceil(F.sum(F.octet_length("text")) / task_bytes),
                                                F.ceil(F.count(F.lit(1)) / task_sets)).cast("long").alias("askers"))
    all_askers = F.explode(F.sequence(F.lit(0).cast("long"), F.col("askers") - 1))
    # Salted: after a plain join on the block, Spark would keep a whole block in one task.
    asking = salted_join(rest, sizes, "root", "doc_id").select(
        "root", "doc_id", "text", F.lit(True).alias("asks"),
        F.pmod(F.xxhash64("doc_id", F.lit("asks")), F.col("askers")).alias("_asker"), every.alias("_part"))
    asked = salted_join(texts, sizes, "root", "doc_id").select("root", "doc_id", "text", F.lit(False).alias("asks"), "_part",
                                             all_askers.alias("_asker"))

    def search_part(table: pa.Table) -> pa.Table:
        ids, asks = table.column("doc_id").to_numpy(), table.column("asks").to_numpy(zero_copy_only=False)
        sets = ShingleSets(table.column("text").combine_chunks(), shingle)
        a, b = [], []
        for q, found in divide_skip(sets, np.nonzero(asks)[0], percent):
            a += [ids[q]] * len(found)
            b += list(ids[found])
        return _edges(a, b)

    searched = asking.unionByName(asked).groupBy("root", "_asker", "_part").applyInArrow(search_part, "a long, b long")
    return near.unionByName(searched)
