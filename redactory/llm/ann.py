"""Approximate nearest neighbours by inner product: a random-projection forest, one shared queue, exact reranking.

Trees are fitted on the driver to a bounded sample and every vector is indexed by all of them.
Inner product becomes distance by one more coordinate, sqrt(M^2 - |x|^2) for indexed vectors and 0 for queries.  A
query walks all trees through one priority queue of unexplored branches, nearest margin first, until the
leaves it has opened hold ``share`` times as many entries as there are vectors.  Leaves are dealt to shards; a shard
multiplies a block of queries with the leaves each has opened, in double precision.

Equal vectors are one class all along: a class is searched once, and only its smallest ids can be in a result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..plans.shared import written
from .common import mix

K = 20
TREES = 4
LEAF = 200             # vectors a leaf should hold
DEEPEST = 12           # levels of a tree; leaves grow beyond that and are cut into parts
SAMPLE = 16_384        # vectors the trees are fitted to
SHARE = 1.3            # entries opened per query, as a multiple of the number of vectors
PART = 4096            # entries of a leaf in one part
SHARD_ENTRIES = 16_384
QUERY_BLOCK = 4096


class Forest:
    """Hyperplanes of complete binary trees in heap order: ``normals[tree, node]`` and ``cuts[tree, node]``."""

    def __init__(self, normals: np.ndarray, cuts: np.ndarray, depth: int):
        self.normals, self.cuts, self.depth = normals, cuts, depth

    @classmethod
    def fit(cls, sample: np.ndarray, depth: int, trees: int, seed: int) -> Forest:
        """Each node is split at the median along the line between two centres found from two random vectors."""
        rng = np.random.default_rng(seed)
        inner = 2**depth - 1
        normals = np.zeros((trees, inner, sample.shape[1]))
        cuts = np.zeros((trees, inner))
        for t in range(trees):
            held = {0: np.arange(len(sample))}
            for node in range(inner):
                rows = sample[held[node]]
                v = rng.normal(size=sample.shape[1])
                if len(rows) > 2:
                    a, b = rows[rng.choice(len(rows), 2, replace=False)]
                    for _ in range(3):
                        side = rows @ (a - b) > (a @ a - b @ b) / 2
                        if side.all() or not side.any():
                            break
                        a, b = rows[side].mean(axis=0), rows[~side].mean(axis=0)
                    v = a - b if np.any(a != b) else v
                v = v / np.linalg.norm(v)
                along = rows @ v
                normals[t, node], cuts[t, node] = v, np.median(along) if len(rows) else 0.0
                right = along > cuts[t, node]
                held[2 * node + 1], held[2 * node + 2] = held[node][~right], held.pop(node)[right]
        return cls(normals, cuts, depth)

    def leaves(self, vectors: np.ndarray, tree: int) -> np.ndarray:
        node = np.zeros(len(vectors), dtype=np.int64)
        for _ in range(self.depth):
            right = np.einsum("ij,ij->i", vectors, self.normals[tree, node]) > self.cuts[tree, node]
            node = 2 * node + 1 + right
        return node - (2**self.depth - 1)

    def opened(self, query: np.ndarray, sizes: np.ndarray, budget: float) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of one queue over all trees, until their sizes reach the budget."""
        inner, trees = 2**self.depth - 1, len(self.normals)
        margins = self.normals @ query - self.cuts
        queue = [(-np.inf, t, 0) for t in range(trees)]
        out, held = [], 0.0
        while queue and held < budget:
            far, t, node = heapq.heappop(queue)
            while node < inner:
                m = margins[t, node]
                near_child, other = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (max(far, abs(m)), t, other))
                node = near_child
            out.append((t, node - inner))
            held += sizes[t, node - inner]
        return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, v array<double>)`` without null ids and without null, zero, or non-finite vectors.

    Of vectors with several lengths only those of the commonest one (ties: the shortest) can be
    compared; the others are left out.
    """
    v = F.col(vector_col).cast("array<double>")
    sound = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        "vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 "
        "AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(v, x -> x <> 0)")
    common = sound.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return sound.where(F.size("v") == (common["n"] if common else 0))


def nearest(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
            trees: int = TREES, leaf: int = LEAF, share: float = SHARE, seed: int = 11) -> DataFrame:
    """The ``k`` nearest found of every query row: ``(query_id, rank, vec_id, score)``.

    ``is_query`` is a condition on ``vec_id``.  Candidates are all rows but those with the query's own id;
    scores are inner products in double precision, ties go to the smaller id.  Repeated rows count
    once.  Rows whose vector takes no part (see ``usable_vectors``) are neither queries nor candidates.
    Fewer candidates than ``k`` are all returned, as far as they are found; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    sound = usable_vectors(vectors, id_col, vector_col)
    keyed = sound.select("vec_id", "v", F.xxhash64("v").alias("ka"), F.xxhash64("v", F.lit(1)).alias("kb"))
    of_class = W.partitionBy("ka", "kb").orderBy("vec_id")
    # Only the k + 1 smallest ids of a class can be among k results; the limit is applied before the shuffle too.
    members = written(keyed.dropDuplicates(["vec_id", "ka", "kb"]).withColumn("rn", F.row_number().over(of_class))
                      .where(F.col("rn") <= k + 1).select("vec_id", "ka", "kb", "rn", F.when(F.col("rn") == 1, F.col("v")).alias("v")),
                      "members")
    classes = members.where("rn = 1").select(F.col("vec_id").alias("class_id"), "ka", "kb", "v")
    asking = written(keyed.where(is_query).select(F.col("vec_id").alias("query_id"), "ka", "kb").distinct().join(
        classes.select("class_id", "ka", "kb"), ["ka", "kb"]).select("query_id", "class_id"), "asking")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    shape = classes.agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("m"), F.max(F.size("v")).alias("width")).first()
    n, width, biggest = shape["n"], shape["width"] or 1, shape["m"] or 0.0
    queries = asking.select("class_id").distinct().join(classes, "class_id").select("class_id", "v")

    # About SAMPLE classes, chosen by their hash.
    chance = min(1.0, 0.9 * SAMPLE / max(n, 1))
    picked = classes.where(F.pmod("ka", F.lit(1 << 20)) < F.lit(int(chance * (1 << 20)))).select("v").limit(SAMPLE)
    sample = np.array([r["v"] for r in picked.collect()], dtype=np.float64).reshape(-1, width)
    depth = int(max(0, min(DEEPEST, np.ceil(np.log2(max(n, 1) / leaf)))))
    forest = Forest.fit(_raised(sample, biggest), depth, trees, seed)
    shared = spark.sparkContext.broadcast(forest)  # at most trees * 2^DEEPEST hyperplanes

    def index(batches):
        for b in batches:
            x = _raised(_matrix(b.column("v"), width), biggest)
            for t in range(trees):
                yield pa.RecordBatch.from_arrays([b.column("class_id"), b.column("v"),
                                                  pa.array(t * 2**depth + shared.value.leaves(x, t))],
                                                 names=["class_id", "v", "leaf"])

    indexed = written(classes.select("class_id", "v").mapInArrow(index, "class_id long, v array<double>, leaf long"), "index")
    sizes = np.zeros(trees * 2**depth)
    for r in indexed.groupBy("leaf").count().collect():  # one row a leaf
        sizes[r["leaf"]] = r["count"]
    parts = np.maximum(1, np.ceil(sizes / PART)).astype(np.int64)
    n_shards = int(max(1, -(-(n * trees) // SHARD_ENTRIES)))  # each gives up to k + 1 rows a query
    n_blocks = max(1, -(-asking.select("class_id").distinct().count() // QUERY_BLOCK))

    def shard_of(leaf: np.ndarray, part: np.ndarray) -> np.ndarray:
        return (mix(leaf.astype(np.uint64) * np.uint64(65_537) + part.astype(np.uint64)) % np.uint64(n_shards)).astype(np.int64)

    def dealt(batches):
        for b in batches:
            leaf_of = b.column("leaf").to_numpy()
            part = (mix(b.column("class_id").to_numpy().astype(np.uint64)) % parts[leaf_of].astype(np.uint64)).astype(np.int64)
            for block in range(n_blocks):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard_of(leaf_of, part)), pa.array(np.full(len(part), block)), b.column("class_id"),
                     b.column("v"), pa.array(leaf_of)], names=["shard", "block", "class_id", "v", "leaf"])

    def routed(batches):
        """Every query once per shard, with the leaves it has opened there."""
        by_tree = sizes.reshape(trees, -1)
        for b in batches:
            x = _matrix(b.column("v"), width)
            shards, rows, lists = [], [], []
            for i, q in enumerate(x):
                norm = np.linalg.norm(q)
                open_ = shared.value.opened(np.append(q / norm * np.sqrt(biggest), 0.0), by_tree, share * n)
                leaf_of = np.array([t * 2**depth + one for t, one in open_], dtype=np.int64)
                leaf_of = np.repeat(leaf_of, parts[leaf_of])
                first = np.append(True, leaf_of[1:] != leaf_of[:-1])
                at = np.nonzero(first)[0]
                part = np.arange(len(leaf_of)) - at[np.cumsum(first) - 1]
                shard = shard_of(leaf_of, part)
                for s in np.unique(shard):
                    shards.append(s)
                    rows.append(i)
                    lists.append(np.unique(leaf_of[shard == s]))
            block = mix(b.column("class_id").to_numpy().astype(np.uint64) + np.uint64(1)) % np.uint64(n_blocks)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(shards, pa.int64()), pa.array(block.astype(np.int64)).take(take), b.column("class_id").take(take),
                 b.column("v").take(take), pa.array(lists, pa.list_(pa.int64()))],
                names=["shard", "block", "class_id", "v", "leaves"])

    def rank_shard(held: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if held.num_rows and asked.num_rows:
            x = _matrix(held.column("v").combine_chunks(), width)
            ids, leaf_of = held.column("class_id").to_numpy(), held.column("leaf").to_numpy()
            q = _matrix(asked.column("v").combine_chunks(), width)
            q_ids = asked.column("class_id").to_numpy()
            lists = asked.column("leaves").combine_chunks()
            of_query = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
            wanted = lists.flatten().to_numpy()
            order = np.argsort(leaf_of, kind="stable")
            by_leaf = np.argsort(wanted, kind="stable")
            for one in np.unique(leaf_of):
                rows = order[np.searchsorted(leaf_of[order], one):np.searchsorted(leaf_of[order], one, "right")]
                who = of_query[by_leaf[np.searchsorted(wanted[by_leaf], one):np.searchsorted(wanted[by_leaf], one, "right")]]
                if not len(who):
                    continue
                rows = rows[np.argsort(ids[rows])]
                score = q[who] @ x[rows].T
                best = np.argsort(-score, axis=1, kind="stable")[:, :k + 2] if len(rows) > k + 2 else \
                    np.broadcast_to(np.arange(len(rows)), (len(who), len(rows)))
                pick = rows[best].ravel()
                asker = np.repeat(who, best.shape[1])
                found.append((asker, ids[pick], np.einsum("ij,ij->i", q[asker], x[pick])))
        if not found:
            none = np.zeros(0, dtype=np.int64)
            return pa.table({"query": pa.array(none), "class_id": pa.array(none), "score": pa.array(none.astype(float))})
        asker, got, score = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((got, -score, asker))
        asker, got, score = asker[order], got[order], score[order]
        # A vector found through several trees has the same score each time.
        fresh = np.append(True, (asker[1:] != asker[:-1]) | (got[1:] != got[:-1]) | (score[1:] != score[:-1]))
        asker, got, score = asker[fresh], got[fresh], score[fresh]
        place = np.arange(len(asker)) - np.searchsorted(asker, asker)
        top = place <= k
        return pa.table({"query": pa.array(q_ids[asker[top]]), "class_id": pa.array(got[top]), "score": pa.array(score[top])})

    entries = indexed.mapInArrow(dealt, "shard long, block long, class_id long, v array<double>, leaf long")
    askers = queries.mapInArrow(routed, "shard long, block long, class_id long, v array<double>, leaves array<long>")
    ranked = entries.groupBy("shard", "block").cogroup(askers.groupBy("shard", "block")).applyInArrow(
        rank_shard, "query long, class_id long, score double")
    best = W.partitionBy("query").orderBy(F.desc("score"), "class_id")
    top = ranked.distinct().withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k + 1)
    ids = members.join(classes.select(F.col("class_id"), F.col("ka").alias("ca"), F.col("kb").alias("cb")),
                       F.expr("ka = ca AND kb = cb")).select("class_id", "vec_id")
    by_score = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = top.join(ids, "class_id").withColumn("rn", F.row_number().over(by_score)).where(F.col("rn") <= k + 1).groupBy(
        "query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("list"))
    own = F.expr(f"slice(filter(list, x -> x.vec_id <> query_id), 1, {int(k)})")
    return asking.join(lists, F.col("class_id") == F.col("query")).select("query_id", F.posexplode(own)).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"),
        (-F.col("col.s")).alias("score"))


def _raised(x: np.ndarray, biggest: float) -> np.ndarray:
    """Vectors with the coordinate that turns inner product into distance."""
    rest = np.sqrt(np.maximum(0.0, biggest - np.einsum("ij,ij->i", x, x)))
    return np.concatenate([x, rest[:, None]], axis=1)
