"""Nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample and sent to all tasks; every row is filed under one leaf. A query walks the tree through a priority
queue: the node whose centre is nearest is opened next, and leaves come up in that order. The number of leaves that a query visits is
calibrated: some queries are compared with all rows, and the visits are widened until their recall reaches the target.

Rows of equal vector are represented by those of the smallest ids, one more than neighbours are asked for; others cannot be among the nearest.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeweave.llm.common import materialize

#: Bounds: rows that the tree is fitted on, children of a node, leaves, queries of the calibration.
SAMPLE = 40_000
BRANCHES = 8
LEAVES = 4_096
CALIBRATION = 64
#: Rows that a leaf should hold, and rows and queries that meet in one task.
LEAF_ROWS = 512
BLOCK_ROWS = 4_096
BLOCK_QUERIES = 1_024


class Tree:
    """Centres of all nodes, the root first; children of a node stand together."""

    def __init__(self, sample: np.ndarray, leaf_rows: int, leaves: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.centres = [sample.mean(axis=0)]
        self.children: list[list[int]] = [[]]
        queue = [(-len(sample), 0, np.arange(len(sample)))]
        n_leaves = 1
        while queue and n_leaves + BRANCHES - 1 <= leaves:
            size, node, rows = heapq.heappop(queue)
            if -size <= leaf_rows:
                break
            centres, label = _means(sample[rows], min(BRANCHES, len(rows)), rng)
            used = np.unique(label)
            if len(used) < 2:
                continue
            n_leaves += len(used) - 1
            for c in used.tolist():
                self.centres.append(centres[c])
                self.children.append([])
                child = len(self.centres) - 1
                self.children[node].append(child)
                own = rows[label == c]
                heapq.heappush(queue, (-len(own), child, own))
        self.table = np.array(self.centres)
        self.leaf_number = {node: k for k, node in enumerate(n for n, c in enumerate(self.children) if not c)}

    def file(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf that a row belongs to: the nearest child at each level."""
        at = np.zeros(len(vectors), dtype=np.int64)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                at[rows] = self.leaf_number[node]
                continue
            own = np.array(self.children[node])
            best = _squares(vectors[rows], self.table[own]).argmin(axis=1)
            todo += [(int(own[c]), rows[best == c]) for c in np.unique(best)]
        return at

    def visits(self, query: np.ndarray, sizes: np.ndarray, leaves: int, rows: int) -> list[int]:
        """Leaves in best-bin-first order: at least ``leaves`` of them, and more until they hold ``rows`` rows."""
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < leaves or held < rows):
            _, node = heapq.heappop(queue)
            own = self.children[node]
            if not own:
                leaf = self.leaf_number[node]
                out.append(leaf)
                held += int(sizes[leaf])
                continue
            for d, child in zip(((self.table[own] - query) ** 2).sum(axis=1).tolist(), own, strict=True):
                heapq.heappush(queue, (d, child))
        return out


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, up to rounding."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0)


def _means(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = rows[rng.choice(len(rows), k, replace=False)]
    label = np.zeros(len(rows), dtype=np.int64)
    for _ in range(rounds):
        label = _squares(rows, centres).argmin(axis=1)
        for c in range(k):
            own = rows[label == c]
            if len(own):
                centres[c] = own.mean(axis=0)
    return centres, label


def nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int):
    """For each query: the ``k`` nearest rows but its own, with exact distances; equal distances go to the smaller id."""
    for a in range(0, len(queries), 256):
        q, own = queries[a : a + 256], query_ids[a : a + 256]
        square = _squares(q, rows)
        square[own[:, None] == row_ids[None, :]] = np.inf
        if len(rows) > k:
            edge = np.partition(square, k - 1, axis=1)[:, k - 1]
        else:
            edge = np.full(len(q), np.inf)
        scale = (q * q).sum(axis=1) + (rows * rows).sum(axis=1).max(initial=0)
        for i in range(len(q)):
            near = np.flatnonzero((square[i] <= edge[i] + 1e-9 * scale[i]) & (square[i] < np.inf))
            exact = np.sqrt(((rows[near] - q[i]) ** 2).sum(axis=1))
            order = np.lexsort((row_ids[near], exact))[:k]
            yield int(own[i]), row_ids[near[order]], exact[order]


def sound_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id`` and ``vector`` (doubles) of the rows that can take part: a known id, no null or non-finite component, not zero, and the most frequent length."""
    vector = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    known = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vector.alias("vector")).where("vec_id is not null and vector is not null")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sound = known.where(finite & F.exists("vector", lambda x: x != 0))
    lengths = sound.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return sound.where(F.size("vector") == (lengths[0]["n"] if lengths else 0)).distinct()


def _matrix(column) -> np.ndarray:
    values = column.flatten() if isinstance(column, pa.ListArray) else pa.concat_arrays(column.chunks).flatten()
    return values.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def neighbours(rows: DataFrame, every: int = 100, k: int = 10, recall: float = 0.97, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest rows found for each query, the rows whose id is divisible by ``every``.

    ``score`` is the Euclidean distance in doubles. A query has fewer rows only if there are fewer candidates. Repeated rows count once. An empty
    table gives no row.
    """
    spark = rows.sparkSession
    sound = materialize(sound_vectors(rows, id_col, vector_col), "vectors")
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    # A copy beyond the first k + 1 of its vector is further down than k others for any query.
    few = F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))
    candidates = materialize(sound.withColumn("copy", few).where(F.col("copy") <= k + 1).drop("copy"), "candidates")
    count = candidates.count()
    # Only rows with small hashes, about twice as many as are wanted, are put in order. Rows are distinct, and so are nearly all their hashes.
    place = F.xxhash64("vec_id", "vector")
    small = candidates.where(place <= -(2.0**63) + 2.0**64 * min(1.0, 2 * SAMPLE / max(1, count)))
    sample = small.orderBy(place, "vec_id").limit(SAMPLE).select("vector").toPandas()["vector"]
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    matrix = np.array(sample.tolist())
    leaves = max(1, min(LEAVES, count // LEAF_ROWS, len(matrix) // 4))
    tree = Tree(matrix, max(1, len(matrix) // leaves), leaves)
    sent = spark.sparkContext.broadcast(tree)

    def file(batches):
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.file(_matrix(batch.column(1))))], names=["vec_id", "vector", "leaf"])

    filed = candidates.mapInArrow(file, "vec_id long, vector array<double>, leaf long").withColumn("deal", F.xxhash64("vec_id"))
    filed = materialize(filed, "filed")
    held = filed.groupBy("leaf").count().collect()
    sizes = np.zeros(len(tree.leaf_number), dtype=np.int64)
    for r in held:
        sizes[r["leaf"]] = r["count"]
    queries = sound.where(is_query)
    visits = calibrated(queries, filed, tree, sizes, k, recall)

    def walk(batches):
        for batch in batches:
            if not len(batch):
                continue
            ids, vectors = batch.column(0).to_pylist(), _matrix(batch.column(1))
            paths = [sent.value.visits(v, sizes, visits, k + 1) for v in vectors]
            take = np.repeat(np.arange(len(ids)), [len(p) for p in paths])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take)), batch.column(1).take(pa.array(take)), pa.array(np.concatenate(paths).astype(np.int64))], names=["query_id", "query", "leaf"])

    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query")).repartition(F.xxhash64("query_id")).mapInArrow(walk, "query_id long, query array<double>, leaf long")
    asked = materialize(asked, "asked")
    n_rows = F.ceil(F.col("n_rows") / BLOCK_ROWS)
    n_queries = F.ceil(F.col("n_queries") / BLOCK_QUERIES)
    grid = filed.groupBy("leaf").agg(F.count("*").alias("n_rows")).join(asked.groupBy("leaf").agg(F.count("*").alias("n_queries")), "leaf").select("leaf", n_rows.alias("rb"), n_queries.alias("qb"))
    left = asked.join(grid, "leaf").withColumn("qblock", F.pmod(F.xxhash64("query_id"), "qb")).withColumn("rblock", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rb") - 1)))
    right = filed.join(grid, "leaf").withColumn("rblock", F.pmod("deal", "rb")).withColumn("qblock", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qb") - 1)))

    def meet(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        found = list(nearest(np.stack(asked["query"].to_list()), asked["query_id"].to_numpy(), np.stack(rows["vector"].to_list()), rows["vec_id"].to_numpy(), k))
        return pd.DataFrame({"query_id": np.repeat([f[0] for f in found], [len(f[1]) for f in found]), "vec_id": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found])})

    keys = ["leaf", "rblock", "qblock"]
    found = left.select(*keys, "query_id", "query").groupBy(*keys).cogroup(right.select(*keys, "vec_id", "vector").groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")
    return _top(found, k)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_neighbours(asked: list[tuple[int, list[float]]], rows: DataFrame, k: int) -> DataFrame:
    """The true nearest rows of a few queries, which are sent to all rows: ``query_id, vec_id, score, leaf, rank``."""
    ids, vectors = np.array([a[0] for a in asked], dtype=np.int64), np.array([a[1] for a in asked])

    def compare(batches):
        for batch in batches:
            if not len(batch):
                continue
            own, leaf = batch.column(0).to_numpy(), dict(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
            for query, found, score in nearest(vectors, ids, _matrix(batch.column(1)), own, k):
                yield pa.RecordBatch.from_pydict({"query_id": pa.array([query] * len(found), pa.int64()), "vec_id": pa.array(found), "score": pa.array(score), "leaf": pa.array([leaf[f] for f in found.tolist()], pa.int64())})

    found = rows.select("vec_id", "vector", "leaf").mapInArrow(compare, "query_id long, vec_id long, score double, leaf long")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def calibrated(queries: DataFrame, filed: DataFrame, tree: Tree, sizes: np.ndarray, k: int, recall: float) -> int:
    """Leaves to visit: the fewest with which the calibration queries find ``recall`` of their true neighbours."""
    asked = [(r["vec_id"], r["vector"]) for r in queries.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(CALIBRATION).collect()]
    if not asked:
        return 1
    order = {q: {leaf: i for i, leaf in enumerate(tree.visits(np.array(v), sizes, len(sizes), 0))} for q, v in asked}
    needed = sorted(order[r["query_id"]][r["leaf"]] + 1 for r in exact_neighbours(asked, filed, k).select("query_id", "leaf").collect())
    return needed[max(0, int(np.ceil(recall * len(needed))) - 1)] if needed else 1
