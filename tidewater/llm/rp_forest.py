"""Operator 9: nearest neighbours from a forest of random-projection trees, reranked exactly.

Index. Trees are fitted on a bounded sample (``SAMPLE`` vectors, by the hash of vec_id): a node splits its
part of the sample at the median of the projection on the difference of two of its vectors. Every vector is
then put in one leaf of every tree. Leaves are cut into chunks of at most ``CHUNK`` vectors.

Search. For a query, the nodes of all trees stand in one priority queue, by the smallest margin by which the
query missed a split on the way; leaves are taken from it until they hold ``share`` of all vectors (at least
``LEAST``) or none are left. Queries meet the chunks of their leaves by a shuffle on (tree, leaf, chunk);
each chunk gives its k nearest by exact distance in double precision; the best k of all are the result.

The forest and the leaf sizes are bounded by the sample and are broadcast. Queries of a leaf are cut into
chunks too, so no task holds more than ``CHUNK`` vectors and ``CHUNK`` queries of a leaf.

On vectors without structure (64 independent dimensions, as in the test tables) the candidates that a recall of 0.9
takes grow almost as the table does; ``share`` is chosen for them. Clustered vectors need far fewer.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with null
ids, take no part; so do vectors whose length is not the most common one of the sample. Equal distances go to
the smaller vec_id; rows equal in id and vector count once; with fewer than k candidates all are returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SAMPLE, LEAF, CHUNK, LEAST = 20_000, 64, 2048, 1000


class Forest:
    """Trees as arrays. children: node numbers, or -1 - leaf number."""

    def __init__(self, trees: list[tuple]) -> None:
        self.trees = trees

    @classmethod
    def fit(cls, sample: np.ndarray, trees: int, seed: int = 11) -> Forest:
        rng = np.random.default_rng(seed)
        return cls([cls.grow(sample, rng) for _ in range(trees)])

    @staticmethod
    def grow(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        normals, cuts, children, leaves = [], [], [], 0

        def make(rows: np.ndarray) -> int:
            nonlocal leaves
            if len(rows) > LEAF:
                for _ in range(5):
                    i, j = rng.choice(rows, 2, replace=False)
                    normal = x[i] - x[j]
                    size = np.linalg.norm(normal)
                    if size > 0:
                        along = x[rows] @ (normal / size)
                        cut = float(np.median(along))
                        right = along > cut
                        if 0 < right.sum() < len(rows):
                            at = len(normals)
                            normals.append(normal / size)
                            cuts.append(cut)
                            children.append([0, 0])
                            children[at] = [make(rows[~right]), make(rows[right])]
                            return at
            leaves += 1
            return -leaves

        root = make(np.arange(len(x)))
        dims = x.shape[1] if x.ndim == 2 else 0
        return np.array(normals).reshape(-1, dims), np.array(cuts), np.array(children, np.int64).reshape(-1, 2), root

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf number of every vector in every tree."""
        out = np.empty((len(x), len(self.trees)), np.int64)
        for t, (normals, cuts, children, root) in enumerate(self.trees):
            node = np.full(len(x), root)
            while len(at := np.flatnonzero(node >= 0)):
                n = node[at]
                right = np.einsum("ij,ij->i", x[at], normals[n]) > cuts[n]
                node[at] = children[n, right.astype(int)]
            out[:, t] = -1 - node
        return out

    def visit(self, q: np.ndarray, sizes: dict[tuple[int, int], int], enough: int) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue until they hold enough vectors."""
        margins = [normals @ q - cuts for normals, cuts, _, _ in self.trees]
        queue = [(-np.inf, t, root) for t, (_, _, _, root) in enumerate(self.trees)]
        heapq.heapify(queue)
        out, held = [], 0
        while queue and held < enough:
            miss, t, node = heapq.heappop(queue)
            children = self.trees[t][2]
            while node >= 0:
                m = margins[t][node]
                near = int(m > 0)
                heapq.heappush(queue, (max(miss, abs(m)), t, int(children[node, 1 - near])))
                node = int(children[node, near])
            if n := sizes.get((t, -1 - node), 0):
                out.append((t, -1 - node))
                held += n
        return out


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (doubles) of the rows that take part, each once."""
    v = F.col("embedding").cast("array<double>")
    good = (
        (F.size(v) > 0)
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    return embeddings.filter(F.col("vec_id").isNotNull() & good).select("vec_id", v.alias("v"))


def _nearest(k: int, dims: int):
    def run(key, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:  # noqa: ANN001
        out = []
        groups = {u: g for u, g in index.groupby(["tree", "leaf", "chunk"], sort=False)}
        for unit, asked in queries.groupby(["tree", "leaf", "chunk"], sort=False):
            if unit not in groups:
                continue
            g = groups[unit]
            x, ids = np.stack(g.v.to_numpy()).reshape(-1, dims), g.vec_id.to_numpy()
            q, of = np.stack(asked.v.to_numpy()).reshape(-1, dims), asked.query_id.to_numpy()
            norms = (x * x).sum(1)
            for at in range(0, len(q), 256):
                rows, own = q[at : at + 256], of[at : at + 256]
                d2 = norms + (rows * rows).sum(1)[:, None] - 2 * rows @ x.T
                d2[own[:, None] == ids] = np.inf
                bound = np.partition(d2, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
                slack = 1e-9 * (1 + norms.max() + (rows * rows).sum(1))
                i, j = np.nonzero((d2 <= (bound + slack)[:, None]) & np.isfinite(d2))
                score = np.sqrt(((rows[i] - x[j]) ** 2).sum(1))
                out.append(pd.DataFrame({"query_id": own[i], "vec_id": ids[j], "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    return run


def search(embeddings: DataFrame, is_query: Column, k: int = 10, trees: int = 8, share: float = 0.25) -> DataFrame:
    """query_id, rank, vec_id, score: for every row where is_query holds, its k nearest other rows."""
    spark = embeddings.sparkSession
    rows = usable(embeddings)
    mixed = F.xxhash64(F.lit("forest"), "vec_id")
    some = rows.orderBy(mixed, "vec_id").limit(SAMPLE).select("v").toPandas()
    result = "query_id bigint, rank int, vec_id bigint, score double"
    if not len(some):
        return spark.createDataFrame([], result)
    dims = int(some.v.map(len).mode()[0])
    forest = Forest.fit(np.stack([v for v in some.v if len(v) == dims]), trees)
    rows = rows.filter(F.size("v") == dims).dropDuplicates(["vec_id", "v"])
    sent = spark.sparkContext.broadcast(forest.trees)

    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vs in batches:
            yield pd.Series(list(Forest(sent.value).leaves(np.stack(vs.to_numpy()).reshape(-1, dims))))

    placed = written(rows.withColumn("leaves", F.pandas_udf(place, "array<bigint>")("v")), "placed")
    spread = placed.select("vec_id", "v", F.posexplode("leaves").alias("tree", "leaf"))
    # as many rows as the forest has leaves: the sample bounds it
    sizes = {(r.tree, r.leaf): r["count"] for r in spread.groupBy("tree", "leaf").count().collect()}
    total = sum(n for (t, _), n in sizes.items() if t == 0)
    enough = trees * max(LEAST, int(share * total)) // 2
    sent_sizes = spark.sparkContext.broadcast(sizes)

    def visit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vs in batches:
            found = [Forest(sent.value).visit(np.asarray(v), sent_sizes.value, enough) for v in vs]
            yield pd.Series([[{"tree": t, "leaf": leaf} for t, leaf in f] for f in found])

    asked = placed.filter(is_query).select("vec_id", "v").repartition(max(8, min(1000, total // 5000)), "vec_id")
    asked = asked.withColumn("visits", F.pandas_udf(visit, "array<struct<tree:int,leaf:bigint>>")("v"))
    asked = written(asked.select(F.col("vec_id").alias("query_id"), "v", "visits"), "asked")
    visits = asked.select("query_id", "v", F.explode("visits").alias("u")).select("query_id", "v", "u.tree", "u.leaf")
    wanted = {(r.tree, r.leaf): r["count"] for r in visits.groupBy("tree", "leaf").count().collect()}
    plan = spark.createDataFrame(
        [(t, leaf, -(-n // CHUNK), -(-wanted[t, leaf] // CHUNK)) for (t, leaf), n in sizes.items() if (t, leaf) in wanted],
        "tree int, leaf bigint, chunks int, asked int",
    )
    # rows that meet in the bins, copies for chunks included
    copies = sum(n * -(-wanted[u] // CHUNK) + wanted[u] * -(-n // CHUNK) for u, n in sizes.items() if u in wanted)
    bins = max(16, copies // 20_000)
    cut = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    unit = F.pmod(F.xxhash64("tree", "leaf", "part", "turn"), F.lit(bins)).cast("int")
    chunk = (F.col("part").cast("bigint") * 2**31 + F.col("turn")).alias("chunk")
    index = (
        spread.join(F.broadcast(plan), ["tree", "leaf"])
        .withColumn("part", cut("vec_id", "chunks")).withColumn("turn", each("asked"))
        .select(unit.alias("bin"), "tree", "leaf", chunk, "vec_id", "v")
    )
    queries = (
        visits.join(F.broadcast(plan), ["tree", "leaf"])
        .withColumn("turn", cut("query_id", "asked")).withColumn("part", each("chunks"))
        .select(unit.alias("bin"), "tree", "leaf", chunk, "query_id", "v")
    )
    near = index.groupBy("bin").cogroup(queries.groupBy("bin")).applyInPandas(
        _nearest(k, dims), "query_id bigint, vec_id bigint, score double"
    )
    once = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
