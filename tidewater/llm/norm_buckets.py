"""Operator 11: exact top-k by inner product of integer vectors, from buckets of vectors of like length.

Index. Vectors are sorted by falling length, over the whole table by ranges of about ``RANGE`` vectors, and within a range
packed into buckets of at most ``BUCKET`` vectors; a bucket is one row, with its greatest length.

Thresholds. Each query is first scored against the bucket of the longest vectors (of the ``HEADS`` commonest numbers of
components); its k-th best score there is a lower bound of its k-th best of all. A range whose longest vector times the query's length stays below it cannot hold a
result, so a block of at most ``QUERIES`` queries meets only the ranges that one of its queries may need. Blocks and
ranges meet by a shuffle on (block, range). Inside, buckets come by falling length and the k-th best score rises as
they are read. For a query and a bucket, score / (length of the query * longest vector) is the cosine that a
vector of the bucket has to reach (the local threshold):

* above 1, the bucket is passed over;
* if few coordinates of the query leave a rest that is short against it (half of the threshold at most), coordinate
  pruning: the product over these coordinates plus the product of the lengths of the rests bounds each score;
* else length pruning: only the vectors that are long enough for the threshold, a prefix of the bucket, are left.

What is left is verified by its whole product. Products are exact: in double precision where the lengths show that they
stay below 2 ** 53, else in Python's whole numbers.

The k best of each block and range are merged by a window. The number of ranges is at most ``MOST_RANGES``, so the
table of their lengths, which is broadcast, has a bound; so have the first buckets.

Defined cases: null vectors, vectors with null or non-finite components and rows with null ids take no part; vectors of
length zero do, and so do empty ones. A query meets vectors of its own number of components. Components beyond 64 bits
are held at their limits, and scores too (equal ones are ties). Rows equal in id and vector count once; rows that share an id but not the
vector are separate candidates and separate queries, and none is a candidate of another. An empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BUCKET, RANGE, QUERIES, HEADS, MOST_RANGES = 2048, 8192, 1024, 4, 10_000
PACKED = "dims int, n int, longest double, ids binary, width int, data binary"
LONG = np.iinfo(np.int64)


def usable(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, v (whole numbers), dims, length of the rows that take part, each once."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = F.transform(x, lambda c: F.floor(c * scale).cast("bigint"))
    rows = embeddings.filter(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad).select("vec_id", v.alias("v")).distinct()
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    return rows.select("vec_id", "v", F.size("v").alias("dims"), F.sqrt(square).alias("length"))


def pack(ids: np.ndarray, m: np.ndarray, length: np.ndarray) -> dict:
    """A row of a packed table; whole numbers in the fewest bytes that hold them all."""
    top = int(max(-int(m.min()), int(m.max()))) if m.size else 0
    width = next(w for w in (1, 2, 4, 8) if top < 2 ** (8 * w - 1) or w == 8)
    return {
        "dims": m.shape[1], "n": len(ids), "longest": float(length.max()), "ids": ids.astype("<i8").tobytes(), "width": width,
        "data": m.astype(f"<i{width}").tobytes(),
    }


def unpack(r) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    return np.frombuffer(r.ids, "<i8"), np.frombuffer(r.data, f"<i{r.width}").reshape(r.n, r.dims)


def _packs(size: int):
    """Packs a partition of rows sorted by dims into runs of at most so many rows of the same number of components."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame()
        ordinal = 0

        def flush(part: pd.DataFrame) -> pd.DataFrame:
            nonlocal ordinal
            dims = int(part.dims.iat[0])
            m = np.array(part.v.tolist(), np.int64).reshape(len(part), dims)
            ordinal += 1
            return pd.DataFrame([{"ordinal": ordinal} | pack(part.vec_id.to_numpy(np.int64), m, part.length.to_numpy())])

        for pdf in batches:
            held = pd.concat([held, pdf]) if len(held) else pdf
            while len(held):
                same = int((held.dims != held.dims.iat[0]).to_numpy().argmax()) or len(held)
                if same < size and same == len(held):
                    break  # more rows of this run may come
                cut = min(size, same)
                yield flush(held.iloc[:cut])
                held = held.iloc[cut:]
        while len(held):
            same = int((held.dims != held.dims.iat[0]).to_numpy().argmax()) or len(held)
            cut = min(size, same)
            yield flush(held.iloc[:cut])
            held = held.iloc[cut:]

    return run


class Best:
    """The k best (score, id) of each of n queries so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None) -> None:
        self.k = k
        self.at, self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.floor = np.full(n, -np.inf) if floor is None else floor.copy()

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(at):
            return
        at, ids, scores = np.concatenate([self.at, at]), np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        fall = -scores if scores.dtype != object else -np.unique(scores, return_inverse=True)[1]
        order = np.lexsort((ids, fall, at))
        at = at[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        keep = order[place < self.k]
        last = order[place == self.k - 1]
        self.ids, self.scores = ids[keep], scores[keep]
        self.at = at[place < self.k]
        whole = at[place == self.k - 1]
        self.floor[whole] = np.maximum(self.floor[whole], scores[last].astype(float))


class Queries:
    def __init__(self, ids: np.ndarray, m: np.ndarray) -> None:
        self.ids, self.m = ids, m.astype(float)
        self.exact = m
        self.length = np.sqrt((self.m**2).sum(1))
        self.order = np.argsort(-np.abs(self.m), axis=1, kind="stable")
        energy = np.take_along_axis(self.m**2, self.order, 1)
        self.rest = np.sqrt(np.maximum((energy.sum(1, keepdims=True) - np.cumsum(energy, 1)), 0.0))


def search_bucket(q: Queries, best: Best, ids: np.ndarray, m: np.ndarray) -> None:
    """Adds the results of a bucket, sorted by falling length, to best."""
    x = m.astype(float)
    square = (x**2).sum(1)
    length = np.sqrt(square)
    longest = float(length.max())
    slack = 1e-9 * (1 + q.length * longest)
    whole = float(q.length.max()) * longest < 2**53
    need = best.floor - slack
    alive = np.flatnonzero(need <= q.length * longest)
    if not len(alive):
        return
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(need > 0, need / (q.length * longest), 0.0)
    focus = np.full(len(q.ids), m.shape[1])
    if whole and m.shape[1]:
        short = q.rest[alive] <= (local[alive] * q.length[alive] / 2)[:, None]
        focus[alive] = np.where(short.any(1), short.argmax(1) + 1, m.shape[1])
    by_coordinate = (local[alive] > 0) & (focus[alive] <= m.shape[1] // 2)
    for i in alive[by_coordinate]:
        f = q.order[i, : focus[i]]
        bound = q.m[i, f] @ x.T[f] + q.rest[i, focus[i] - 1] * np.sqrt(np.maximum(square - (x.T[f] ** 2).sum(0), 0.0))
        left = np.flatnonzero((bound >= need[i]) & (ids != q.ids[i]))
        if len(left):
            scores = x[left] @ q.m[i]
            ok = scores >= best.floor[i]
            best.add(np.full(int(ok.sum()), i), ids[left][ok], scores[ok])
    dense = alive[~by_coordinate]
    for at in range(0, len(dense), 256):
        some = dense[at : at + 256]
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(need[some] > 0, need[some] / q.length[some], 0.0)
        rows = int(np.searchsorted(-length, -least.min() * (1 - 1e-9), "right"))
        if not rows:
            continue
        if whole:
            scores = q.m[some] @ x[:rows].T
        else:
            scores = q.exact[some].astype(object) @ m[:rows].astype(object).T if m.shape[1] else np.zeros((len(some), rows))
            scores = np.minimum(np.maximum(scores.astype(object), LONG.min), LONG.max)
        own = q.ids[some][:, None] == ids[:rows]
        value = scores if whole else scores.astype(float)
        shown = np.where(own, -np.inf, value)
        floor = best.floor[some]
        if rows > best.k:
            floor = np.maximum(floor, np.partition(shown, rows - best.k, axis=1)[:, rows - best.k])
        i, j = np.nonzero((shown >= (floor - (0 if whole else slack[some]))[:, None]) & ~own)
        best.add(some[i], ids[:rows][j], scores[i, j])


def search(embeddings: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: for every row where is_query (of vec_id) holds, the k other rows of largest
    inner product."""
    spark = embeddings.sparkSession
    rows = written(usable(embeddings, scale), "vectors")
    total = rows.count()
    order = ["dims", F.desc("length"), "vec_id", "v"]
    ranges = min(MOST_RANGES, max(1, -(-total // RANGE)))
    spread = rows.repartitionByRange(ranges, "dims", F.desc("length"), "vec_id").sortWithinPartitions(*order)
    index = written(
        spread.mapInPandas(_packs(BUCKET), f"ordinal int, {PACKED}").withColumn("range", F.spark_partition_id()), "buckets"
    )
    longest = F.max_by(F.struct("n", "dims", "ids", "width", "data"), F.struct("longest", -F.col("ordinal"), -F.col("range")))
    tops = index.groupBy("dims").agg(F.sum("n").alias("many"), longest.alias("top")).orderBy(F.desc("many"), "dims").limit(HEADS)
    heads = {r.dims: unpack(r.top) for r in tops.collect()}
    sent = spark.sparkContext.broadcast(heads)

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                ids, m = unpack(r)
                q = Queries(ids, m)
                best = Best(len(ids), k)
                if r.dims in sent.value:
                    search_bucket(q, best, *sent.value[r.dims])
                with np.errstate(divide="ignore", invalid="ignore"):
                    reach = np.where(best.floor > 0, best.floor / q.length, 0.0)
                rows.append({"floors": best.floor.astype("<f8").tobytes(), "reach": float(reach.min()) * (1 - 1e-9)})
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(rows)], axis=1)

    asked = rows.filter(is_query)
    packed = asked.coalesce(max(1, -(-asked.count() // QUERIES))).sortWithinPartitions(*order)
    packed = packed.mapInPandas(_packs(QUERIES), f"ordinal int, {PACKED}").withColumn("block", F.concat_ws("-", F.spark_partition_id().cast("string"), F.col("ordinal").cast("string"))).drop("ordinal")
    blocks = written(packed.mapInPandas(block, f"{PACKED}, block string, floors binary, reach double"), "blocks")
    ends = written(index.groupBy("dims", "range").agg(F.max("longest").alias("end")), "ends")
    few = ends.count() <= 2 * MOST_RANGES  # but for tables of vectors of very many lengths, where each has few ranges
    pairs = blocks.select("block", "dims", "reach").join(F.broadcast(ends) if few else ends.hint("merge"), "dims").filter(F.col("end") >= F.col("reach")).select("block", "dims", "range")
    pairs = written(pairs, "pairs")
    left = pairs.select("block", "range").join(blocks.hint("merge"), "block")
    right = pairs.join(index.hint("merge"), ["dims", "range"]).withColumnsRenamed({"block": "to_block", "range": "from_range"})

    def meet(asked: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(found):
            return pd.DataFrame({"block": [], "at": [], "query_id": [], "vec_id": [], "score": []})
        r = next(asked.itertuples())
        q = Queries(*unpack(r))
        best = Best(len(q.ids), k, np.frombuffer(r.floors, "<f8"))
        for b in found.sort_values(["longest", "ordinal"], ascending=[False, True]).itertuples():
            search_bucket(q, best, *unpack(b))
        scores = np.array([int(s) for s in best.scores], np.int64)
        return pd.DataFrame({"block": r.block, "at": best.at, "query_id": q.ids[best.at], "vec_id": best.ids, "score": scores})

    near = left.groupBy("block", "range").cogroup(right.groupBy("to_block", "from_range")).applyInPandas(
        meet, "block string, at int, query_id bigint, vec_id bigint, score bigint"
    )
    best = F.row_number().over(Window.partitionBy("block", "at").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
