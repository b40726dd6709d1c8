"""Near copies for the pipeline: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Operator 7's steps come first: fingerprints of the sets, keys of blocks of bits and the bit-sliced comparison give what
differs in ``radius`` bits or fewer. At a similarity of 0.8 two fingerprints of 64 bits differ in about ten, and
those alone would lose most links, so MinHash adds candidates: ``BANDS`` bands of
``ROWS`` minima; a pair at 0.8 shares no band with a probability of (1 - 0.8^4)^25 = 2e-6. Every link, of
either kind, is then decided by the exact similarity of the two sets.

Equal sets are one from the start. Sets that are joined as candidates, also by way of others, are compared in one
task: from a set are reached all that link to it and are not reached yet, which gives exact components without
comparing what is connected already. Candidates of more than ``TILE`` shingles are cut into chunks that meet
pairwise, so no task holds more than about two chunks of them. Texts are shuffled only for candidates.

Defined cases: words are as in operator 7; with fewer words than the shingle the whole sequence is the one
shingle; null and empty texts have an empty set and are copies of each other; repeated rows count once; a null
id counts as the largest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free, small_batches, whole_text, written
from .components import components
from .simhash import LAST, SEED, of_hashes, stars

BANDS, ROWS = 25, 4
#: Shingles of candidates that one task compares with as many others.
TILE = 1_000_000
_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
_PLUS = _RNG.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64)
_FOLD = _RNG.integers(0, 2**64, (BANDS, ROWS), np.uint64) | np.uint64(1)


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """The set of XXH64 of a text's shingles, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    ends = (ends - 1).tolist()
    width = min(shingle, n) - 1
    one = xxhash.xxh64_intdigest
    return np.unique(np.array([one(joined[starts[i] : ends[i + width]], SEED) for i in range(max(1, n - shingle + 1))], np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of minima; none for the empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[at : at + 2048] * _TIMES + _PLUS).min(axis=1), out=least)
    keys = (least.reshape(BANDS, ROWS) * _FOLD).sum(axis=1, dtype=np.uint64)
    return keys.view(np.int64)


def signatures(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """id, k2 (hash of the text), same (hash of the set), n (its size), fp (its fingerprint), bands for every row of docs."""

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingles(t, shingle) for t in texts]
            same = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            fps = np.array([of_hashes(s) for s in sets], np.uint64).view(np.int64)
            yield pd.DataFrame({"same": same, "n": [len(s) for s in sets], "fp": fps, "bands": [bands(s) for s in sets]})

    small_batches(docs.sparkSession)
    text = whole_text()
    made = F.pandas_udf(each, "same bigint, n bigint, fp bigint, bands array<bigint>")(text)
    rows = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.xxhash64(text).alias("k2"), made.alias("s"))
    return rows.select("id", "k2", "s.*")


def linked(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For every set the first one of its component; sets are not empty."""
    root = np.arange(len(sets))
    sizes = np.array([len(s) for s in sets])
    words, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(flat, np.cumsum(sizes)[:-1])
    left = np.arange(len(sets))
    mark = np.zeros(len(words), bool)
    queue: list[int] = []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            flat, left = flat[sizes[left[0]] :], left[1:]
            if not len(left):
                break
        q = queue.pop()
        mark[own[q]] = True
        n = sizes[left]
        common = np.add.reduceat(mark[flat], np.cumsum(n) - n, dtype=np.int64)
        mark[own[q]] = False
        near = common >= similarity * (sizes[q] + n - common) - 1e-9
        if near.any():
            found = left[near]
            root[found] = root[q]
            queue += found.tolist()
            flat, left = flat[np.repeat(~near, n)], left[~near]
    return root


def _compare(shingle: int, similarity: float):
    """Partitions sorted by root and tile, in batches; a tile's rows may go over from one batch to the next."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, sets = None, {}

        def flush() -> Iterator[pd.DataFrame]:
            if len(sets) > 1:
                names = np.array(list(sets), np.int64)
                root = linked(list(sets.values()), similarity)
                off = np.flatnonzero(root != np.arange(len(root)))
                yield pd.DataFrame({"a": names[off], "b": names[root[off]]})

        for pdf in batches:
            for group, tile, same, text in zip(pdf.root, pdf.tile, pdf.same, pdf.text, strict=True):
                if (group, tile) != key:
                    yield from flush()
                    key, sets = (group, tile), {}
                if same not in sets:
                    sets[same] = shingles(text, shingle)
        yield from flush()

    return run


def _alike(different: DataFrame, radius: int) -> DataFrame:
    """Candidates (a, b) among different sets whose fingerprints differ in radius bits or fewer."""
    some = different.filter("n > 0").select("same", "fp")
    named = written(some.groupBy("fp").agg(F.min("same").alias("b")), "named")  # sets of equal fingerprints meet at one
    equal = some.join(named.hint("merge"), "fp").select(F.col("same").alias("a"), "b").filter("a <> b")
    found = written(stars(named.select("fp"), radius), "stars")
    of = lambda c: named.select(F.col("fp").alias(c), F.col("b").alias(f"{c}_of")).hint("merge")
    return equal.unionByName(found.join(of("a"), "a").join(of("b"), "b").select(F.col("a_of").alias("a"), F.col("b_of").alias("b")))


def _different(by_doc: DataFrame) -> DataFrame:
    """The different sets of signatures, each with its first document; rows of a set have equal n, fp and bands."""
    first = [F.first(c).alias(c) for c in ("n", "fp", "bands")]
    return by_doc.groupBy("same").agg(F.min(F.struct("id", "k2")).alias("least"), *first)


def _edges(docs: DataFrame, different: DataFrame, shingle: int, similarity: float, radius: int = 4) -> DataFrame:
    """Edges (a, b) that connect what links among different sets."""
    keyed = written(different.select("same", F.explode("bands").alias("key")), "bands")
    least = keyed.groupBy("key").agg(F.min("same").alias("b"), F.max("same").alias("top")).filter("b < top").drop("top")
    met = keyed.join(written(least, "met").hint("merge"), "key").select(F.col("same").alias("a"), "b")
    met = met.unionByName(_alike(different, radius)).distinct()
    roots = components(written(met, "candidates")).withColumnRenamed("node", "same")
    rows = written(different.select("same", "n", "least.*").join(roots.hint("merge"), "same"), "compared")
    large = rows.groupBy("root").agg(F.sum("n").alias("all")).filter(F.col("all") > TILE)
    large = written(large.select("root", F.ceil(F.col("all") / TILE).cast("int").alias("chunks")), "large")
    rows = rows.join(large.hint("merge"), "root", "left")
    chunks = F.coalesce("chunks", F.lit(1))
    own = F.pmod(F.xxhash64("same"), chunks).cast("int")
    tiles = F.transform(
        F.sequence(F.lit(0), chunks - 1),
        lambda c: F.least(own, c).cast("bigint") * 2**31 + F.greatest(own, c),
    )
    rows = rows.select("id", "k2", "root", "same", tiles.alias("tiles"))
    texts = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.xxhash64(whole_text()).alias("k2"), whole_text().alias("text"))
    rows = texts.join(rows.hint("merge"), ["id", "k2"]).select("root", F.explode("tiles").alias("tile"), "same", "text")
    rows = rows.repartition("root", "tile").sortWithinPartitions("root", "tile")
    return rows.mapInPandas(_compare(shingle, similarity), "a bigint, b bigint")


def representatives(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 4) -> DataFrame:
    """The first document (by doc_id, null last, then text hash) of each component, once; columns as in docs."""
    own, k2, n = free(docs, "id", "k2", "n")
    by_doc = written(signatures(docs, shingle), "signatures")
    different = written(_different(by_doc), "different")
    roots = written(components(written(_edges(docs, different, shingle, similarity, radius), "links")), "roots")
    of = different.select("same", "least").join(roots.withColumnRenamed("node", "same").hint("merge"), "same", "left")
    first = of.groupBy(F.coalesce("root", "same").alias("root")).agg(F.min("least").alias("first"))
    first = first.select(F.col("first.id").alias(own), F.col("first.k2").alias(k2))
    rows = docs.withColumns({own: F.coalesce("doc_id", F.lit(LAST)), k2: F.xxhash64(whole_text())})
    rows = rows.join(written(first, "first").hint("merge"), [own, k2], "left_semi")
    one = Window.partitionBy(own, k2).orderBy(k2)
    return rows.withColumn(n, F.row_number().over(one)).filter(F.col(n) == 1).select(*docs.columns)
