"""Operator 7: SimHash near-duplicates with bit-sliced comparison.

Fingerprints of 64 bits link at ``radius`` or fewer differing bits. A pair within the radius agrees in at
least c of radius + c blocks of bits, so fingerprints meet under each choice of c blocks; c is the least for
which a key is shared by few fingerprints. Keys with more than ``TILE`` fingerprints are cut into chunks that
meet pairwise, so no task holds more than two chunks of a key.

In a task the fingerprints of a key are stored vertically: 64 planes, each with one bit of 64 fingerprints
in a word. A query is compared with all 64 at once: XOR with a plane gives where the bit differs, carry-save
counters add that up, and a block is left as soon as all its distances exceed the radius. Found pairs are
united in the task and leave it as stars; the stars of all tasks are joined to components by rounds of joins.

Defined cases: null and empty texts have no words and fingerprint zero, which links like any other; with
fewer words than the shingle the whole sequence is the one shingle; repeated rows give repeated results; a
null id counts as the largest (a component of null ids alone has a null id); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free, small_batches, whole_text, written
from .components import components

SEED, BITS = 42, 64
#: Stands for a null id.
LAST = 2**63 - 1
#: Fingerprints of a key that one task compares with as many others.
TILE = 2048
#: Fingerprints that may share a key before keys get longer.
FEW = 64
_ONE, _FULL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)


def simhash(text: str | None, shingle: int = 4) -> int:
    """As an unsigned number: a bit is set if it is in over half of the shingles' XXH64."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    ends = (ends - 1).tolist()
    last = max(1, n - shingle + 1)
    width = min(shingle, n) - 1
    one = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, last, 65536):
        h = np.array([one(joined[starts[i] : ends[i + width]], SEED) for i in range(at, min(last, at + 65536))], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > last, bitorder="little").view(np.uint64)[0])


def of_hashes(hashes: np.ndarray) -> int:
    """The fingerprint, as an unsigned number, of shingles that are hashed already; zero for none."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, k2 (hash of the text), fp (the fingerprint as a signed bigint) for every row of docs."""

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([simhash(t, shingle) for t in texts], np.uint64).view(np.int64))

    small_batches(docs.sparkSession)
    text = whole_text()
    return docs.select("doc_id", F.xxhash64(text).alias("k2"), F.pandas_udf(each, "bigint")(text).alias("fp"))


def _within(fps: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints of one group (equal group numbers stand together) within the radius."""
    if not 0 <= radius <= 6:
        raise ValueError("counters of three bits hold radii up to 6")
    step = 7 - radius
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(fps)])
    starts, sizes = starts[sizes > 1], sizes[sizes > 1]
    if not len(starts):
        return
    # blocks of up to 64 members, as 64 planes each
    n_blocks = -(-sizes // 64)
    first_block = np.cumsum(n_blocks) - n_blocks
    own = np.repeat(np.arange(len(starts)), n_blocks)
    block_start = starts[own] + 64 * (np.arange(n_blocks.sum()) - first_block[own])
    block_len = np.minimum(64, starts[own] + sizes[own] - block_start)
    members = np.minimum(block_start[:, None] + np.arange(64), len(fps) - 1)
    there = np.arange(64) < block_len[:, None]
    valid = np.packbits(there, axis=1, bitorder="little").view(np.uint64)[:, 0]
    bits = np.unpackbits(fps[members].view(np.uint8).reshape(len(members), 64, 8), axis=2, bitorder="little")
    upright = np.ascontiguousarray(bits.transpose(0, 2, 1))
    planes = np.packbits(upright, axis=2, bitorder="little").view(np.uint64)[:, :, 0].T.copy()
    # every member is a query against the blocks of its group
    pairs_of = sizes * n_blocks
    upto = np.cumsum(pairs_of)
    for low in range(0, int(upto[-1]), 1 << 17):
        k = np.arange(low, min(int(upto[-1]), low + (1 << 17)))
        g = np.searchsorted(upto, k, side="right")
        within = k - (upto[g] - pairs_of[g])
        query = starts[g] + within // n_blocks[g]
        block = first_block[g] + within % n_blocks[g]
        alive = valid[block].copy()
        c0, c1, c2 = (np.zeros(len(k), np.uint64) for _ in range(3))
        for p in range(BITS):
            x = planes[p][block] ^ (np.uint64(0) - (fps[query] >> np.uint64(p) & _ONE))
            carry = c0 & x
            c0 ^= x
            carry, c1 = c1 & carry, c1 ^ carry
            c2 ^= carry
            if p % step == step - 1 or p == BITS - 1:  # often enough that no counter passes 7 unseen
                for value in range(radius + 1, 8):
                    same = _FULL
                    for bit, c in enumerate((c0, c1, c2)):
                        same = same & (c if value >> bit & 1 else ~c)
                    alive &= ~same
            if p % 6 == 5:
                left = alive != 0
                if not left.any():
                    break
                if left.mean() < 0.7:
                    query, block, alive, c0, c1, c2 = (v[left] for v in (query, block, alive, c0, c1, c2))
        keep = alive != 0
        query, block, alive = query[keep], block[keep], alive[keep]
        for at in range(0, len(query), 4096):
            lanes = np.unpackbits(alive[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, j = np.nonzero(lanes)
            a, b = query[at + i], block_start[block[at + i]] + j
            yield a[a < b], b[a < b]


def _stars(fps: np.ndarray, group: np.ndarray, radius: int) -> pd.DataFrame:
    root = np.arange(len(fps))
    for a, b in _within(fps, group, radius):
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
    linked = np.flatnonzero(root != np.arange(len(fps)))
    signed = fps.view(np.int64)
    return pd.DataFrame({"a": signed[linked], "b": signed[root[linked]]})


def _compare(radius: int):
    """Partitions sorted by key, in batches; a key's rows may go over from one batch to the next."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def flush(pdf: pd.DataFrame) -> pd.DataFrame:
            keys = pdf[["pick", "bits", "tile"]].to_numpy()
            new = np.r_[True, (keys[1:] != keys[:-1]).any(1)]
            return _stars(pdf.fp.to_numpy(np.int64).view(np.uint64), np.cumsum(new), radius)

        for pdf in batches:
            if not len(pdf):
                continue
            last = pdf[["pick", "bits", "tile"]].iloc[-1]
            open_ = (pdf[["pick", "bits", "tile"]] == last).all(axis=1).to_numpy()
            cut = int(np.flatnonzero(open_)[0])
            if cut:
                yield flush(pd.concat([*held, pdf.iloc[:cut]]))
                held = []
            held.append(pdf.iloc[cut:])
        if held:
            yield flush(pd.concat(held))

    return run


def _keyed(fps: DataFrame, radius: int, choose: int) -> DataFrame:
    """fp under every choice of blocks: pick (which), bits (the fingerprint with all other bits zero)."""
    n = radius + choose
    edges = [BITS * i // n for i in range(n + 1)]
    masks = []
    for picked in combinations(range(n), choose):
        mask = sum((1 << edges[i + 1]) - (1 << edges[i]) for i in picked)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keys = F.array(*[F.struct(F.lit(i).alias("pick"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("bits")) for i, m in enumerate(masks)])
    return fps.select("fp", F.explode(keys).alias("k")).select("k.pick", "k.bits", "fp")


def stars(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (a, b) that connect what links among different fingerprints fp."""
    count = fps.count()
    choose = next(c for c in range(1, 16) if count / 2 ** (BITS * c / (radius + c)) <= FEW or c == 15)
    keyed = _keyed(fps, radius, choose)
    hot = keyed.groupBy("pick", "bits").agg(F.count("*").alias("n")).filter(F.col("n") > TILE)
    hot = written(hot, "hot").select("pick", "bits", F.ceil(F.col("n") / TILE).cast("int").alias("chunks"))
    rows = keyed.join(hot.hint("merge"), ["pick", "bits"], "left")
    chunks = F.coalesce("chunks", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    tiles = F.transform(
        F.sequence(F.lit(0), chunks - 1),
        lambda c: F.least(own, c).cast("bigint") * 2**31 + F.greatest(own, c),
    )
    rows = rows.select("pick", "bits", F.explode(tiles).alias("tile"), "fp")
    rows = rows.repartition("pick", "bits", "tile").sortWithinPartitions("pick", "bits", "tile")
    return rows.mapInPandas(_compare(radius), "a bigint, b bigint")


def grouped(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """doc_id, k2, fp, least (id, k2 of the first document of the component) for every row of docs.

    A component's documents stand by doc_id, null last (as the largest bigint), then by text hash.
    """
    by_doc = written(fingerprints(docs, shingle), "fingerprints")
    place = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "k2")
    different = written(by_doc.groupBy("fp").agg(F.min(place).alias("least")), "different")
    roots = components(written(stars(different.select("fp"), radius), "stars"))
    linked = different.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp")
    of_root = linked.groupBy("root").agg(F.min("least").alias("first"))
    linked = linked.join(of_root.hint("merge"), "root").select("fp", "first")
    named = different.join(linked.hint("merge"), "fp", "left").select(
        "fp", F.coalesce("first", "least").alias("least")
    )
    return by_doc.join(written(named, "named").hint("merge"), "fp")


def link(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (least doc_id of the component) for every row of docs."""
    least = F.col("least.id")
    return grouped(docs, radius, shingle).select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(least != LAST, least).alias("component_id"),
    )


def representatives(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """The first document of each component, once; columns as in docs."""
    own, k2, n = free(docs, "id", "k2", "n")
    place = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "k2")
    first = grouped(docs, radius, shingle).filter(F.col("least") == place)
    first = first.select(F.col("least.id").alias(own), F.col("k2").alias(k2)).distinct()
    rows = docs.withColumns({own: F.coalesce("doc_id", F.lit(LAST)), k2: F.xxhash64(whole_text())})
    rows = rows.join(written(first, "first").hint("merge"), [own, k2], "left_semi")
    one = Window.partitionBy(own, k2).orderBy(k2)
    return rows.withColumn(n, F.row_number().over(one)).filter(F.col(n) == 1).select(*docs.columns)
