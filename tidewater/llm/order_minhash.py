"""Operator 1: Order MinHash document fingerprints, with built-in functions only.

A text is cut into units: a word of at most ``UNIT`` characters with the white space before it, and single
characters where words are longer or the script writes none, so that units realign right after an edit anywhere.
Every k consecutive units form a k-mer; the o-th occurrence of a k-mer in its text is the numbered k-mer
(k-mer, o), which makes repeats distinct. Each of ``LANES * HASHES`` hash functions selects the l minimal numbered k-mers
of the whole text; they are put back into text order and the tuple is hashed. Two texts agree in a slot if the
same numbered k-mers are minimal and stand in the same order, so moves and edits lower the likeness where a plain
MinHash would not see them.

Function LANES * i + j orders by lane j (seven bits) of the i-th hash, then by further bits of another one, then by
place. Only k-mers with a small lane can be minimal. How small follows the length of the text, so that five or more
are left for each function on average; with a hash as a vector of lanes, one addition tells which of them are small.
A function that is left with fewer than l looks at all k-mers.

Defined cases: a null text counts as empty; an empty text has no k-mers (all slots empty), and two such texts have
likeness 1; fewer units than k form one k-mer; fewer k-mers than l form a shorter tuple. The successor of a document
is the next lower doc_id; rows of one id stand by text hash, null ids last, and the last one is followed by the
first; a table of one row is its own successor. Extra input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, row_key, whole_text, written

UNIT = 15
PIECE = rf"\s*+(?:(?<!\S)\S{{1,{UNIT}}}(?!\S)|\S)|\s++"
PLACE_BITS = 31
PLACE = (1 << PLACE_BITS) - 1
#: Bits of an order value in a packed entry; the place stands below them.
ORDER_BITS = 32
#: Hashes, functions of a hash, k-mers that a function is left with at least on average, rows of a range.
HASHES, LANES, LEFT, ROWS = 3, 7, 5, 50_000


def _lanes(value: int) -> int:
    """value in each lane of a long; the eighth byte stays empty, so that sums do not overflow."""
    return int.from_bytes(bytes([value]) * LANES, "little")


def _kmers(text: Column, k: int) -> Column:
    """The hash of every k-mer, in text order."""

    def of(pieces: Column) -> Column:
        whole = F.when(F.size(pieces) > 0, F.array(F.xxhash64(pieces))).otherwise(F.array().cast("array<bigint>"))
        return F.when(
            F.size(pieces) >= k,
            F.transform(
                F.sequence(F.lit(0), F.size(pieces) - k),
                lambda i: F.xxhash64(*[F.get(pieces, i + j) for j in range(k)]),
            ),
        ).otherwise(whole)

    hashed = F.transform(F.regexp_extract_all(text, F.lit(PIECE), 0), lambda p: F.xxhash64(p))
    return let(hashed, of)


def _numbered(kmers: Column) -> Column:
    """v, the hash of (k-mer, occurrence number), and ``at``, the place, of every k-mer."""
    hash_of = lambda x: F.shiftright(x, PLACE_BITS)

    def number(s: Column) -> Column:
        def of(x: Column, i: Column) -> Column:
            same = lambda back: F.coalesce(hash_of(F.get(s, i - back)) == hash_of(x), F.lit(False))

            # s is sorted: an equal k-mer `back` places before means at least `back` earlier occurrences
            def seen(bits: int) -> Column:
                powers = F.array(*[F.lit(1 << b) for b in reversed(range(bits))])
                return F.aggregate(powers, F.lit(0), lambda n, b: n + F.when(same(n + b), b).otherwise(0))

            few = F.when(~same(F.lit(1)), F.lit(0))
            for bits in (3, 8, 14):
                few = few.when(~same(F.lit(1 << bits)), seen(bits))
            v = F.xxhash64(hash_of(x), few.otherwise(seen(PLACE_BITS - 1)))
            return F.struct(v.alias("v"), x.bitwiseAND(F.lit(PLACE)).alias("at"))

        return F.transform(s, of)

    packed = F.transform(kmers, lambda h, i: F.shiftleft(F.shiftright(h, PLACE_BITS), PLACE_BITS).bitwiseOR(i.cast("bigint")))
    return let(F.sort_array(packed), number)


def _tuple(few: Column, numbered: Column, kmers: Column, i: int, j: int, l: int) -> Column:  # noqa: E741
    """The 32-bit hash of the l minimal k-mers under function (i, j); few: h, v, at of those that can be minimal."""
    rest_bits = ORDER_BITS - 7

    def packed(h: Column, x: Column) -> Column:
        lane = F.shiftrightunsigned(h, 8 * j).bitwiseAND(F.lit(127))
        rest = F.xxhash64(x["v"], F.lit(-1 - LANES * i - j)).bitwiseAND(F.lit((1 << rest_bits) - 1))
        return F.shiftleft(F.shiftleft(lane, rest_bits).bitwiseOR(rest), PLACE_BITS).bitwiseOR(x["at"])

    least = lambda xs: F.slice(F.sort_array(xs), 1, l)
    every = F.transform(numbered, lambda x: packed(_hashed(x, i), x))
    enough = lambda c: F.when(F.size(c) >= F.least(F.lit(l), F.size(numbered)), c).otherwise(least(every))

    def hashed(chosen: Column) -> Column:
        place = lambda e: e.bitwiseAND(F.lit(PLACE))
        name = lambda e: F.xxhash64(F.get(kmers, place(e).cast("int")), F.shiftright(e, PLACE_BITS))
        by_place = F.array_sort(chosen, lambda a, b: (place(a) - place(b)).cast("int"))
        return F.xxhash64(F.transform(by_place, name)).bitwiseAND(F.lit(0xFFFFFFFF))

    return let(let(least(F.transform(few, lambda x: packed(x["h"], x))), enough), hashed)


def _hashed(x: Column, i: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(x["v"], F.lit(i)), 1)


def signature(text: Column, k: int = 3, l: int = 2) -> Column:  # noqa: E741
    """ARRAY<BIGINT> of LANES * HASHES 32-bit tuple hashes; an empty array for an empty text."""
    low, tops = F.lit(_lanes(127)), F.lit(_lanes(128))
    masks = F.array(*[F.lit(_lanes((127 << (7 - b)) & 127)) for b in range(8)])

    def of(kmers: Column) -> Column:
        def slots(numbered: Column) -> Column:
            bits = F.greatest(F.lit(0), F.least(F.lit(7), F.floor(F.log2(F.size(numbered) / LEFT)))).cast("int")

            def by_hash(mask: Column) -> Column:
                def one(i: int) -> Column:
                    # the top bit of each byte tells whether the lane holds any of the mask's bits
                    some = lambda x: (_hashed(x, i).bitwiseAND(mask) + low).bitwiseAND(tops)
                    small = F.transform(F.filter(numbered, lambda x: some(x) != tops), lambda x: F.struct(_hashed(x, i).alias("h"), x["v"].alias("v"), x["at"].alias("at")))

                    def lanes(few: Column) -> Column:
                        own = lambda j: F.filter(few, lambda x: x["h"].bitwiseAND(mask).bitwiseAND(F.lit(127 << 8 * j)) == 0)
                        return F.array(*[_tuple(own(j), numbered, kmers, i, j, l) for j in range(LANES)])

                    return let(small, lanes)

                return F.concat(*[one(i) for i in range(HASHES)])

            return let(F.get(masks, bits), by_hash)

        return F.when(F.size(kmers) > 0, let(_numbered(kmers), slots)).otherwise(F.array().cast("array<bigint>"))

    return let(_kmers(text, k), of)


def as_string(sig: Column) -> Column:
    """Eight hex digits a slot; dots for the slots of an empty text."""
    digits = F.array_join(F.transform(sig, lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")), "")
    return F.when(F.size(sig) > 0, digits).otherwise(F.lit("." * 8 * LANES * HASHES))


def likeness(a: Column, b: Column) -> Column:
    """Share of the slots that agree; 1 if both texts are empty, 0 if one is."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(same / F.lit(LANES * HASHES))


def fingerprints(docs: DataFrame, k: int = 3, l: int = 2) -> DataFrame:  # noqa: E741
    """doc_id and fingerprint (string) of every row of docs."""
    sig = signature(whole_text(), k, l)
    return docs.select("doc_id", as_string(sig).alias("fingerprint"))


def _ranges(docs: DataFrame) -> Column:
    """Column: the place of a row's range (bigint) when doc_id descends, from columns doc_id and k2.

    Ids are cut at up to 4,095 quantiles and evenly inside these; ids that fill a quantile by themselves, and null
    ids, are cut by k2. There are as many ranges as ``ROWS`` rows each need, but 65,536 at most.
    """
    rows = docs.count()
    n = max(1, min(64, int((rows / 64) ** 0.5)))
    m = max(1, min(16, -(-rows // (n * n * ROWS))))
    at = [i / (n * n) for i in range(1, n * n)]
    found = docs.agg(F.percentile_approx("doc_id", [0.0, *at, 1.0], n * n * 100)).first()[0] or [0, 0]
    cuts, low, high = sorted(set(found[1:-1])), found[0], found[-1]
    hot = sorted({x for x, y in zip(found, found[1:], strict=False) if x == y}) if rows > 64 else []
    coarse, fine = cuts[n - 1 :: n], [cuts[i : i + n - 1] for i in range(0, len(cuts), n)]
    longs = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<bigint>")
    below = lambda xs: F.size(F.filter(xs, lambda c: c < F.col("doc_id")))
    each = F.array(*[longs(f) for f in [*fine, []]])
    own = F.col("doc_id").isNull() | F.col("doc_id").isin(hot)
    sub = F.when(own, F.shiftright("k2", 52) + 2048)

    def place(b: Column) -> Column:
        edges = longs([low - 1, *cuts, high])
        lower, upper = F.get(edges, b), F.get(edges, b + 1)
        part = F.floor((F.col("doc_id") - lower - 1) / F.greatest(upper - lower, F.lit(1)) * m)
        return (len(cuts) - b) * 8192 + F.when(own, sub).otherwise(4096 + m - 1 - F.least(F.greatest(part, F.lit(0)), F.lit(m - 1)))

    found_at = let(let(below(longs(coarse)), lambda b: b * n + below(F.get(each, b))), place)
    return F.when(F.col("doc_id").isNull(), (len(cuts) + 1) * 8192 + sub).otherwise(found_at).cast("bigint")


def with_successor(docs: DataFrame, sig: Column) -> DataFrame:
    """doc_id, text, sig, next_text, next_sig: next is the next document in descending doc_id, round the corner.

    Documents are dealt by ranges of ids; the first document of each range is also sent, as a guest, to the
    end of the range before it, so that no range needs another one's rows and texts are shuffled once.
    """
    docs = docs.select("doc_id", whole_text().alias("text"), row_key(F.col("doc_id"), whole_text())[1])
    ids = written(docs.select("doc_id", "k2"), "ids")
    part = _ranges(ids)
    spread = docs.withColumn("part", part)
    order = [F.col("doc_id").desc_nulls_last(), F.col("k2")]
    first = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    heads = ids.withColumn("part", part).withColumn("n", first).filter("n = 1").drop("n")
    every = Window.orderBy("part")  # a row for each range
    last = F.max("part").over(Window.partitionBy())
    heads = written(heads.withColumn("before", F.coalesce(F.lag("part").over(every), last)), "heads")  # 65,536 rows at most
    hosts = heads.select(F.col("part").alias("of"), F.col("doc_id").alias("head"), F.col("k2").alias("head_k2"), "before")
    here = (F.col("part") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("k2") == F.col("head_k2"))
    guests = spread.join(F.broadcast(hosts), here).select("doc_id", "text", "k2", F.col("before").alias("part"), F.lit(1).alias("guest"))
    both = spread.withColumn("guest", F.lit(0)).unionByName(guests).withColumn("sig", sig)
    by_range = Window.partitionBy("part").orderBy("guest", *order)
    return (
        both.withColumn("next_text", F.lead("text").over(by_range))
        .withColumn("next_sig", F.lead("sig").over(by_range))
        .filter("guest = 0")
        .drop("guest", "part", "k2")
    )


def edited_pairs(docs: DataFrame, k: int = 3, l: int = 2) -> DataFrame:  # noqa: E741
    """Per document: its fingerprint, that of its edited text, and both likenesses.

    Edited text: the last floor(n/3) code points give way to the first as many (or all) of the successor.
    """
    base = with_successor(docs, signature(F.col("text"), k, l))
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    out = base.withColumn("edited", edited).withColumn("edited_sig", signature(F.col("edited"), k, l))
    return out.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        as_string(F.col("sig")).alias("fingerprint"),
        as_string(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
