"""Operator 4: mixing sources to target weights by weighted fair queueing, with built-in functions only.

Each source is a flow whose documents stand in shuffled order (by the MD5 of seed and doc_id), the whole
source up to ``passes`` times over. A document's virtual finish time is the words of its source up to and
with it, divided by the source's target. All passes of all documents are sorted by finish time over all sources
and taken while the running total stays within the budget; what stands across the cut is taken in part. As in
any packet network, a long document is queued as packets of at most ``packet`` words, each with its own finish
time, so that no source is a long document short at the cut; ``packet=None`` queues whole documents.

Running totals are taken in two levels: a source's words by ranges of the shuffle key and within one range, the
words of the queue by ranges of virtual time and within one range. The number of ranges follows the number of
rows (``ROWS`` a range), so no task holds a source or the queue, however large.

Defined cases: null text has size 0; null is a source of its own, last in order; a null id shuffles by its text;
repeated rows each count; documents of size 0 take 0 words; no rows give no rows; extra columns are ignored. Only
the tables of sources and of ranges (one row each) are ordered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, free, row_key, whole_text, written

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a range; words of a packet.
ROWS, PACKET = 10_000, 1000
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def targets(sized: DataFrame, share: float, passes: int, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """skey, source_size, target of each source: share of all words by weight, at most passes times its own.

    With sources by rising cap / weight, each stays at its cap while the level that the rest would share
    reaches it; the first level that does not is the one of all others.
    """
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sized.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(by_code_point) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(rank, F.lit(len(weights))) + 1)
    s = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * passes)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "skey")
    s = (
        s.withColumn("budget", F.sum("source_size").over(Window.partitionBy(F.lit(0))) * F.lit(share))
        .withColumn("spent", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("spent")) / F.col("left"))
        .withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
        .withColumn("water", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("skey"), "level"))).over(Window.partitionBy(F.lit(0)))["level"])
    )
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("water") * F.col("weight"), F.col("cap").cast("double")))
    return s.select("skey", "source_size", target.alias("target"))


def schedule(docs: DataFrame, share: float = 1.5, passes: int = 2, seed: str = "mix", packet: int | None = PACKET) -> DataFrame:
    """The queue, unsorted, a row for each packet of each pass of each row of docs: row (skey, part, place), doc_id,
    tie (hash of the text), size, source_size, target, pass, packet, words (of the packet), finish, step (its range
    of virtual time; negative where there are no words)."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), whole_text())))
    sized = written(
        docs.select(
            "doc_id",
            "source",
            F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source")).alias("skey"),
            words(whole_text()).alias("size"),
            key.alias("key"),
            F.xxhash64(whole_text()).alias("tie"),
        ),
        "sized",
    )
    ranges = max(1, -(-sized.count() // ROWS))
    sized = sized.withColumn("part", F.substring("key", 1, math.ceil(math.log(ranges, 16)) + 1))
    goal = targets(sized, share, passes)
    parts = sized.groupBy("skey", "part").agg(F.sum("size").alias("part_size"))
    before = Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("part_size").over(before), F.lit(0)))
    parts = parts.join(goal.hint("merge"), "skey").drop("part_size")
    inside = Window.partitionBy("skey", "part").orderBy("key", "size", "tie")
    upto = F.col("before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    rows = sized.join(parts.hint("merge"), ["skey", "part"]).withColumns({"place": F.row_number().over(inside), "start": upto - F.col("size")})
    each = rows.withColumn("pass", F.explode(F.array(*[F.lit(p) for p in range(passes)])))
    if packet is None:
        each = each.withColumns({"packet": F.lit(0), "low": F.lit(0), "high": F.col("size")})
    else:
        last = F.greatest(F.lit(0), F.ceil(F.col("size") / packet) - 1).cast("int")
        each = each.withColumn("packet", F.explode(F.sequence(F.lit(0), last)))
        low = F.col("packet").cast("bigint") * packet
        each = each.withColumns({"low": low, "high": F.least(F.col("size"), low + packet)})
    end = F.col("start") + F.col("pass") * F.col("source_size") + F.col("high")
    each = each.withColumns({"words": F.col("high") - F.col("low"), "finish": F.when(F.col("target") > 0, end / F.col("target"))})
    idle = -1 - F.pmod(F.xxhash64("key"), F.lit(ranges))
    step = F.when(F.col("words") > 0, F.floor(F.col("finish") * ranges)).otherwise(idle)
    return each.select(
        "skey", "part", "place", "doc_id", "tie", "size", "source_size", "target", "pass", "packet", "words", "finish", step.alias("step")
    )


def mix(docs: DataFrame, share: float = 1.5, passes: int = 2, seed: str = "mix", packet: int | None = PACKET) -> DataFrame:
    """schedule() with ``position`` (words of the queue before it, by finish time) and ``taken`` (words within the
    budget)."""
    queue = written(schedule(docs, share, passes, seed, packet), "queue")
    sums = queue.groupBy("step").agg(F.sum("words").alias("sum"))
    every = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ahead = sums.withColumn("ahead", F.coalesce(F.sum("sum").over(every), F.lit(0))).drop("sum")
    order = Window.partitionBy("step").orderBy("finish", "skey", "pass", "part", "place", "packet")
    run = F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0))
    total = queue.agg(F.sum(F.when(F.col("pass") == 0, F.col("words")))).first()[0] or 0
    budget = F.lit(math.floor(total * share))
    out = queue.join(ahead.hint("merge"), "step").withColumn("position", F.col("ahead") + run - F.col("words"))
    taken = F.greatest(F.lit(0), F.least(F.col("words"), budget - F.col("position")))
    return out.withColumn("taken", taken).drop("ahead", "step")


def taken_words(docs: DataFrame, share: float = 1.5, passes: int = 2, seed: str = "mix") -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken (words over all passes)."""
    return (
        mix(docs, share, passes, seed)
        .groupBy("skey", "part", "place")
        .agg(*[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")], F.sum("taken").alias("taken"))
        .select("doc_id", "size", "source_size", "target", "taken")
    )


def resample(docs: DataFrame, share: float = 1.5, passes: int = 2, seed: str = "mix") -> DataFrame:
    """The rows of docs, each as often as a pass of it is taken whole; documents are queued whole.

    Documents without words cost nothing and stay once. Rows equal in source, id and text are interchangeable; the
    n-th of them goes with the n-th place that they have in their source.
    """
    skey, k1, k2, n, times, copy = free(docs, "skey", "k1", "k2", "n", "times", "copy")
    source = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source"))
    whole = F.when(F.col("size") == 0, F.col("pass") == 0).otherwise(F.col("taken") == F.col("size"))
    took = (
        mix(docs.select("doc_id", "source", "text"), share, passes, seed, None)
        .groupBy(F.col("skey").alias(skey), F.coalesce("doc_id", F.lit(NULL_ID)).alias(k1), F.col("tie").alias(k2), "place")
        .agg(F.count_if(whole).cast("int").alias(times))
    )
    place = Window.partitionBy(skey, k1, k2).orderBy("place")
    took = took.withColumn(n, F.row_number().over(place)).drop("place")
    keys = row_key(F.col("doc_id"), whole_text())
    rows = docs.withColumns({skey: source, k1: keys[0], k2: keys[1]})
    rows = rows.withColumn(n, F.row_number().over(Window.partitionBy(skey, k1, k2).orderBy(k2)))
    out = rows.join(took.hint("merge"), [skey, k1, k2, n])
    return out.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(times)))).select(*docs.columns)


SQL = """
WITH sized AS (
  SELECT row_number() OVER () AS rid, doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS skey,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), text, '')) AS key
  FROM documents),
sources AS (
  SELECT source, skey, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source, skey),
weighed AS (
  SELECT *, 2 * source_size AS cap,
         CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS DOUBLE) AS weight
  FROM sources),
levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
water AS (
  SELECT arg_min(level, cap / weight) AS water FROM levels WHERE level * weight < cap),
goals AS (
  SELECT skey, source_size, least(cap::DOUBLE, coalesce(water * weight, cap::DOUBLE)) AS target FROM levels, water),
run AS (
  SELECT s.*, g.source_size, g.target,
         CAST(sum(s.size) OVER (PARTITION BY s.skey ORDER BY s.key, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - s.size AS start
  FROM sized s JOIN goals g ON s.skey = g.skey),
packets AS (
  SELECT *, unnest(range(0, greatest(1, CAST(ceil(size / 1000.0) AS BIGINT)))) AS packet
  FROM run, (VALUES (0), (1)) AS passes(pass)),
queue AS (
  SELECT *, least(size - 1000 * packet, 1000) AS words,
         (start + pass * source_size + least(size, 1000 * packet + 1000)) / nullif(target, 0) AS finish
  FROM packets),
placed AS (
  SELECT *, sum(words) OVER (ORDER BY finish, skey, pass, key, size, packet ROWS UNBOUNDED PRECEDING) - words AS position
  FROM queue WHERE words > 0),
cut AS (
  SELECT rid, sum(greatest(0, least(words, (SELECT floor(1.5 * sum(size)) FROM sized) - position))) AS taken
  FROM placed GROUP BY rid)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM run LEFT JOIN cut USING (rid)
"""
