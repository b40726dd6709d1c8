"""BM25 retrieval from an inverted index over the whole vocabulary, for many queries at once.

The index is two tables: postings (term, id, tf, len), dealt by the term's hash into folders, and terms (term, df, idf) with
the number of chunks, their mean length and the mean idf of all terms. A search joins the terms of all queries with
the postings on the term (sent to all tasks, if they are few), so it costs the postings of the terms that are asked for, however many queries there are.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stored import written
from .text import terms


class Index(NamedTuple):
    postings: DataFrame
    terms: DataFrame


#: Terms of queries, and repeated ids, that are sent to all tasks; more meet their tables by a sort.
FEW = 100_000


def _counted(t: Column) -> Column:
    """(term, tf) of each different term of a list of terms, by runs of the sorted list."""
    starts = F.filter(F.transform(t, lambda w, i: F.when((i == 0) | (F.get(t, i - 1) != w), i)), lambda i: i.isNotNull())
    until = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(t)))
    runs = F.filter(F.arrays_zip(starts.alias("i"), until.alias("until")), lambda r: r["i"].isNotNull())  # no terms: no runs
    return F.transform(runs, lambda r: F.struct(F.get(t, r["i"]).alias("term"), (r["until"] - r["i"]).cast("bigint").alias("tf")))


def _posted(d: DataFrame) -> DataFrame:
    """The postings of counted chunks (id, len, terms)."""
    return d.select("id", "len", F.explode("terms").alias("t")).select("t.term", "id", "len", "t.tf")


def build(chunks: DataFrame) -> Index:
    """The index of chunks (id, text).

    idf is ln((N - df + 0.5) / (df + 0.5)); mean_idf, the same in every row of terms, is its mean over the vocabulary, each term
    once, negative ones too. Texts are split once, and the terms of a chunk counted where it is, into a written table; what is
    shuffled are counts by term. Rows of one id and length are one chunk's, so the postings of ids that repeat are grouped, and
    of these alone.
    """
    sorted_ = chunks.select("id", F.sort_array(terms(F.col("text"))).alias("t"))
    d = written(sorted_.select("id", F.size("t").cast("bigint").alias("len"), _counted(F.col("t")).alias("terms")), "chunks")
    stats = d.agg(F.count("*").alias("n_chunks"), F.avg("len").alias("avg_len")).withColumn("__one", F.lit(1))
    postings = _posted(d)
    repeated = written(d.groupBy("id").count().filter("count > 1").select(F.col("id").alias("same")), "repeated")
    if n := repeated.count():
        met = (F.broadcast(repeated) if n <= FEW else repeated.hint("merge"), F.col("id").eqNullSafe(F.col("same")))
        again = _posted(d.join(*met, "left_semi")).groupBy("term", "id", "len").agg(F.sum("tf").alias("tf"))
        alone = d.join(*met, "left_anti")
        postings = _posted(alone if n <= FEW else written(alone, "alone")).unionByName(again)
    df = written(postings.groupBy("term").agg(F.count("*").alias("df")), "terms").withColumn("__one", F.lit(1))
    known = df.join(F.broadcast(stats), "__one").withColumn("idf", F.ln(F.col("n_chunks") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    mean = known.agg(F.avg("idf").alias("mean_idf")).withColumn("__one", F.lit(1))
    return Index(postings, known.join(F.broadcast(mean), "__one").drop("__one"))  # both broadcasts are one row


def write(index: Index, path: str, buckets: int = 64) -> Index:
    """Stores an index and gives it as read from there."""
    bucket = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    for name, df in (("postings", index.postings), ("terms", index.terms)):
        bucket(df).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
    return read(index.postings.sparkSession, path)


def read(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/postings").drop("bucket"), spark.read.parquet(f"{path}/terms").drop("bucket"))


def scores(index: Index, queries: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """query_id, id, score of every chunk that has a term of the query; queries: query_id, text.

    A term counts as often as the query has it. Negative idf become the share epsilon of the vocabulary's mean idf.
    """
    asked = written(queries.select("query_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times")), "asked")
    few = asked.count() <= FEW
    idf = F.when(F.col("idf") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("idf"))
    known = index.terms.join(F.broadcast(asked) if few else asked.hint("merge"), "term")
    weighed = written(known.withColumn("weight", F.col("times") * idf).select("query_id", "term", "weight", "avg_len"), "weighed")
    if few:
        # a posting is dealt by its chunk before it meets all queries that have its term, so that sums need no other exchange
        found = index.postings.join(F.broadcast(weighed.select("term").distinct()), "term", "left_semi")
        hit = found.repartition("id").join(F.broadcast(weighed), "term")
    else:
        hit = index.postings.join(weighed.hint("merge"), "term")
    norm = F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len"))
    return hit.groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.col("tf") * (k1 + 1) / norm).alias("score"))


def top(scored: DataFrame, n: int = 10) -> DataFrame:
    """query_id, place, id, score of the n best of each query; scores equal to nine digits tie, to the smaller id."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
    return scored.withColumn("place", place).filter(F.col("place") <= n).select("query_id", "place", "id", "score")
