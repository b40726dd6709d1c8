"""Operator 5: substring dedup by sliding sentence spans.

A text is cut into sentences: after . ! ? and white space (full-width ones anywhere), and at line ends. A sentence
of more than ``long`` words is cut further into its clauses, after , ; : and white space, so that long-winded texts
have as fine spans as others. Every run of ``n`` consecutive sentences is hashed (128 bits) and joined over all
documents. The first occurrence of a hash (lowest doc_id, null first, then text hash, then place) stays; the
sentences that any other one covers are removed. A passage is found if it holds n whole sentences.

Hashes are counted first, so that only those that recur travel with their places; what joins them back are plain
exchanges, which Spark can split where a passage is in very many texts.

Defined cases: null and empty texts stay as they are and have no sentences; a text of fewer than n sentences has no
run and stays; white space between words does not count; rows equal in id and text count as one document and are
treated alike; repeats inside one document count as well; extra columns are kept by ``clean``, and a column of its
own goes by a free name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, row_key, small_batches, whole_text, written

SENTENCE = re.compile(r"[^\s.!?。！？](?:[^.!?\n。！？]|[.!?](?!\s))*[.!?。！？]*|[.!?。！？]+(?=\s|$)")
CLAUSE = re.compile(r"\S(?:[^,;:]|[,;:](?!\s))*[,;:]*")
#: Sentences of a run, and words from which on a sentence is cut into clauses.
N, LONG = 3, 20


def sentences(text: str, long: int = LONG) -> list[tuple[int, int]]:
    """Start and end of every sentence, or clause of a long one, without the white space between them."""
    out = []
    for m in SENTENCE.finditer(text):
        a, b = m.span()
        if b - a > 2 * long and len(m[0].split()) > long:
            for c in CLAUSE.finditer(text, a, b):
                out.append((c.start(), c.start() + len(c[0].rstrip())))
        else:
            out.append((a, b))
    return out


def runs(text: str, n: int, long: int) -> Iterator[tuple[int, bytes]]:
    """First sentence and hash of every run."""
    joined = [" ".join(text[a:b].split()) for a, b in sentences(text, long)]
    for i in range(len(joined) - n + 1):
        yield i, hashlib.blake2b("\n".join(joined[i : i + n]).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _run_rows(n: int, long: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            k1, k2, at, h = [], [], [], []
            for a, b, text in zip(pdf.k1, pdf.k2, pdf.text, strict=True):
                for i, digest in runs(text, n, long):
                    k1.append(a)
                    k2.append(b)
                    at.append(i)
                    h.append(digest)
                    if len(at) == 30_000:
                        yield _frame(k1, k2, at, h)
                        k1, k2, at, h = [], [], [], []
            yield _frame(k1, k2, at, h)

    return run


def _frame(k1: list, k2: list, at: list, h: list) -> pd.DataFrame:
    halves = np.frombuffer(b"".join(h), np.int64).reshape(-1, 2)
    return pd.DataFrame({"k1": k1, "k2": k2, "at": at, "h1": halves[:, 0], "h2": halves[:, 1]})


def repeats(docs: DataFrame, n: int = N, long: int = LONG) -> DataFrame:
    """k1, k2 (row_key), ``runs``: the first sentences of the repeated runs that are not the first."""
    small_batches(docs.sparkSession)
    keyed = docs.select(*row_key(F.col("doc_id"), whole_text()), whole_text().alias("text"))
    made = keyed.mapInPandas(_run_rows(n, long), "k1 bigint, k2 bigint, at int, h1 bigint, h2 bigint")
    made = written(made, "runs")
    often = made.groupBy("h1", "h2").agg(F.count("*").alias("often")).filter("often > 1").select("h1", "h2")
    again = written(made.join(written(often, "often").hint("merge"), ["h1", "h2"], "left_semi"), "again")
    place = F.struct("k1", "k2", "at")
    # written, so that both sides of the join are plain exchanges, which Spark can split
    first = written(again.groupBy("h1", "h2").agg(F.min(place).alias("first")), "first")
    later = again.join(first.hint("merge"), ["h1", "h2"]).filter(place != F.col("first"))
    return later.groupBy("k1", "k2").agg(F.collect_set("at").alias("runs"))


def _without(n: int, long: int):
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found in batches:
            rows = []
            for text, starts in zip(texts, found, strict=True):
                spans = sentences(text or "", long)
                if starts is None:
                    rows.append((text, len(spans), []))
                    continue
                drop = sorted({s for i in starts for s in range(i, i + n)})
                out, at = [], 0
                for i in drop:
                    a, b = spans[i]
                    out.append(text[at:a])
                    at = b
                out.append(text[at:])
                rows.append(("".join(out), len(spans), drop))
            yield pd.DataFrame(rows, columns=["text", "n_sentences", "removed"])

    return run


def clean(docs: DataFrame, n: int = N, long: int = LONG) -> DataFrame:
    """docs with the repeated sentences cut out of text, and ``__n_sentences``, ``__n_removed``, ``__removed``."""
    k1, k2, found, new = free(docs, "k1", "k2", "runs", "new")
    r = repeats(docs, n, long).withColumnsRenamed({"k1": k1, "k2": k2, "runs": found})
    keys = row_key(F.col("doc_id"), whole_text())
    out = docs.withColumns({k1: keys[0], k2: keys[1]}).join(r.hint("merge"), [k1, k2], "left")
    udf = F.pandas_udf(_without(n, long), "text string, n_sentences bigint, removed array<int>")
    out = out.withColumn(new, udf("text", found))
    columns = [F.col(f"{new}.text").alias(c) if c == "text" else F.col(c) for c in docs.columns]
    removed = F.col(f"{new}.removed")
    return out.select(*columns, F.col(f"{new}.n_sentences").alias("__n_sentences"), F.size(removed).cast("bigint").alias("__n_removed"), removed.alias("__removed"))
