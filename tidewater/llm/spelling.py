"""Operator 12: spelling variants by range searches in k-d trees over letter counts.

Words. Runs of letters of all texts are lower-cased (A to Z only), some lose a code point (``noisy``), and the results of
at least ``least`` code points and occurrences are the words, with their number of occurrences n.

Near words. One edit changes the letter counts by an L1 distance of two (a replaced letter: one count up, one
down) or one (an inserted letter: one count up), so the near words of a word of length L are found among the words of
length L and L + 1 by a range search of radius one up and one down, or one up. A k-d tree for each length, fitted on
a bounded sample (the words whose hash is in a range that makes them about ``SAMPLE``), cuts the words into cells; a word goes to its own cell as a target and to
each cell that its range touches as a query (box pruning). Within a cell, a k-d tree of its targets is searched in
the same way, and the order of the letters of what is in range is verified. Words of lengths that the sample
does not have share ``SPARE`` cells by length.

No task holds a cell that grew large: its targets and its queries are cut into chunks of at most ``CHUNK`` by hash, each
chunk of the one meeting each of the other. Words with equal counts cannot be told apart by a tree and are cut so too.
A word has at most (2 L + 2) * 90 near words, as there are 90 letters, so no word gathers an unbounded list.

Forms. A word's form is its near word of largest n (ties: smallest in code-point order) if that is at least ``times``
its own. Forms lead upwards in n by at least ``times``, so a chain has a bounded number of steps, which pointers that double
their reach follow to the root.

Defined cases: null and empty texts have no words; a null id is an empty one; repeated rows count again; very long runs
are words like others; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: a to z, then U+00C0 to U+00FF
LETTERS = 26 + 64
SAMPLE, CELL, LEAF, CHUNK, SPARE = 50_000, 8192, 32, 32_768, 512
FOUND = "word string, n bigint, near string, near_n bigint"


class KdTree:
    """Splits of vectors of whole numbers: a node sends those with at most ``cut`` in ``dim`` left. Children are node
    numbers, or -1 - leaf number."""

    def __init__(self, x: np.ndarray, leaf: int) -> None:
        self.dims: list[int] = []
        self.cuts: list[int] = []
        self.children: list[list[int]] = []
        self.members: list[np.ndarray] = []
        self.root = self._grow(x, np.arange(len(x)), leaf)

    def _grow(self, x: np.ndarray, rows: np.ndarray, leaf: int) -> int:
        if len(rows) > leaf:
            part = x[rows]
            middle = np.partition(part, len(rows) // 2, axis=0)[len(rows) // 2]
            below = (part < middle).mean(0)
            upto = (part <= middle).mean(0)
            share = np.where(np.abs(below - 0.5) < np.abs(upto - 0.5), below, upto)
            dim = int(np.abs(share - 0.5).argmin())
            if 0 < share[dim] < 1:
                cut = int(middle[dim]) - (share[dim] == below[dim] and share[dim] != upto[dim])
                left = part[:, dim] <= cut
                at = len(self.dims)
                self.dims.append(dim)
                self.cuts.append(cut)
                self.children.append([0, 0])
                self.children[at] = [self._grow(x, rows[left], leaf), self._grow(x, rows[~left], leaf)]
                return at
        self.members.append(rows)
        return -len(self.members)

    def place(self, q: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        out = np.empty(len(q), np.int64)
        for leaf, rows in self.visit(q, 0, 0):
            out[rows] = leaf
        return out

    def visit(self, q: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of q) for the leaves whose boxes are within so many steps up and down; each is 0 or 1."""
        stack = [(self.root, np.arange(len(q)), np.full(len(q), up), np.full(len(q), down))]
        while stack:
            node, rows, ups, downs = stack.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -1 - node, rows
                continue
            over = q[rows, self.dims[node]].astype(np.int64) - self.cuts[node]
            fall, rise = np.maximum(over, 0), np.maximum(1 - over, 0)
            for child, a, b in ((self.children[node][0], ups, downs - fall), (self.children[node][1], ups - rise, downs)):
                ok = (a >= 0) & (b >= 0)
                stack.append((child, rows[ok], a[ok], b[ok]))


def codes(words: list[str]) -> np.ndarray:
    """Letters of words of one length as numbers from 0 to LETTERS - 1, a row each."""
    c = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(np.int64)
    return np.where(c < 0xC0, c - 97, c - 0xC0 + 26)


def counts(c: np.ndarray) -> np.ndarray:
    flat = np.arange(len(c))[:, None] * LETTERS + c
    many = np.bincount(flat.ravel(), minlength=len(c) * LETTERS).reshape(len(c), LETTERS)
    return many.astype(np.int8 if c.shape[1] < 64 else np.int32)


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters, of equal length or b longer by one, differ by exactly one edit."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    ahead = np.cumprod(a == b[:, :-1], axis=1).sum(1)
    behind = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return ahead + behind >= a.shape[1]


def near_pairs(targets: list[str], queries: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(target numbers, query numbers) that are one edit apart; all of one length, or queries shorter by one.

    Of equal length only those with the query first in code-point order.
    """
    tc, qc = codes(targets), codes(queries)
    t, q = counts(tc), counts(qc)
    same = tc.shape[1] == qc.shape[1]
    used = (t.any(0)) | (q.any(0))
    t, q = t[:, used], q[:, used]
    tree = KdTree(t, LEAF)
    rank = np.argsort(np.argsort(np.array([*targets, *queries], object), kind="stable"), kind="stable") if same else None
    for leaf, rows in tree.visit(q, 1, int(same)):
        own = tree.members[leaf]
        for at in range(0, len(rows), 1024):
            some = rows[at : at + 1024]
            for low in range(0, len(own), 4 * LEAF):
                part = own[low : low + 4 * LEAF]
                apart = np.abs(q[some][:, None, :] - t[part]).sum(2, dtype=np.int16 if t.dtype == np.int8 else np.int64)
                i, j = np.nonzero(apart == (2 if same else 1))
                i, j = some[i], part[j]
                if same:
                    first = rank[len(targets) + i] < rank[j]
                    i, j = i[first], j[first]
                ok = in_order(qc[i], tc[j])
                if ok.any():
                    yield j[ok], i[ok]


def noisy(docs: DataFrame, every: int = 199) -> DataFrame:
    """A row (word) for each run of letters of docs, lower-cased; where ``every`` divides the CRC-32 h of
    ``<doc_id>:<run>``, the run has lost its code point h % length."""
    text = F.translate("text", UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    h = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    return h.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(runs: DataFrame, least_length: int = 6, least: int = 5) -> DataFrame:
    """word, n of the words of runs with so many code points and occurrences."""
    words = runs.filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return words.filter(F.col("n") >= least)


def _text(words: np.ndarray | list) -> pd.Series:
    return pd.Series(words, dtype=object)


class Cells:
    """The k-d trees of the sampled lengths, and the numbers of their cells."""

    def __init__(self, sample: list[str], leaf: int) -> None:
        self.trees: dict[int, tuple[int, KdTree]] = {}
        self.total = SPARE
        by_length: dict[int, list[str]] = {}
        for w in sample:
            by_length.setdefault(len(w), []).append(w)
        for length, words in sorted(by_length.items()):
            tree = KdTree(counts(codes(words)), leaf)
            self.trees[length] = self.total, tree
            self.total += len(tree.members)
            tree.members = []

    def home(self, length: int, x: np.ndarray) -> np.ndarray:
        if length not in self.trees:
            return np.full(len(x), length % SPARE)
        first, tree = self.trees[length]
        return first + tree.place(x)

    def reached(self, length: int, x: np.ndarray, down: int) -> Iterator[tuple[int, np.ndarray]]:
        if length not in self.trees:
            yield length % SPARE, np.arange(len(x))
            return
        first, tree = self.trees[length]
        for leaf, rows in tree.visit(x, 1, down):
            yield first + leaf, rows


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n for each pair of words (a stored table: word, n) that are one edit apart, both ways."""
    spark = words.sparkSession
    total = words.count()
    share = min(2**40, 2**40 * SAMPLE // max(1, total))
    sample = [r.word for r in words.select("word").filter(F.pmod(F.xxhash64("word"), F.lit(2**40)) < share).collect()]
    cells = Cells(sample, max(16, CELL * len(sample) // max(1, total)))
    sent = spark.sparkContext.broadcast(cells)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lengths = pdf.word.str.len()
            for length, part in pdf.groupby(lengths):
                names, n = part.word.to_numpy(object), part.n.to_numpy()
                x = counts(codes(names.tolist()))
                yield pd.DataFrame({"cell": sent.value.home(length, x), "target": True, "length": length, "word": _text(names), "n": n})
                for ahead in (0, 1):
                    for cell, rows in sent.value.reached(length + ahead, x, 1 - ahead):
                        yield pd.DataFrame({"cell": cell, "target": False, "length": length + ahead, "word": _text(names[rows]), "n": n[rows]})

    routed = written(words.mapInPandas(route, "cell int, target boolean, length int, word string, n bigint"), "routed")
    # a row for each cell: at most SPARE + SAMPLE
    sizes = routed.groupBy("cell").agg(F.count_if("target").alias("targets"), F.count_if(~F.col("target")).alias("queries"))
    chunks = lambda c: F.ceil(F.col(c) / CHUNK).cast("int")
    sizes = sizes.filter("targets > 0").select("cell", chunks("targets").alias("tn"), chunks("queries").alias("qn"))
    own = F.pmod(F.xxhash64("word"), F.when(F.col("target"), F.col("tn")).otherwise(F.col("qn"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("target"), F.col("qn")).otherwise(F.col("tn")) - 1))
    cut = routed.join(F.broadcast(sizes), "cell").withColumn("own", own).withColumn("other", other)
    unit = cut.select(
        "cell", F.when(F.col("target"), F.col("own")).otherwise(F.col("other")).alias("t"), F.when(F.col("target"), F.col("other")).otherwise(F.col("own")).alias("q"),
        "target", "length", "word", "n",
    )

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list[np.ndarray]] = [[], [], [], []]
        for length, part in pdf.groupby("length"):
            t, asked = part[part.target], part[~part.target]
            if not len(t):
                continue
            targets, tn = t.word.to_numpy(object), t.n.to_numpy()
            size = asked.word.str.len()
            for _, q in asked.groupby(size):
                queries, qn = q.word.to_numpy(object), q.n.to_numpy()
                for j, i in near_pairs(targets.tolist(), queries.tolist()):
                    for column, there, back in zip(out, (queries[i], qn[i], targets[j], tn[j]), (targets[j], tn[j], queries[i], qn[i]), strict=True):
                        column += [there, back]
        words, n, near, near_n = (np.concatenate(c) if c else [] for c in out)
        return pd.DataFrame({"word": _text(words), "n": n, "near": _text(near), "near_n": near_n})

    return unit.groupBy("cell", "t", "q").applyInPandas(meet, FOUND)


def roots(forms: DataFrame, most: int, times: int = 5) -> DataFrame:
    """word, root: where the chain of forms (word, form) ends; most: the largest n, which bounds the chains."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    steps = max(1, math.ceil(math.log(max(2, most), times)))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = written(now.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return now


def variants(docs: DataFrame, times: int = 5, every: int = 199, least_length: int = 6, least: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of docs."""
    small_batches(docs.sparkSession)
    words = written(vocabulary(noisy(docs, every), least_length, least), "words")
    near = near_words(words)
    first = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near")))
    met = written(near.groupBy("word").agg(F.count("*").alias("n_near"), F.first("n").alias("n"), first.alias("top")), "met")
    ok = F.col("top.near_n") >= times * F.col("n")
    met = met.select("word", "n_near", F.when(ok, F.col("top.near")).alias("form"), F.when(ok, F.col("top.near_n")).alias("form_n"))
    most = words.agg(F.max("n")).first()[0] or 0
    ends = roots(met.filter("form IS NOT NULL"), most, times)
    out = words.join(met.hint("merge"), "word", "left").join(ends.hint("merge"), "word", "left")
    return out.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n"
    )


#: CRC-32 of UTF-8 bytes by its table, then deletion neighbours: words that share a rest at the same place differ by one
#: replaced letter, a word that equals a rest of another by one inserted.
SQL = r"""
WITH RECURSIVE tbl AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i::BIGINT) AS c
    FROM range(256) r(i))),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
  FROM documents WHERE text IS NOT NULL),
many AS (SELECT id, run, count(*) AS m, hex(encode(concat(id, ':', run))) AS x FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, m, xor(list_reduce(list_transform(range(0, CAST(length(x) AS BIGINT), 2), lambda k: CAST(concat('0x', substr(x, k + 1, 2)) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h
  FROM many, tbl),
cut AS (
  SELECT CASE WHEN h % 199 = 0 THEN concat(substr(run, 1, CAST(h % length(run) AS BIGINT)), substr(run, CAST(h % length(run) AS BIGINT) + 2)) ELSE run END AS word, m
  FROM hashed),
words AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5),
rests AS (
  SELECT word, p, concat(substr(word, 1, p - 1), substr(word, p + 1)) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM words)),
pairs AS (
  SELECT DISTINCT a, b FROM (
    SELECT a.word AS a, b.word AS b FROM rests a JOIN rests b ON a.p = b.p AND a.rest = b.rest WHERE a.word <> b.word
    UNION ALL SELECT w.word, r.word FROM words w JOIN rests r ON w.word = r.rest
    UNION ALL SELECT r.word, w.word FROM words w JOIN rests r ON w.word = r.rest)),
ranked AS (
  SELECT p.a AS word, p.b AS near, w.n AS near_n, count(*) OVER (PARTITION BY p.a) AS n_near,
         row_number() OVER (PARTITION BY p.a ORDER BY w.n DESC, encode(p.b)) AS place
  FROM pairs p JOIN words w ON p.b = w.word),
met AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= 5 * w.n THEN r.near END AS form, CASE WHEN r.near_n >= 5 * w.n THEN r.near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.place = 1),
chain AS (
  SELECT word, word AS root FROM met
  UNION ALL SELECT c.word, m.form FROM chain c JOIN met m ON c.root = m.word WHERE m.form IS NOT NULL),
last AS (SELECT c.word, c.root FROM chain c JOIN met m ON c.root = m.word WHERE m.form IS NULL)
SELECT m.word, m.form, l.root, m.n, CAST(m.n_near AS BIGINT) AS n_near, m.form_n FROM met m JOIN last l ON m.word = l.word
"""
