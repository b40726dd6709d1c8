"""Operator 8: line dedup by a log-template tree, with built-in functions only.

Lines are parsed to a fixed depth: the first level of the tree is the number of tokens, the next ``depth``
levels are the leading tokens (a token with a digit counts as a wildcard). In a leaf, a token that at least
``min_docs`` documents show at its position is constant and any other is a variable field. A line's template
is its tokens with the variable ones generalised. Wildcards are variable by design, so constancy is judged over
the other tokens: a template counts if one of these at least, and a share of ``constant`` of them, stay. A line
without such a template is one by itself if it stands unchanged in ``min_docs`` different documents. Templates
that occur in ``min_docs`` or more different documents are boilerplate: their lines are dropped, but for the
first one (lowest doc_id, then line).

Exact copies of a whole document count as one document here, or every line of a copied text would be
boilerplate; they are left to document dedup.

Lines are parsed once and written with their keys; only those whose leaf recurs are compared token by token, so
what is shuffled besides the texts is a few longs a line. Hot leaves and lines are counted with partial sums; what joins them back are sort-merge joins, which
Spark can split.

Defined cases: null or empty text has no lines and stays as it is; blank lines are never dropped; rows equal
in id and text count as one document and are treated alike; a null id comes first; an empty table gives an
empty result; extra columns are kept by ``clean`` and ignored by ``flag``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, let, row_key, whole_text, written

WILD = "<*>"


def _tokens(line: Column) -> Column:
    words = F.array_remove(F.split(F.regexp_replace(line, r"[\x09-\x0D]", " "), " ", -1), "")
    return F.transform(words, lambda w: F.when(w.rlike("[0-9]"), F.lit(WILD)).otherwise(w))


def flag(docs: DataFrame, depth: int = 3, min_docs: int = 10, constant: float = 0.6) -> DataFrame:
    """k1, k2 (row_key) and ``drop``: the sorted places of the lines to drop; only documents that lose any."""
    tokens = F.array_remove(F.split(F.regexp_replace("line", r"[\x09-\x0D]", " "), " ", -1), "")
    lead = F.transform(F.slice("tokens", 1, depth), lambda w: F.when(w.rlike("[0-9]"), F.lit(WILD)).otherwise(w))
    seen = (
        docs.select(*row_key(F.col("doc_id"), whole_text()), whole_text().alias("text"))
        .select("k1", "k2", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
        .withColumn("tokens", tokens)
        .filter(F.size("tokens") > 0)
        .select(
            "k1", "k2", "at", "line",
            F.xxhash64(F.size("tokens"), lead).alias("leaf"),
            F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"),
        )
    )
    seen = written(seen, "lines")
    keys = seen.drop("line")
    # leaves in enough different texts
    leaves = (
        keys.select("leaf", "k2").distinct().groupBy("leaf").agg(F.count("*").alias("n"))
        .filter(F.col("n") >= min_docs).select("leaf")
    )
    leaves = written(leaves, "leaves")
    # the different lines of those leaves, with the number of texts that have each
    known = (
        keys.join(leaves.hint("merge"), "leaf", "left_semi")
        .select("leaf", "h1", "h2", "k2").distinct()
        .groupBy("leaf", "h1", "h2").agg(F.count("*").alias("docs"))
    )
    text_of = (
        seen.join(leaves.hint("merge"), "leaf", "left_semi")
        .groupBy("leaf", "h1", "h2").agg(F.min("line").alias("line"))
    )
    different = written(text_of.join(known.hint("merge"), ["leaf", "h1", "h2"]), "different")
    fields = different.select(
        "leaf", "h1", "h2", "docs", F.posexplode(_tokens(F.col("line"))).alias("place", "token")
    )
    fields = fields.withColumn("th", F.xxhash64("token"))
    support = (
        fields.filter((F.col("place") >= depth) & (F.col("token") != WILD))
        .groupBy("leaf", "place", "th").agg(F.sum("docs").alias("n"))
        .filter(F.col("n") >= min_docs).select("leaf", "place", "th", F.lit(1).alias("often"))
    )
    marked = fields.join(written(support, "support").hint("merge"), ["leaf", "place", "th"], "left")
    # template: the constants in order; the leading tokens are in the leaf
    leading = (F.col("place") < depth) & (F.col("token") != WILD)
    template_of = marked.groupBy("leaf", "h1", "h2", "docs").agg(
        F.count_if(F.col("token") != WILD).alias("all"),
        F.count_if(leading | (F.col("often") == 1)).alias("kept"),
        F.xxhash64(
            F.array_sort(F.collect_list(F.when(F.col("often") == 1, F.struct("place", "th"))))
        ).alias("rest"),
    )
    stays = (F.col("kept") > 0) & (F.col("kept") >= constant * F.col("all"))
    # a line that recurs unchanged is a template by itself
    template = F.when(stays, F.xxhash64("leaf", "rest")).when(F.col("docs") >= min_docs, F.xxhash64("h1", "h2", "leaf"))
    template_of = template_of.select("h1", "h2", "leaf", template.alias("template")).filter("template IS NOT NULL")
    template_of = written(template_of, "templates")
    hits = written(keys.join(template_of.hint("merge"), ["leaf", "h1", "h2"]).select("template", "k1", "k2", "at"), "hits")
    boilerplate = (
        hits.select("template", "k2").distinct().groupBy("template").agg(F.count("*").alias("n"))
        .filter(F.col("n") >= min_docs).select("template")
    )
    first = hits.groupBy("template").agg(F.min(F.struct("k1", "k2", "at")).alias("first"))
    # written, so that both sides of the next join are plain exchanges and a template with many lines can be split
    boilerplate = written(boilerplate.join(first.hint("merge"), "template"), "boilerplate")
    doomed = hits.join(boilerplate.hint("merge"), "template").filter(F.struct("k1", "k2", "at") != F.col("first"))
    return doomed.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("at")).alias("drop"))


def clean(docs: DataFrame, depth: int = 3, min_docs: int = 10, constant: float = 0.6, counts: bool = True) -> DataFrame:
    """docs with their boilerplate lines dropped from text, and with ``counts`` also ``__n_lines`` and ``__n_dropped``."""
    k1, k2, drop, new = free(docs, "k1", "k2", "drop", "new")
    flags = flag(docs, depth, min_docs, constant).withColumnsRenamed({"k1": k1, "k2": k2, "drop": drop})
    keys = row_key(F.col("doc_id"), whole_text())
    lines = F.split("text", "\n", -1)
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    left = lambda x: F.transform(F.array_except(places, F.col(drop)), lambda i: F.get(x, i))
    kept = F.array_join(let(lines, left), "\n")
    out = docs.withColumns({k1: keys[0], k2: keys[1]}).join(flags.hint("merge"), [k1, k2], "left")
    out = out.withColumn(new, F.when(F.col(drop).isNull(), F.col("text")).otherwise(kept))
    columns = [F.col(new).alias(c) if c == "text" else F.col(c) for c in docs.columns]
    if not counts:
        return out.select(*columns)
    n_lines = F.when(F.length(whole_text()) > 0, F.size(lines)).otherwise(0).cast("bigint")
    return out.select(*columns, n_lines.alias("__n_lines"), F.coalesce(F.size(drop), F.lit(0)).cast("bigint").alias("__n_dropped"))
