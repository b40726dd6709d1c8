"""Text retrieval over supporting documents, article filters, and catalogue search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunk(docs: DataFrame) -> DataFrame:
    """source, n, header, text: documents cut before "## " headings."""
    c = docs.select("source", F.posexplode(F.split("text", r"\n(?=## )", -1)).alias("n", "text"))
    return c.select("source", "n", F.trim(F.regexp_replace(F.substring_index("text", "\n", 1), "^#+ *", "")).alias("header"), "text")


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: F.length(w) > 1)


def bm25(
    chunks: DataFrame, query: list[str], top: int = 10, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25,
    boosts: dict[str, float] | None = None, ids: list[str] | None = None, bonus: float = 5.0, chars: int | None = None, digits: int = 9,
) -> DataFrame:
    """id, score of the best chunks (id, text, and source with boosts) for the words of a query; with chars also text,
    cut to so many characters.

    Negative weights of very common terms become a share epsilon of the mean weight of all terms of the chunks (see
    retrieval, whose stored index serves many queries). A chunk's score is multiplied by the boost of its source; a
    chunk that names one of ids gets a bonus. Scores equal to so many digits tie, to the smaller id, as sums of the same
    weights in another order differ in their last bits.
    """
    from . import retrieval

    one = chunks.sparkSession.createDataFrame([(0, " ".join(query))], "query_id int, text string")
    s = retrieval.scores(retrieval.build(chunks), one, k1, b, epsilon).select("id", "score")
    if boosts or ids:
        times = F.lit(1.0)
        for source, by in (boosts or {}).items():
            times = F.when(F.col("source") == source, by).otherwise(times)
        named = has_any(F.upper("text"), [i.upper() for i in ids or []])
        more = chunks.select("id", times.alias("times"), F.when(named, bonus).otherwise(0.0).alias("bonus")).filter("times <> 1 OR bonus > 0")
        s = s.join(more.hint("merge"), "id", "full").select("id", (F.coalesce("score", F.lit(0.0)) * F.coalesce("times", F.lit(1.0)) + F.coalesce("bonus", F.lit(0.0))).alias("score")).filter("score <> 0")
    best = s.orderBy(F.desc(F.round("score", digits)), "id").limit(top)
    if chars is None:
        return best
    cut = F.when(F.char_length("text") <= chars, F.col("text")).otherwise(F.concat(F.rtrim(F.substring("text", 1, chars)), F.lit("\n… [truncated]")))
    return chunks.select("id", cut.alias("text")).join(F.broadcast(best), "id").select("id", "score", "text")  # top rows


def has_any(text: Column, parts: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in parts]).cast("array<string>"), lambda p: F.contains(text, p))


def has_keyword(text: Column, keywords: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(F.lower(text), k))


def article_filter(articles: DataFrame, seen: DataFrame, keywords: list[str], per_source: int = 5) -> DataFrame:
    """The first new relevant articles of each source, by url."""
    new = articles.filter(has_keyword(F.concat_ws(" ", "title", "summary"), keywords)).join(seen.select("url").distinct(), "url", "left_anti")
    n = F.row_number().over(Window.partitionBy("source").orderBy("url"))
    return new.withColumn("__n", n).filter(F.col("__n") <= per_source).drop("__n")


def catalogue_search(papers: DataFrame, keys: list[str], groups: list[str], words: list[str], top: int = 5) -> DataFrame:
    """title, score: papers by overlap of series (+3), group (+2), words (+1) and their own relevance."""
    overlap = F.size(F.array_intersect("key_series", F.array(*[F.lit(k) for k in keys])))
    score = 3 * overlap + 2 * F.col("group").isin(groups).cast("int") + has_keyword(F.col("title"), words).cast("int")
    s = papers.withColumn("match", score).filter("match > 0").groupBy("title").agg(F.max(F.col("match") + F.col("relevance")).alias("score"))
    return s.orderBy(F.desc("score"), "title").limit(top)


def html_to_text(html: Column, chars: int | None = None) -> Column:
    """Visible text by line, without blank lines; the whole of it, or up to so many characters."""
    t = F.regexp_replace(html, r"(?is)<(script|style|nav|footer|header)\b[^>]*>.*?</(script|style|nav|footer|header)>", "")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "\n")
    t = F.regexp_replace(t, r"[ \t\r]*\n\s*", "\n")
    t = F.regexp_replace(t, r"^\n|\n$", "")
    return t if chars is None else F.substring(t, 1, chars)


def links(pages: DataFrame, pattern: str = "") -> DataFrame:
    """page_id, n, href: links of each page that match a pattern."""
    found = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)
    out = pages.select("page_id", F.posexplode(found).alias("n", "href"))
    return out.filter(F.col("href").rlike(pattern)) if pattern else out


def table_cells(pages: DataFrame) -> DataFrame:
    """page_id, row, cell, text of every table cell."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?is)<tr[^>]*>(.*?)</tr>"), 1)).alias("row", "r"))
    cells = rows.select("page_id", "row", F.posexplode(F.regexp_extract_all("r", F.lit("(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1)).alias("cell", "c"))
    return cells.select("page_id", "row", "cell", F.trim(F.regexp_replace("c", "<[^>]*>", "")).alias("text"))
