"""Selection by sets of series, and retrieval from a stored index."""

import datetime as dt
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewater.operators import retrieval, select, text

TODAY = dt.date(2024, 3, 1)
def as_of():
    return F.lit(TODAY)


FOUND = "slug string, kind string, discovered date, status string, series_ids array<string>"


def ago(n):
    return TODAY - dt.timedelta(n)


def test_one_shown_series_blocks_a_pair(spark):
    found = spark.createDataFrame([
        ("pair", "shift", ago(3), "new", ["a", "b"]), ("other", "shift", ago(3), "new", ["c"]), ("same", "shift", ago(3), "new", ["d", "d"]),
        ("none", "shift", ago(3), "new", []), ("same", "shift", ago(3), "new", ["e"]),
    ], FOUND)
    history = spark.createDataFrame([(ago(2), "x", ["b", "d"]), (ago(15), "y", ["c"])], "date date, slug string, series_ids array<string>")
    tiers = lambda **o: sorted((r.slug, tuple(r.series_ids), r.tier) for r in select.eligible(found, history, as_of(), **o).collect())
    assert tiers() == [("none", (), 0), ("other", ("c",), 0), ("same", ("e",), 0)]
    more = spark.createDataFrame([(ago(3), ["b"]), (ago(8), ["d"])], "date date, series_ids array<string>")
    assert ("pair", ("a", "b"), 0) in tiers(more=more) and ("same", ("d", "d"), 0) not in tiers(more=more)
    assert ("same", ("d", "d"), 0) in tiers(more=more, more_days=10)
    blocked = found.filter("slug = 'pair'")
    assert [(r.slug, r.tier) for r in select.eligible(blocked, history, as_of()).collect()] == [("pair", 2)]


def test_releases_by_members_and_by_name(spark):
    releases = spark.createDataFrame([(1, "Consumer Price Index", TODAY), (2, "Daily Rates", TODAY), (3, "Retail Sales", ago(-5))], "release_id int, release_name string, release_date date")
    members = spark.createDataFrame([(1, "cpi"), (2, "dff"), (3, "rs")], "release_id int, series_id string")
    got = {(r.series_id, r.release_id) for r in select.upcoming_series(releases, members, as_of(), ["consumer price", "Retail"], 2, {"price": ["pce"]}).collect()}
    assert got == {("cpi", 1), ("pce", 1)}
    found = spark.createDataFrame([("p", ["x", "pce"]), ("q", ["dff"])], "slug string, series_ids array<string>")
    flags = {r.slug: r.upcoming for r in select.release_match(found, releases, members, as_of(), ["consumer price"], named={"price": ["pce"]}).collect()}
    assert flags == {"p": True, "q": False}
    seeds = spark.createDataFrame([("s1", False, ago(-9), ["a", "b"], 5.0), ("s2", False, ago(-9), ["c"], 1.0)], "id string, used boolean, expires date, series_ids array<string>, priority_score double").withColumn("upcoming", F.lit(False))
    shown = spark.createDataFrame([(["b"],)], "series_ids array<string>")
    assert select.pick_seed(seeds, as_of()).first().id == "s1" and select.pick_seed(seeds, as_of(), shown).first().id == "s2"


def test_index_against_plain_scores(spark, tmp_path):
    """The vocabulary's mean idf counts, a repeated word of a query counts twice, and a stored index gives the same."""
    docs = {1: "the cat the mat", 2: "the dog", 3: "the the bird cat", 4: "", 5: "the zebra"}
    asked = {"q": "the cat", "r": "the the dog unknown", "empty": "", "none": "xyzzy"}
    words = {i: [w for w in t.split() if len(w) > 1] for i, t in docs.items()}
    n, mean_len = len(docs), sum(map(len, words.values())) / len(docs)
    df = Counter(w for t in words.values() for w in set(t))
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    assert idf["the"] < 0
    mean = sum(idf.values()) / len(idf)
    want = {}
    for q, text in asked.items():
        for i, t in words.items():
            s = sum((0.25 * mean if idf[w] < 0 else idf[w]) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean_len)) for w in text.split() if w in idf)
            if any(w in t for w in text.split()):
                want[q, i] = s
    index = retrieval.build(spark.createDataFrame(list(docs.items()), "id int, text string"))
    queries = spark.createDataFrame(list(asked.items()), "query_id string, text string")
    for one in (index, retrieval.write(index, str(tmp_path / "index"), 3), retrieval.read(spark, str(tmp_path / "index"))):
        got = {(r.query_id, r.id): r.score for r in retrieval.scores(one, queries).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    best = retrieval.top(retrieval.scores(index, queries), 1).collect()
    assert {(r.query_id, r.place) for r in best} == {("q", 1), ("r", 1)}


def test_bm25_repeated_ids_and_one_exchange(spark, monkeypatch):
    """Rows of one id and length are one chunk's; empty and null texts count as chunks; sums are made where the chunk is."""
    texts = [(1, "rate up rate"), (1, "rate gap x2"), (2, ""), (3, None), (4, "rate of the gap gap"), (None, "gap up up up")]
    chunks = spark.createDataFrame(texts, "id int, text string")
    queries = spark.createDataFrame([("q", "rate gap gap"), ("r", "up none")], "query_id string, text string")
    tf, length = {}, {}
    for i, t in texts:
        length.setdefault(i, []).append(len((t or "").split()))
        for w in (t or "").split():
            tf[i, w] = tf.get((i, w), 0) + 1
    df = {w: sum(k[1] == w for k in tf) for w in {k[1] for k in tf}}
    idf = {w: math.log(6 - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean, mean_len = sum(idf.values()) / len(idf), sum(len(t.split()) for _, t in texts if t is not None) / 5
    weight = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    want = {}
    for q, words in (("q", ["rate", "gap", "gap"]), ("r", ["up"])):
        for w in words:
            for i in length:
                if (i, w) in tf:
                    n = tf[i, w]
                    want[q, i] = want.get((q, i), 0) + weight[w] * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * length[i][0] / mean_len))
    for few in (retrieval.FEW, 0):
        monkeypatch.setattr(retrieval, "FEW", few)
        scored = retrieval.scores(retrieval.build(chunks), queries)
        got = {(r.query_id, r.id): r.score for r in scored.collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
        assert not few or "hashpartitioning(query_id" not in scored._jdf.queryExecution().executedPlan().toString()


def test_bm25_shuffles_postings_of_repeated_ids_alone(spark, monkeypatch):
    """A repeated id, null too, does not make the postings of the other chunks meet; few terms of a query meet the vocabulary where it is."""
    texts = [(1, "rate up rate"), (2, "gap rate up"), (None, "up gap"), (1, "rate gap x2"), (1, "gap"), (None, "up up"), (3, "rate"), (4, None)]
    want = {}
    for i, t in texts:
        words = (t or "").split()
        for w in words:
            want[w, i, len(words)] = want.get((w, i, len(words)), 0) + 1
    plans = {}
    write = retrieval.written

    def kept(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label)

    monkeypatch.setattr(retrieval, "written", kept)
    for few in (retrieval.FEW, 0):
        monkeypatch.setattr(retrieval, "FEW", few)
        index = retrieval.build(spark.createDataFrame(texts, "id int, text string"))
        assert {(r.term, r.id, r.len): r.tf for r in index.postings.collect()} == want and index.postings.count() == len(want)
        assert {r.term: r.df for r in index.terms.collect()} == {w: sum(k[0] == w for k in want) for w in {k[0] for k in want}}
        assert index.postings._jdf.queryExecution().optimizedPlan().toString().startswith("Union")  # of what is grouped and what is not
        scored = retrieval.scores(index, spark.createDataFrame([("q", "gap up")], "query_id string, text string"))
        assert {r.id for r in scored.collect()} == {1, 2, None}
        assert not few or "hashpartitioning(term" not in plans["weighed"]


def test_bm25_scores_equal_to_digits_tie(spark, monkeypatch):
    """Sums that differ in their last bits tie, to the smaller id; a query that rounds to six digits ties by these."""
    chunks = spark.createDataFrame([(1, "gap"), (2, "gap")], "id int, text string")
    for second, rule in ((0.1 + 0.2, {}), (0.3000001, {"digits": 6})):
        monkeypatch.setattr(retrieval, "scores", lambda *a, second=second: spark.createDataFrame([(0, 1, 0.3), (0, 2, second)], "query_id int, id int, score double"))
        assert [r.id for r in text.bm25(chunks, ["gap"], 1, **rule).collect()] == [1]
    assert [r.id for r in text.bm25(chunks, ["gap"], 1).collect()] == [2]
