"""Operator 12 against brute force."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tidewater.llm import spelling
from tidewater.llm.queries import ORACLES, QUERIES

DOCS = "doc_id bigint, text string, word string, n int, cell string, root string"


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, every=199, least_length=6, least=5):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= least_length
    words = {w: c for w, c in n.items() if c >= least}
    out = {}
    for w, c in words.items():
        near = [v for v in words if one_edit(w, v)]
        top = min(near, key=lambda v: (-words[v], v), default=None)
        form = top if near and words[top] >= 5 * c else None
        out[w] = [form, c, len(near), words[form] if form else None]
    rows = []
    for w, (form, c, near, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, c, near, form_n))
    return sorted(rows)


def given(spark, docs):
    return spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in docs], DOCS)


def got(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def texts():
    """Words of many lengths with variants of falling frequency, anagrams, accents, ties, chains of forms."""
    r = random.Random(4)
    stems = ["".join(r.choice("abcdeéÀ") for _ in range(r.randrange(6, 12))) for _ in range(60)] + ["abcdef", "fedcba", "abcdfe", "longest" * 30]
    bag = []
    for n, w in enumerate(stems):
        bag += [w] * r.choice((5, 6, 30, 200))
        for _ in range(4):
            k = r.randrange(len(w))
            bag += [w[:k] + r.choice(("", "x", w[k] + "y")) + w[k + 1 :]] * r.choice((3, 5, 5, 26))
        if n % 5 == 0:
            bag += [w] * 300 + [w + "q"] * 45 + [w + "qq"] * 7
    r.shuffle(bag)
    docs = [(i, " ".join(w.upper() if (i + j) % 7 == 0 and w.isascii() else w for j, w in enumerate(bag[i::40]))) for i in range(40)]
    return docs + [(50, None), (51, ""), (52, "1 2 3 中文 x"), (None, "abcdef abcdef"), (3, "abcdef;fedcba--abcdef")]


@pytest.mark.parametrize("sample", [0, 100, 50_000])
def test_against_brute_force(spark, monkeypatch, sample):
    """Few samples leave lengths without trees, small cells make many of them, small chunks cut them."""
    for name, n in (("SAMPLE", sample), ("CELL", 20), ("LEAF", 3), ("CHUNK", 25 if sample else 1000)):
        monkeypatch.setattr(spelling, name, n)
    docs = texts()
    want = brute(docs, every=19)
    assert sum(w[1] is not None for w in want) > 20 and any(w[2] != w[1] and w[1] for w in want)
    assert got(spelling.variants(given(spark, docs).repartition(3), every=19)) == want


def test_empty(spark):
    assert got(spelling.variants(given(spark, []))) == []
    assert got(spelling.variants(given(spark, [(1, None), (2, "short words")]))) == []


def test_tree_boxes():
    """The leaves within one step up and one down hold all vectors in that range."""
    rng = np.random.default_rng(0)
    x = rng.integers(0, 4, size=(500, 6))
    tree = spelling.KdTree(x, 8)
    assert sorted(np.concatenate(tree.members).tolist()) == list(range(500))
    assert all((tree.place(x)[m] == leaf).all() for leaf, m in enumerate(tree.members))
    for up, down in ((1, 1), (1, 0), (0, 0)):
        seen = np.zeros((500, 500), bool)
        for leaf, rows in tree.visit(x, up, down):
            seen[np.ix_(rows, tree.members[leaf])] = True
        d = x[None] - x[:, None]
        within = (np.maximum(d, 0).sum(2) <= up) & (np.maximum(-d, 0).sum(2) <= down)
        assert not (within & ~seen).any()
        assert up + down < 2 or seen.mean() < 0.9


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(c.execute(f"SELECT word, form, root, n, n_near, form_n FROM ({ORACLES['op12_spelling']})").fetchall())
    rows = got(QUERIES["op12_spelling"](spark, sf))
    assert rows == want and len(rows) > 100
