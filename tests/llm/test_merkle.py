"""Operator 13 against a tree built by hand."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewater.llm import merkle
from tidewater.llm.queries import ORACLES, QUERIES

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree string, pos string, node string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r, text):
    fields = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def reduced(level):
    """All levels of a tree, from the lowest to the root."""
    out = [level]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def way(levels, at):
    """(before, after) of the run of each ancestor."""
    for low in levels[:-1]:
        first = at // 3 * 3
        yield "".join(low[first:at]), "".join(low[at + 1 : first + 3])
        at //= 3


def brute(rows):
    """The contract's rows; equal rows in either order."""
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, members = [], []
    for s in sources:
        own = sorted((r for r in rows if r["source"] == s), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        members.append(own)
        trees.append(reduced([leaf(r, r["text"]) for r in own]))
    top = reduced([t[-1][0] for t in trees])
    out = []
    for n, (own, tree) in enumerate(zip(members, trees, strict=True)):
        for i, r in enumerate(own):
            path = [*way(tree, i), *way(top, n)]
            text = r["text"]
            if r["doc_id"] is not None and text is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf(r, text)
            for a, b in path:
                node = sha(a + node + b)
            out.append((r["doc_id"], leaf(r, r["text"]), tree[-1][0], top[-1][0], sha("".join(a + b for a, b in path)), node, node == top[-1][0]))
    return sorted(out, key=str)


def given(spark, rows):
    return spark.createDataFrame([(*[r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")], "x", "y", "z") for r in rows], DOCS)


def row(i, text, source, lang="en", n=None):
    return {"doc_id": i, "text": text, "lang": lang, "source": source, "n_chars": n}


def got(df):
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_against_brute_force(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "ROWS", 40)
    rows = [row(i, f"line {i}\nand\n" * (i % 4), "hot", n=i) for i in range(100)]
    rows += [row(1000 + i, None if i % 3 else f"a\n{i}", f"s{i}", None) for i in range(12)]
    rows += [row(5, "no break", None), row(None, "a\nb", "hot"), row(2**53 + 1, "big\n", "hot"), row(7, "", "ñ\U0001f389"), row(8, "word\n" * 5000, "Z")]
    rows += [row(77, "same\n", "rep")] * 5
    assert got(merkle.manifest(given(spark, rows).repartition(3))) == brute(rows)


def test_sizes_around_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    for n in (1, 4, 9, 28):
        rows = [row(i, f"{i}\n", "s") for i in range(n)]
        assert got(merkle.manifest(given(spark, rows))) == brute(rows), n


def test_versions_share_all_but_ancestors(spark):
    """A version's own nodes and its siblings give its root; where the text is not altered they are the original's."""
    rows = [row(i, f"{i}\n", "s" if i % 4 else "t") for i in range(40)]
    out = merkle.versions(given(spark, rows), F.when(F.col("doc_id") == 3, F.lit("other")).otherwise(F.col("text"))).collect()
    for r in out:
        assert (r.nodes[0] == r.leaf) == (r.doc_id != 3) == (r.nodes[-1] == r.root)
        assert r.subroot in r.nodes or r.doc_id == 3
        assert not set(r.proof) & set(r.nodes)
    assert len({r.root for r in out}) == 1


def test_empty(spark):
    assert merkle.manifest(given(spark, [])).collect() == []


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cols = "doc_id, leaf, subroot, root, proof_sha256, folded_root, verified"
    want = sorted(c.execute(f"SELECT {cols} FROM ({ORACLES['op13_merkle']})").fetchall(), key=str)
    assert got(QUERIES["op13_merkle"](spark, sf)) == want and len(want) == 200
