"""Operator 13: a Merkle manifest of a dataset, with versions by path copying.

Tree. Rows are the leaves; those of a source stand by rising doc_id. While several nodes of a source remain, every
``FAN`` consecutive ones (the last run: fewer, even one) become their hash; what remains is the subroot. Subroots,
by source (null first, bytewise), are hashed to the root in the same way.

Blocks. Places come from a range sort and running counts of the ranges, so no task holds a source. ``FAN ** LEVELS``
(729) consecutive nodes form an aligned block, which one group of a Python task builds whole; the roots of the blocks
are the nodes of the next layer, which is built in the same way until each tree has one node. A node's path (its
siblings, level by level) is put together downwards: its siblings within its block, then the path of the block.

Versions. The tree is persistent: a changed leaf makes a version that shares all nodes with the original but for
the ancestors of the leaf. These are copied within the block, from the copied child and the shared siblings, and the
version goes on above the block along the path of the block's root. ``versions`` gives these nodes for each row.

Defined cases: null fields are part of a leaf as ``-``; null texts are not altered; a null id stands first in its source and
is never altered by ``deleted_breaks``; repeated rows are leaves of their own, next to each other (which of two equal
rows is first does not show in the result); an empty table gives no rows; a source of one row has its leaf as
subroot, a table of one source its subroot as root; extra columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FAN, LEVELS = 3, 6
#: Rows of a range of the global order.
ROWS = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def _hash(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def _levels(total: int) -> int:
    """Levels of a block of a tree with so many nodes in its layer."""
    height = 0
    while FAN**height < min(total, FAN**LEVELS):
        height += 1
    return height


def grown(nodes: list[str], levels: int) -> list[list[str]]:
    """The levels of a block from its lowest nodes."""
    tree = [nodes]
    for _ in range(levels):
        low = tree[-1]
        tree.append([_hash(low[i : i + FAN]) for i in range(0, len(low), FAN)])
    return tree


def siblings(tree: list[list[str]], at: int) -> list[dict[str, str]]:
    """What stands left and right of node ``at`` and of its ancestors in their runs."""
    out = []
    for low in tree[:-1]:
        first = at - at % FAN
        out.append({"left": "".join(low[first:at]), "right": "".join(low[at + 1 : first + FAN])})
        at //= FAN
    return out


def _above(up: pd.DataFrame) -> list[dict[str, str]]:
    """The path of the block of a group."""
    return [{"left": s["left"], "right": s["right"]} for s in up.path.iat[0]]


def _single(path: list[dict[str, str]]) -> list[str]:
    """The digests of a path, one by one."""
    runs = [x for s in path for x in (s["left"], s["right"])]
    return [x[i : i + 64] for x in runs for i in range(0, len(x), 64)]


def copied(tree: list[list[str]], at: int, node: str) -> list[str]:
    """The nodes of their own of the version in which node ``at`` is another: it and its ancestors. All others are shared."""
    out = [node]
    for low in tree[:-1]:
        first = at - at % FAN
        run = low[first : first + FAN]
        run[at - first] = out[-1]
        out.append(_hash(run))
        at //= FAN
    return out


def digest(fields: list[Column]) -> Column:
    """Hash of fields: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def deleted_breaks() -> Column:
    """The text without line feeds where the unsigned CRC-32 of the decimal doc_id is even; else the text."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(F.coalesce(chosen, F.lit(False)), F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (a stored table, with column tree) with pos, the place within the tree from 0, and total."""
    ranges = max(1, -(-rows.count() // ROWS))
    spread = rows.repartitionByRange(ranges, "tree", *order).withColumn("part", F.spark_partition_id())
    spread = written(spread, "ranges")
    sums = spread.groupBy("tree", "part").agg(F.count("*").alias("n"))
    by_part = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "tree", "part", F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("tree")).alias("total"),
    )
    inside = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order))
    placed = spread.withColumn("inside", inside).join(sums.hint("merge"), ["tree", "part"])
    return placed.withColumn("pos", F.col("before") + F.col("inside") - 1).drop("part", "inside", "before")


def _block(pos: str = "pos") -> Column:
    return F.floor(F.col(pos) / FAN**LEVELS).cast("bigint").alias("block")


def block_roots(nodes: DataFrame) -> DataFrame:
    """The next layer (tree, pos, node, total) of nodes."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        total = int(pdf.total.iat[0])
        top = grown(pdf.node.tolist(), _levels(total))[-1][0]
        return pd.DataFrame({"tree": pdf.tree.iloc[:1], "pos": pdf.block.iloc[:1], "node": [top], "total": [-(-total // FAN**LEVELS)]})

    flat = nodes.select("tree", "pos", "node", "total", _block())
    return flat.groupBy("tree", "block").applyInPandas(build, "tree string, pos bigint, node string, total bigint")


def block_paths(nodes: DataFrame, most: int) -> DataFrame:
    """tree, block, path, top for each block of nodes: the siblings of its root up to the top of its tree.

    most: nodes of the largest tree.
    """
    roots = written(block_roots(nodes), "blocks")
    if most <= FAN**LEVELS:
        return roots.select("tree", F.col("pos").alias("block"), F.array().cast(PATH).alias("path"), F.col("node").alias("top"))
    above = written(block_paths(roots, -(-most // FAN**LEVELS)), "paths")

    def descend(pdf: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        tree = grown(pdf.node.tolist(), _levels(int(pdf.total.iat[0])))
        path, top = _above(up), up.top.iat[0]
        each = [siblings(tree, i) + path for i in range(len(pdf))]
        return pd.DataFrame({"tree": pdf.tree, "block": pdf.pos, "path": each, "top": top})

    flat = roots.select("tree", "pos", "node", "total", _block())
    return flat.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInPandas(
        descend, f"tree string, block bigint, path {PATH}, top string"
    )


def versions(docs: DataFrame, altered: Column) -> DataFrame:
    """doc_id, leaf, altered_leaf, subroot, root, proof, nodes for each row of docs.

    proof: the siblings of the leaf and of its ancestors up to the root, level by level, left to right. nodes: the
    nodes of its own of the version in which the row's text is ``altered``, from the leaf to the root.
    """
    other = altered.alias("__altered")
    fields = [F.col(c) for c in FIELDS]
    changed = [*fields[:-1], F.col("__altered")]
    cut = docs.select(*fields, other)
    leaf = digest(fields)
    leaves = written(
        cut.select(
            F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("+"), "source")).alias("tree"), "doc_id", leaf.alias("node"),
            F.when(F.col("__altered").eqNullSafe(F.col("text")), leaf).otherwise(digest(changed)).alias("other"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "leaves",
    )
    nodes = written(numbered(leaves, ["doc_id", "node", "row"]), "nodes")
    most = nodes.agg(F.max("total")).first()[0] or 0
    blocks = written(block_paths(nodes, most), "paths")
    tops = written(blocks.filter("block = 0").select(F.lit("all").alias("tree"), F.col("tree").alias("source"), F.col("top").alias("node")), "tops")
    sources = written(numbered(tops, ["source"]), "sources")
    high = block_paths(sources, tops.count())

    def finish(pdf: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        tree = grown(pdf.node.tolist(), _levels(int(pdf.total.iat[0])))
        path, top = _above(up), up.top.iat[0]
        each = [siblings(tree, i) + path for i in range(len(pdf))]
        return pd.DataFrame({"tree": pdf.source, "high": each, "root": top})

    top_paths = written(
        sources.select("tree", "source", "pos", "node", "total", _block()).groupBy("tree", "block").cogroup(high.groupBy("tree", "block")).applyInPandas(
            finish, f"tree string, high {PATH}, root string"
        ),
        "tops",
    )
    whole = blocks.join(top_paths.hint("merge"), "tree").select(
        "tree", "block", F.concat("path", "high").alias("path"), F.col("top").alias("subroot"), "root"
    )

    def version(pdf: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        tree = grown(pdf.node.tolist(), _levels(int(pdf.total.iat[0])))
        path = _above(up)
        rest = _single(path)
        proofs, nodes = [], []
        for at, node in enumerate(pdf.other):
            own = copied(tree, at, node)
            for s in path:
                own.append(_hash([s["left"], own[-1], s["right"]]))
            proofs.append(_single(siblings(tree, at)) + rest)
            nodes.append(own)
        return pd.DataFrame({
            "doc_id": pdf.doc_id, "leaf": pdf.node, "altered_leaf": pdf.other, "subroot": up.subroot.iat[0], "root": up.root.iat[0], "proof": proofs, "nodes": nodes,
        })

    text_id = F.col("doc_id").cast("string").alias("doc_id")  # pandas has no whole numbers with nulls
    flat = nodes.select("tree", text_id, "node", "other", "pos", "total", _block())
    out = flat.groupBy("tree", "block").cogroup(whole.groupBy("tree", "block")).applyInPandas(
        version, "doc_id string, leaf string, altered_leaf string, subroot string, root string, proof array<string>, nodes array<string>"
    )
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified after the deletion of line feeds in every other
    document (see deleted_breaks)."""
    folded = F.element_at("nodes", -1)
    return versions(docs, deleted_breaks()).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), folded.alias("folded_root"),
        (folded == F.col("root")).alias("verified"),
    )


def _field(x: str) -> str:
    return f"coalesce(concat(strlen(CAST({x} AS VARCHAR)), ':') || CAST({x} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return f"sha256(concat({', '.join(_field(x) for x in (*FIELDS[:-1], text))}))"


def _climb(nodes: str, up: str, ways: str) -> str:
    """All levels of the trees of ``nodes`` (tree, pos, h), and what stands left and right of each node."""
    return f"""
{up} AS (
  SELECT tree, 0 AS level, pos, h, count(*) OVER (PARTITION BY tree) AS many FROM {nodes}
  UNION ALL
  SELECT tree, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (many + 2) // 3 FROM {up} WHERE many > 1 GROUP BY tree, level, pos // 3, many),
{ways} AS (
  SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM {up} a JOIN {up} b ON a.tree = b.tree AND a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.many > 1 GROUP BY ALL)"""


#: The contract's tree level by level; CRC-32 by its table over the digits.
SQL = f"""
WITH RECURSIVE tbl AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i::BIGINT) AS c
    FROM range(256) r(i))),
crc AS (
  SELECT doc_id AS id, xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), tbl),
leaves AS (
  SELECT d.doc_id, CASE WHEN source IS NULL THEN '' ELSE concat('+', source) END AS tree, {_leaf("text")} AS leaf,
         CASE WHEN c.h % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS other
  FROM documents d LEFT JOIN crc c ON d.doc_id = c.id),
placed AS (SELECT *, leaf AS h, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
{_climb("placed", "up", "ways")},
subroots AS (SELECT 'all' AS tree, tree AS source, h, row_number() OVER (ORDER BY tree) - 1 AS pos FROM up WHERE many = 1),
{_climb("subroots", "up2", "ways2")},
walk AS (
  SELECT tree, pos AS leaf_pos, 0 AS level, pos, other AS h, '' AS proof FROM placed
  UNION ALL
  SELECT w.tree, leaf_pos, w.level + 1, w.pos // 3, sha256(concat(l, h, r)), concat(proof, l, r)
  FROM walk w JOIN ways s ON w.tree = s.tree AND w.level = s.level AND w.pos = s.pos),
tops AS (
  SELECT w.*, s.pos AS place FROM walk w JOIN up u ON w.tree = u.tree AND w.level = u.level AND u.many = 1 JOIN subroots s ON w.tree = s.source),
walk2 AS (
  SELECT tree, leaf_pos, 0 AS level, place AS pos, h, proof FROM tops
  UNION ALL
  SELECT w.tree, leaf_pos, w.level + 1, w.pos // 3, sha256(concat(l, h, r)), concat(proof, l, r)
  FROM walk2 w JOIN ways2 s ON w.level = s.level AND w.pos = s.pos),
ends AS (SELECT w.*, u.h AS root FROM walk2 w JOIN up2 u ON w.level = u.level AND u.many = 1)
SELECT p.doc_id, p.leaf, s.h AS subroot, e.root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = e.root AS verified
FROM placed p JOIN ends e ON p.tree = e.tree AND p.pos = e.leaf_pos JOIN subroots s ON p.tree = s.source
"""
