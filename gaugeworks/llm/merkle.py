"""Merkle manifest of a data set: one hash tree per language, and one over the languages' roots.

Every row is hashed once by Spark's own functions and stored as a narrow row. Leaves get their places by one range
partitioning and a prefix sum over the parts, so that a language with a third of all rows is spread like the rest. A superblock
is a run of ``1 << BLOCK_BITS`` places. Going up, each superblock is reduced to its node; these nodes are the leaves of the
next layer, until each language is one node. Going down, leaves and the outer nodes they need (siblings above the superblock,
subroot, root) are cogrouped by superblock, and one call of applyInPandas finishes the local reduction, joins both halves of each
proof and folds the claimed leaf up to the root. A group never holds more than one superblock.

A digest is the lowercase hex SHA-256 of its concatenated inputs. Proof steps are written as text: ``l`` or ``r`` (sibling left or
right) and the sibling, or ``-`` where a run has one node.

Defined cases: a null is the field ``-``; leaves go by doc_id, null first, then by digest, so rows repeated in full are leaves of their
own with equal digests, and each has its own proof; a row without a doc_id is never tampered with, and a null n_chars stays null;
empty and very long texts are fields like any other; an empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import documents, keep, parts_of

#: log2 of the leaves of a superblock.
BLOCK_BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a table that may go to every task.
FEW = 100_000
#: doc_id travels as text, since pandas would make floating numbers of ids where one is null.
MANIFEST = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
#: What a node needs from above: its path there, and what the path leads to.
OUTER = "tree string, block bigint, path array<string>, subroot string, root string"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(n_chars: Column | None = None) -> Column:
    """Digest of a row, with another n_chars if given."""
    return F.sha2(F.concat(*(field(F.col(c) if c != "n_chars" or n_chars is None else n_chars) for c in FIELDS)), 256)


def is_tampered() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """One stored row per document: tree (language, null first in order), doc_id, digest, claimed (digest after tampering, else null), row."""
    tree = F.coalesce(F.concat(F.lit("x"), F.col("lang").cast("string")), F.lit(""))
    claimed = F.when(is_tampered(), leaf_digest(F.try_add(F.col("n_chars"), F.lit(1))))
    return keep(docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest().alias("digest"), claimed.alias("claimed"),
                            F.xxhash64(F.monotonically_increasing_id()).alias("row")))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (a stored table) with place, the number of a row within its tree from 0 on, and count, the rows of the tree; stored.

    Rows are parted by ranges of (tree, order), sorted and numbered part by part; the numbers of the parts before are added.
    """
    parts = rows.repartitionByRange(parts_of(rows.sparkSession), "tree", *order).sortWithinPartitions("tree", *order)
    numbered = keep(parts.withColumn("_at", F.monotonically_increasing_id()))  # part << 33 | number within the part
    part = F.shiftright("_at", 33)
    stats = numbered.groupBy("tree", part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    whole, before = Window.partitionBy("tree"), Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    stats = keep(stats.select("tree", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("count")))
    if stats.count() <= FEW:  # a row per part and tree
        stats = F.broadcast(stats)
    joined = numbered.withColumn("_part", part).join(stats, ["tree", "_part"])
    return keep(joined.select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("place"), "count"))


def reduced(nodes: list[str], levels: int | None) -> list[list[str]]:
    """All levels over ``nodes``, ``levels`` of them; None: until one node is left."""
    out = [nodes]
    while len(out) - 1 < levels if levels is not None else len(out[-1]) > 1:
        last = out[-1]
        out.append([digest(*last[i:i + 2]) for i in range(0, len(last), 2)])
    return out


def levels_of(count: int, bits: int) -> int | None:
    """Levels of a superblock in a tree of ``count`` nodes: a tree that goes on above is always reduced in full."""
    return bits if count > 1 << bits else None


def paths(levels: list[list[str]]) -> list[list[str]]:
    """Proof steps of each node of the lowest level up to the highest."""
    out = []
    for i in range(len(levels[0])):
        steps = []
        for nodes in levels[:-1]:
            other = i ^ 1
            steps.append("-" if other >= len(nodes) else ("l" if other < i else "r") + nodes[other])
            i >>= 1
        out.append(steps)
    return out


def fold(leaf: str, steps: list[str]) -> str:
    """The root that a leaf and its proof lead to."""
    for step in steps:
        leaf = digest(step[1:], leaf) if step[0] == "l" else digest(leaf, step[1:])
    return leaf


def _top(rows: pd.DataFrame, bits: int) -> pd.DataFrame:
    """The node of one superblock."""
    rows = rows.sort_values("place")
    top = reduced(rows["digest"].tolist(), levels_of(int(rows["count"].iloc[0]), bits))[-1][0]
    return pd.DataFrame({"tree": [rows["tree"].iloc[0]], "place": [rows["block"].iloc[0]], "digest": [top], "count": [((int(rows["count"].iloc[0]) - 1) >> bits) + 1]})


def _joined(own: pd.DataFrame, outer: pd.DataFrame, bits: int):
    """Places' rows of one superblock in order, their whole proofs, subroot and root."""
    own = own.sort_values("place")
    levels = reduced(own["digest"].tolist(), levels_of(int(own["count"].iloc[0]), bits))
    above = outer.iloc[0]
    return own, [steps + list(above["path"]) for steps in paths(levels)], above["subroot"], above["root"]


def _descend(own: pd.DataFrame, outer: pd.DataFrame, bits: int) -> pd.DataFrame:
    """Outer rows for the superblocks below: each node here is one of them."""
    own, proofs, subroot, root = _joined(own, outer, bits)
    return pd.DataFrame({"tree": own["tree"], "block": own["place"], "path": proofs, "subroot": subroot, "root": root})


def _finish(own: pd.DataFrame, outer: pd.DataFrame, bits: int) -> pd.DataFrame:
    own, proofs, subroot, root = _joined(own, outer, bits)
    starts = own["claimed"].where(own["claimed"].notna(), own["digest"])
    folded = [fold(leaf, steps) for leaf, steps in zip(starts, proofs, strict=True)]
    return pd.DataFrame({
        "doc_id": own["doc_id"], "leaf": own["digest"], "subroot": subroot, "root": root,
        "proof_sha256": [digest(*(s[1:] for s in steps)) for steps in proofs], "folded_root": folded, "verified": [f == root for f in folded]})


def _blocks(nodes: DataFrame, bits: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("place", bits))


def _cogrouped(nodes: DataFrame, outer: DataFrame, finish, bits: int, schema: str) -> DataFrame:
    sides = _blocks(nodes, bits).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
    return sides.applyInPandas(lambda own, above: finish(own, above, bits) if len(own) else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")]), schema)


def layers(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """Stored nodes (tree, place, digest, count) of each layer, the last with one node per tree."""
    out = [nodes]
    most = nodes.agg(F.max("count")).first()[0] or 0
    while most > 1:
        tops = _blocks(out[-1], bits).groupBy("tree", "block").applyInPandas(lambda rows: _top(rows, bits), "tree string, place bigint, digest string, count bigint")
        out.append(keep(tops))
        most = (most - 1 >> bits) + 1
    return out


def manifest(docs: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for every row of ``docs`` (doc_id, source, lang, n_chars, text)."""
    own = layers(placed(leaves(docs), ["doc_id", "digest", "row"]), bits)
    # the languages' roots are one more tree, in the order of the languages
    subroots = keep(own[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest", "place"))
    over = layers(placed(subroots.drop("place"), ["of"]), bits)
    top = over[-1].select("tree", F.lit(0).cast("long").alias("block"), F.array().cast("array<string>").alias("path"),
                          F.lit("").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(over[:-1]):
        top = keep(_cogrouped(nodes, top, _descend, bits, OUTER))
    named = over[0].select("place", F.col("of").alias("tree"), F.col("digest").alias("subroot"))
    outer = named.join(top.select(F.col("block").alias("place"), "path", "root"), "place").select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot", "root")
    for nodes in reversed(own[1:-1]):
        outer = keep(_cogrouped(nodes, outer, _descend, bits, OUTER))
    rows = own[0].withColumn("doc_id", F.col("doc_id").cast("string"))
    return _cogrouped(rows, outer, _finish, bits, MANIFEST).withColumn("doc_id", F.col("doc_id").cast("long"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(documents(spark, sf_dir))


def _nibbles() -> str:
    """The CRC-32 of each value of four bits, from its reflected polynomial."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(str(c))
    return f"[{', '.join(table)}]::BIGINT[]"


OP11_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('x' || lang, '') AS tree, n_chars,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail,
         list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b:
           xor(xor(xor(c, b) >> 4, ({_nibbles()})[(xor(c, b) & 15) + 1]) >> 4,
               ({_nibbles()})[(xor(xor(c, b) >> 4, ({_nibbles()})[(xor(c, b) & 15) + 1]) & 15) + 1]), 4294967295::BIGINT) AS crc
  FROM documents),
leaf AS (
  SELECT doc_id, tree, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS h,
         CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS claimed
  FROM d),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaf),
up AS (
  SELECT 0 AS lvl, tree, pos, h, n FROM placed
  UNION ALL
  SELECT lvl + 1, tree, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY lvl, tree, pos // 2, n),
sub AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
over_up AS (
  SELECT 0 AS lvl, pos, h, n FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM over_up WHERE n > 1 GROUP BY lvl, pos // 2, n),
steps AS (
  SELECT p.tree, p.pos, u.lvl, CASE WHEN s.h IS NULL THEN '-' WHEN s.pos < p.pos >> u.lvl THEN 'l' || s.h ELSE 'r' || s.h END AS step
  FROM placed p JOIN up u ON u.tree = p.tree AND u.pos = p.pos >> u.lvl AND u.n > 1
  LEFT JOIN up s ON s.tree = u.tree AND s.lvl = u.lvl AND s.pos = xor(u.pos, 1)),
over_steps AS (
  SELECT p.tree, u.lvl, CASE WHEN s.h IS NULL THEN '-' WHEN s.pos < p.pos >> u.lvl THEN 'l' || s.h ELSE 'r' || s.h END AS step
  FROM sub p JOIN over_up u ON u.pos = p.pos >> u.lvl AND u.n > 1 LEFT JOIN over_up s ON s.lvl = u.lvl AND s.pos = xor(u.pos, 1)),
inner_path AS (SELECT tree, pos, list(step ORDER BY lvl) AS path FROM steps GROUP BY tree, pos),
outer_path AS (SELECT tree, list(step ORDER BY lvl) AS path FROM over_steps GROUP BY tree),
proof AS (
  SELECT p.*, s.h AS subroot, (SELECT h FROM over_up WHERE n = 1) AS root, list_concat(coalesce(i.path, []), coalesce(o.path, [])) AS path
  FROM placed p JOIN sub s USING (tree) LEFT JOIN inner_path i ON i.tree = p.tree AND i.pos = p.pos LEFT JOIN outer_path o ON o.tree = p.tree),
folded AS (
  SELECT *, sha256(coalesce(array_to_string(list_transform(path, lambda x: x[2:]), ''), '')) AS proof_sha256,
         list_reduce(path, lambda a, x: sha256(CASE WHEN x[1] = 'l' THEN x[2:] || a ELSE a || x[2:] END), coalesce(claimed, h)) AS folded_root
  FROM proof)
SELECT doc_id, h AS leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
