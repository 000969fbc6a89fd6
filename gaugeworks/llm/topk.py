"""Exact top-k inner products by dual-tree search over cover trees.

The top level of the data's tree is common to all tasks: centres that lie far apart in a bounded sample, and with each the rows nearest to
it and their exact covering radius. A part with more rows than a block is dealt out to several blocks. Each query first searches
the part whose centre promises most, which gives it a worst kth score to start from, and then meets only those other parts whose
ball can hold a product that reaches this score. Queries and a block of data that meet are one cell of work.

In a cell both sides are indexed by a cover tree: a node has a centre and the exact covering radius of its members. Its
children are centres taken from the farthest point on until they cover with half the radius, or there are ``CHILDREN`` of them or enough to fill leaves by half; what they then
cover with is the radius of that level, and no two of them are nearer than it. Small nodes, and nodes whose points do not come apart, are
leaves. Pairs of nodes are visited from the most promising on, and a pair is dropped when no inner product between the two balls can reach the
worst kth score in the query node. Each cell hands on at most k rows per query; the best k of those are the result.

Of equal vectors only the k + 1 smallest ids can be in any result, so the others are left out before rows are dealt.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without an id;
rows with the query's own id are not its candidates; equal rows count once; vectors are compared with those of the same length only;
a query with fewer than k candidates gets all of them; ties go to the smaller id; an empty table gives an empty result; other
columns are ignored. Scores are exact while they stay below 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import embeddings, keep

#: Rows of a block, about.
BLOCK = 8192
#: Members of a leaf of data and of queries, and children of a node, at most.
LEAF, QUERY_LEAF, CHILDREN = 64, 16, 32
#: Rows from which the common centres are taken, and how many there are of each dimension, at most.
SAMPLE, PARTS = 2048, 128
#: Copies of queries that are handed on at once.
VISITS = 8192
RESULT = "query_id bigint, vec_id bigint, score bigint"


class Node:
    __slots__ = ("centre", "norm", "radius", "members", "children")

    def __init__(self, centre: np.ndarray, radius: float, members: np.ndarray, children: list[Node]):
        self.centre, self.radius, self.members, self.children = centre, radius, members, children
        self.norm = float(np.sqrt(centre @ centre))


def cover_tree(points: np.ndarray, members: np.ndarray | None = None, centre: int = 0, leaf: int = LEAF) -> Node:
    """Cover tree of ``points[members]`` around ``points[centre]``, radii as they really are."""
    members = np.arange(len(points)) if members is None else members
    own = points[members]
    squares = np.einsum("ij,ij->i", own, own)

    def distances(c: int) -> np.ndarray:
        d = np.sqrt(np.maximum(squares + points[c] @ points[c] - 2 * (own @ points[c]), 0))
        return np.where(members == c, 0.0, d)

    apart = distances(centre)
    node = Node(points[centre], float(apart.max()), members, [])
    if len(members) <= leaf or node.radius == 0:
        return node
    reach, centres, nearest, owner = node.radius / 2, [centre], apart, np.zeros(len(members), np.int64)
    most = min(CHILDREN, -(-2 * len(members) // leaf))  # no more than would fill leaves by half
    while len(centres) < most:
        far = int(nearest.argmax())  # farthest point: centres are more than the new radius apart
        if nearest[far] <= reach:
            break
        centres.append(int(members[far]))
        d = distances(centres[-1])
        closer = d < nearest
        nearest, owner = np.where(closer, d, nearest), np.where(closer, len(centres) - 1, owner)
    parts = [(c, members[owner == i]) for i, c in enumerate(centres)]
    if len(parts) == 1 or max(len(m) for _, m in parts) > 0.9 * len(members):
        return node  # the points do not come apart
    node.children = [cover_tree(points, m, c, leaf) for c, m in parts if len(m)]
    return node


class Search:
    """The best k of one block of data for each of some queries, as far as they reach the query's ``floor``."""

    def __init__(self, query_ids, queries, ids, data, k: int, floor: np.ndarray | None = None):
        self.floor = np.full(len(queries), -np.inf) if floor is None else floor
        self.query_ids, self.queries, self.ids, self.data, self.k = query_ids, queries, ids, data, k
        self.norms = np.sqrt((queries ** 2).sum(1)) if len(queries) else np.zeros(0)
        self.compared = 0
        self.scores = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)

    def bound(self, q: Node, r: Node) -> float:
        """No inner product between the two balls is larger; rounded up."""
        top = float(q.centre @ r.centre) + r.radius * q.norm + q.radius * r.norm + q.radius * r.radius
        return top + 1e-9 * (abs(top) + q.norm * r.norm + 1)

    def worst(self, q: Node) -> float:
        return float(self.least(q.members).min())

    def least(self, rows: np.ndarray) -> np.ndarray:
        """The score that a further row must reach for each of these queries."""
        return np.maximum(self.scores[rows, -1], self.floor[rows])

    def compare(self, q: Node, r: Node) -> None:
        rows, columns = q.members, r.members
        top = self.queries[rows] @ r.centre + r.radius * self.norms[rows]  # the leaf's queries one by one
        rows = rows[top + 1e-9 * (np.abs(top) + self.norms[rows] * r.norm + 1) >= self.least(rows)]
        if not len(rows):
            return
        self.compared += len(rows) * len(columns)
        for at in range(0, len(columns), 4096):
            some = columns[at:at + 4096]
            s = self.queries[rows] @ self.data[some].T
            s[self.query_ids[rows][:, None] == self.ids[some][None, :]] = -np.inf
            at_row, at_column = np.nonzero((s >= self.least(rows)[:, None]) & np.isfinite(s))
            if not len(at_row):
                continue
            mine = np.unique(at_row)
            row = np.concatenate([np.repeat(mine, self.k), at_row])
            score = np.concatenate([self.scores[rows[mine]].ravel(), s[at_row, at_column]])
            ids = np.concatenate([self.found[rows[mine]].ravel(), self.ids[some][at_column]])
            order = np.lexsort((ids, -score, row))
            first = np.searchsorted(row[order], mine)
            best = order[first[:, None] + np.arange(self.k)]  # k old ones at least are there
            self.scores[rows[mine]], self.found[rows[mine]] = score[best], ids[best]

    def run(self) -> None:
        if not len(self.queries) or not len(self.data):
            return
        todo = [(np.inf, cover_tree(self.queries, leaf=QUERY_LEAF), cover_tree(self.data))]
        while todo:
            bound, q, r = todo.pop()
            if bound < self.worst(q):
                continue
            if not q.children and not r.children:
                self.compare(q, r)
                continue
            wide = bool(q.children) and (not r.children or q.radius >= r.radius)
            pairs = [(c, r) for c in q.children] if wide else [(q, c) for c in r.children]
            todo += sorted(((self.bound(a, b), a, b) for a, b in pairs), key=lambda x: x[0])  # the best is taken next


def _cell(table: pa.Table, k: int) -> pa.Table:
    """Search one cell; ``away`` is 0 for data and 1 for queries."""
    asks = table.column("away").to_numpy() == 1
    ids = table.column("vec_id").to_numpy()
    flat = table.column("v").combine_chunks().flatten().to_numpy().astype(np.float64)
    vectors = flat.reshape(len(ids), -1)
    search = Search(ids[asks], vectors[asks], ids[~asks], vectors[~asks], k, table.column("floor").to_numpy()[asks])
    search.run()
    hit = np.isfinite(search.scores)
    query = np.broadcast_to(search.query_ids[:, None], hit.shape)[hit]
    return pa.table({"query_id": query, "vec_id": search.found[hit], "score": search.scores[hit].astype(np.int64)})


def vectors_of(table: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v (whole components) and dim of the rows that take part."""
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(F.col("embedding"), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return table.filter(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"), F.size("embedding").alias("dim"))


def far_apart(points: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` different points, each the farthest one from those before."""
    chosen, nearest = [0], np.full(len(points), np.inf)
    while len(chosen) < most:
        nearest = np.minimum(nearest, ((points - points[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(nearest.argmax()))
        if nearest[chosen[-1]] == 0:
            chosen.pop()
            break
    return points[chosen]


class Part(NamedTuple):
    """Common parts of the vectors of one dimension; arrays run over the centres."""

    centres: np.ndarray
    radius: np.ndarray
    lots: np.ndarray


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        some = batch.filter(pa.array(dims == dim))
        yield dim, some, some.column("v").flatten().to_numpy().astype(np.float64).reshape(-1, dim)


def _placed(batches: Iterator[pa.RecordBatch], centres: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The nearest centre of each vector, and how far it is."""
    for batch in batches:
        for dim, some, x in _by_dim(batch):
            c = centres.get(dim, np.zeros((1, dim)))
            part = ((c ** 2).sum(1) - 2 * (x @ c.T)).argmin(1)
            far = np.sqrt(((x - c[part]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([some.column("dim"), pa.array(part.astype(np.int32)), pa.array(far), some.column("vec_id"), some.column("v")],
                                             names=["dim", "part", "far", "vec_id", "v"])


def _visits(batches: Iterator[pa.RecordBatch], parts: dict[int, Part], first: bool) -> Iterator[pa.RecordBatch]:
    """The most promising part of each query, or all others that can hold a product that reaches its floor."""
    for batch in batches:
        for dim, some, q in _by_dim(batch):
            if dim not in parts:
                continue
            p = parts[dim]
            middle, norm = q @ p.centres.T, np.sqrt((q ** 2).sum(1))[:, None]
            home = np.where(p.lots > 0, middle, -np.inf).argmax(1)
            top = middle + norm * p.radius
            wanted = (top + 1e-9 * (np.abs(top) + norm * np.sqrt((p.centres ** 2).sum(1)) + 1) >= some.column("floor").to_numpy()[:, None]) & (p.lots > 0)
            own = np.arange(len(p.lots)) == home[:, None]
            row, part = np.nonzero(own if first else wanted & ~own)
            times = p.lots[part]
            lot = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            for at in range(0, len(lot), VISITS):  # a query is copied to every block that it meets
                to = slice(at, at + VISITS)
                copies = some.take(pa.array(np.repeat(row, times)[to]))
                yield pa.RecordBatch.from_arrays(
                    [copies.column("dim"), pa.array(np.repeat(part, times)[to].astype(np.int32)), pa.array(lot[to].astype(np.int32)), copies.column("crew"),
                     copies.column("floor"), copies.column("vec_id"), copies.column("v")], names=["dim", "part", "lot", "crew", "floor", "vec_id", "v"])


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, most_parts: int = PARTS) -> DataFrame:
    """query_id, rank, vec_id and score of the k best of ``vectors`` for each of ``queries`` (both: vec_id, v, dim)."""
    most_parts = min(most_parts, max(1, -(-8 * vectors.count() // block)))  # an eighth of a block to a part, about
    drawn = vectors.select("dim", "v").orderBy(F.xxhash64("vec_id")).limit(SAMPLE).collect()  # bounded: SAMPLE rows
    centres = {dim: far_apart(np.array([r.v for r in drawn if r.dim == dim], np.float64), most_parts) for dim in {r.dim for r in drawn}}
    copies = Window.partitionBy("v").orderBy("vec_id")
    candidates = vectors.distinct().withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).select("dim", "vec_id", "v")
    data = keep(candidates.mapInArrow(partial(_placed, centres=centres), "dim int, part int, far double, vec_id bigint, v array<bigint>"))
    parts = {}
    for r in data.groupBy("dim", "part").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():  # most_parts rows for each dimension
        c = centres.get(r.dim, np.zeros((1, r.dim)))
        p = parts.setdefault(r.dim, Part(c, np.zeros(len(c)), np.zeros(len(c), np.int64)))
        p.radius[r.part], p.lots[r.part] = r.far, -(-r.n // block)
    lots = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for d, p in parts.items() for i, n in enumerate(p.lots.tolist()) if n > 1 for x in (f"{d} {i}", n))),
                                   F.concat_ws(" ", "dim", "part")), F.lit(1)) if any((p.lots > 1).any() for p in parts.values()) else F.lit(1)
    queries = queries.distinct()
    crews = max(1, -(-queries.count() // block))
    queries = queries.withColumn("crew", F.pmod(F.xxhash64("vec_id"), F.lit(crews)).cast("int"))
    blocks = data.select("dim", "part", F.pmod(F.xxhash64("vec_id"), lots).cast("int").alias("lot"), F.explode(F.sequence(F.lit(0), F.lit(crews - 1))).alias("crew"),
                         F.lit(0.0).alias("floor"), "vec_id", "v", F.lit(0).alias("away"))

    def cell(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _cell(table, k)

    def searched(asked: DataFrame, first: bool) -> DataFrame:
        fields = "dim int, part int, lot int, crew int, floor double, vec_id bigint, v array<bigint>"
        visits = asked.select("dim", "crew", "floor", "vec_id", "v").mapInArrow(partial(_visits, parts=parts, first=first), fields)
        return blocks.unionByName(visits.withColumn("away", F.lit(1))).groupBy("dim", "part", "lot", "crew").applyInArrow(cell, RESULT)

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")  # k rows per block that was met
    ranked = F.row_number().over(order)
    near = keep(searched(queries.withColumn("floor", F.lit(float("-inf"))), True).withColumn("rank", ranked).filter(F.col("rank") <= k).drop("rank"))
    floors = near.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count(F.lit(1)) == k, F.min("score").cast("double")).alias("floor"))
    asked = queries.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    found = near.unionByName(searched(asked, False))
    return found.withColumn("rank", ranked).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = vectors_of(embeddings(spark, sf_dir))
    return top_products(vectors, vectors.filter("vec_id % 50 = 0"))


OP7_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, e.vec_id, CAST(list_dot_product(q.v, e.v) AS BIGINT) AS score
  FROM e AS q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""
