"""Near copies by the exact Jaccard similarity of word shingle sets, which the pipeline adds to its SimHash groups.

MinHash anchors only say which texts may be near: the minima of a set under 192 hashes are cut into 32 bands of six, and texts
that agree in a band meet at its anchor, so a pair at similarity 0.8 meets nowhere with probability (1 - 0.8^6)^32 = 6e-5 and
a nearer one more rarely. What is shuffled for that is (anchor, node) alone. Texts that meetings connect form a candidate set, and
within it the shingle sets decide: every member is compared with the first one, its pivot; members that are not near the pivot
are compared with all members. The pairs left out are near one and the same pivot, so the links found connect what all pairs
at or above the similarity connect, and no pair below it is ever linked.

A crowded candidate set is dealt out to several tasks. Sets are of 64-bit hashes; texts with equal sets are one node. The work
in a candidate set is its members times those not near the pivot.

Defined cases: a null or blank text has the empty set and is near others of that kind; with fewer words than a shingle the whole
sequence is the one shingle; a null doc_id may link others but stays itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import keep, parts_of, rows_per_task, texts, whole_text
from gaugeworks.llm.components import components, stars

SEED = 42
BANDS, EACH = 32, 6
#: Members of a candidate set that one task compares, and values of a set that are looked up at once.
LOT, SLICE = 512, 4096
#: Rows up to which candidates go to every task as a list.
FEW = 1_000_000

_draw = np.random.default_rng(SEED)
FLIPS, FACTORS = (_draw.integers(0, 1 << 64, BANDS * EACH, np.uint64, endpoint=False) | np.uint64(i) for i in (0, 1))


def shingles(text: bytes, words_each: int) -> np.ndarray:
    """The different XXH64 of all word shingles, sorted."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start, joined = (end - size).tolist(), b" ".join(words)
    end = end[min(words_each, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(start, end)], np.uint64))  # noqa: B905


def anchors(own: np.ndarray) -> np.ndarray:
    """One number for each band, equal where its minima are."""
    least = np.full(BANDS * EACH, np.iinfo(np.uint64).max)
    for at in range(0, len(own), SLICE):
        least = np.minimum(least, ((own[at:at + SLICE, None] ^ FLIPS) * FACTORS).min(0))
    mixed = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, EACH).T:
        mixed = (mixed ^ column) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def _sketches(batches: Iterator[pa.RecordBatch], words_each: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [shingles(t, words_each) for _, t in rows_per_task([batch], ("doc_id", "text"))]
        marks = [pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), seed) for s in own], np.uint64).astype(np.int64)) for seed in (0, 1)]
        met = np.array([anchors(s) for s in own], np.uint64).astype(np.int64).ravel()
        met = pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * BANDS, pa.array(met))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("line"), *marks, met], names=["doc_id", "line", "mark0", "mark1", "anchors"])


def _sets(batches: Iterator[pa.RecordBatch], words_each: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [shingles(t, words_each).astype(np.int64) for t in batch.column("text").to_pylist()]
        ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
        found = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *own])))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "root", "lots", "members")), found], names=["node", "root", "lots", "members", "own"])


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of all nodes at an anchor with its first one; rows come sorted by anchor."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, node = (batch.column(c).to_numpy() for c in ("anchor", "node"))
        start = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        first = node[np.flatnonzero(start)][np.cumsum(start) - 1]
        if last is not None and last[0] == anchor[0]:
            first[:np.argmin(anchor == anchor[0]) or len(anchor)] = last[1]
        last = anchor[-1], first[-1]
        other = node != first
        yield pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(first[other])], names=["a", "b"])


def near(shared, one, other):
    """Whether sets of sizes ``one`` and ``other`` with ``shared`` values in common have a similarity of 0.8 or more."""
    return shared * 9 >= (one + other) * 4


def _compare(table: pa.Table) -> pa.Table:
    """Links between the loose rows of a lot and its other rows."""
    table = table.combine_chunks()
    node, loose = table["node"].to_numpy(), table["loose"].to_numpy()
    own = table["own"].combine_chunks()
    own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
    values, size = own.flatten().to_numpy(), own.value_lengths().to_numpy().astype(np.int64)
    end = np.cumsum(size)
    home = np.flatnonzero(loose == 1)
    owner = np.repeat(np.arange(len(home)), size[home])
    held = np.concatenate([np.zeros(0, np.int64), *(values[end[i] - size[i]:end[i]] for i in home)])
    order = np.argsort(held, kind="stable")
    held, owner = held[order], owner[order]
    a, b = [], []
    for i in np.flatnonzero(loose == 0):
        shared = np.zeros(len(home), np.int64)
        for at in range(end[i] - size[i], end[i], SLICE):
            some = values[at:min(at + SLICE, end[i])]
            low, high = np.searchsorted(held, some), np.searchsorted(held, some, "right")
            each = high - low
            places = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(low, each)
            shared += np.bincount(owner[places], minlength=len(home))
        found = node[home[near(shared, size[home], size[i])]]
        a.append(found)
        b.append(np.full(len(found), node[i]))
    a, b = stars(np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def few(df: DataFrame) -> DataFrame:
    """``df``, a stored table, marked for broadcasting if it is small."""
    return F.broadcast(df) if df.count() <= FEW else df


def to_lots(n: str):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))


def dealt(n: str):
    return F.pmod(F.xxhash64("node"), F.col(n))


def near_links(docs: DataFrame, nodes: DataFrame, words_each: int) -> DataFrame:
    """Links (a, b) that connect what all pairs of ``nodes`` (stored: node, line, anchors) at a similarity of 0.8 or more connect."""
    spark = docs.sparkSession
    met = nodes.select("node", F.explode("anchors").alias("anchor")).repartition(parts_of(spark), "anchor").sortWithinPartitions("anchor")
    candidates = keep(components(met.mapInArrow(_meetings, "a bigint, b bigint")))
    size = candidates.groupBy("root").agg(F.count(F.lit(1)).alias("members")).withColumn("lots", F.ceil(F.col("members") / LOT))
    wanted = keep(candidates.join(nodes.select("node", "line"), "node").join(size, "root"))
    lines = texts(docs, line_of().alias("line")).join(few(wanted), "line").select("node", "root", "lots", "members", "text")
    schema = "node bigint, root bigint, lots bigint, members bigint, own array<bigint>"
    members = keep(lines.mapInArrow(partial(_sets, words_each=words_each), schema).dropDuplicates(["node"]))
    pivots = members.filter("node = root").select("root", F.col("own").alias("first"), to_lots("lots").alias("lot"))
    beside = members.filter("node <> root").withColumn("lot", dealt("lots")).join(pivots, ["root", "lot"])
    shared = F.size(F.array_intersect("own", "first"))
    judged = keep(beside.select("node", "root", "members", near(shared, F.size("own"), F.size("first")).alias("near")))
    loose = judged.filter("not near and members > 2")
    crowd = loose.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / LOT).alias("homes"))
    rest = members.filter("node <> root").join(few(keep(crowd)), "root")  # a row per crowded set
    homes = rest.join(loose.select("node"), "node").select("root", "node", "own", F.lit(1).alias("loose"), dealt("homes").alias("home"), to_lots("lots").alias("lot"))
    visitors = rest.select("root", "node", "own", F.lit(0).alias("loose"), to_lots("homes").alias("home"), dealt("lots").alias("lot"))
    found = homes.unionByName(visitors).groupBy("root", "home", "lot").applyInArrow(_compare, "a bigint, b bigint")
    return judged.filter("near").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found)


def line_of():
    """A number of a row by its doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), whole_text())


def near_groups(docs: DataFrame, words_each: int) -> DataFrame:
    """doc_id and component_id (smallest doc_id that links lead to) of every row of ``docs``."""
    schema = "doc_id bigint, line bigint, mark0 bigint, mark1 bigint, anchors array<bigint>"
    own = keep(texts(docs, line_of().alias("line")).mapInArrow(partial(_sketches, words_each=words_each), schema))
    same = own.groupBy("mark0", "mark1").agg(F.min("doc_id").alias("first_id"), F.min("line").alias("line"), F.first("anchors").alias("anchors"))
    nodes = keep(same.withColumn("node", F.monotonically_increasing_id()))
    roots = keep(components(near_links(docs, nodes, words_each)))
    named = nodes.select("mark0", "mark1", "node", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return own.select("doc_id", "mark0", "mark1").join(named.join(smallest, "root"), ["mark0", "mark1"]).select("doc_id", "component_id")


def shingles(text: bytes, words_each: int) -> np.ndarray:
    """The different XXH64 of all word shingles, sorted."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start, joined = (end - size).tolist(), b" ".join(words)
    end = end[min(words_each, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(start, end)], np.uint64))  # noqa: B905


def anchors(own: np.ndarray) -> np.ndarray:
    """One number for each band, equal where its minima are."""
    least = np.full(BANDS * EACH, np.iinfo(np.uint64).max)
    for at in range(0, len(own), SLICE):
        least = np.minimum(least, ((own[at:at + SLICE, None] ^ FLIPS) * FACTORS).min(0))
    mixed = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, EACH).T:
        mixed = (mixed ^ column) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def _sketches(batches: Iterator[pa.RecordBatch], words_each: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [shingles(t, words_each) for _, t in rows_per_task([batch], ("doc_id", "text"))]
        marks = [pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), seed) for s in own], np.uint64).astype(np.int64)) for seed in (0, 1)]
        met = np.array([anchors(s) for s in own], np.uint64).astype(np.int64).ravel()
        met = pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * BANDS, pa.array(met))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("line"), *marks, met], names=["doc_id", "line", "mark0", "mark1", "anchors"])


def _sets(batches: Iterator[pa.RecordBatch], words_each: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [shingles(t, words_each).astype(np.int64) for t in batch.column("text").to_pylist()]
        ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
        found = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *own])))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "root", "lots", "members")), found], names=["node", "root", "lots", "members", "own"])


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of all nodes at an anchor with its first one; rows come sorted by anchor."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, node = (batch.column(c).to_numpy() for c in ("anchor", "node"))
        start = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        first = node[np.flatnonzero(start)][np.cumsum(start) - 1]
        if last is not None and last[0] == anchor[0]:
            first[:np.argmin(anchor == anchor[0]) or len(anchor)] = last[1]
        last = anchor[-1], first[-1]
        other = node != first
        yield pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(first[other])], names=["a", "b"])


def near(shared, one, other):
    """Whether sets of sizes ``one`` and ``other`` with ``shared`` values in common have a similarity of 0.8 or more."""
    return shared * 9 >= (one + other) * 4


def _compare(table: pa.Table) -> pa.Table:
    """Links between the loose rows of a lot and its other rows."""
    table = table.combine_chunks()
    node, loose = table["node"].to_numpy(), table["loose"].to_numpy()
    own = table["own"].combine_chunks()
    own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
    values, size = own.flatten().to_numpy(), own.value_lengths().to_numpy().astype(np.int64)
    end = np.cumsum(size)
    home = np.flatnonzero(loose == 1)
    owner = np.repeat(np.arange(len(home)), size[home])
    held = np.concatenate([np.zeros(0, np.int64), *(values[end[i] - size[i]:end[i]] for i in home)])
    order = np.argsort(held, kind="stable")
    held, owner = held[order], owner[order]
    a, b = [], []
    for i in np.flatnonzero(loose == 0):
        shared = np.zeros(len(home), np.int64)
        for at in range(end[i] - size[i], end[i], SLICE):
            some = values[at:min(at + SLICE, end[i])]
            low, high = np.searchsorted(held, some), np.searchsorted(held, some, "right")
            each = high - low
            places = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(low, each)
            shared += np.bincount(owner[places], minlength=len(home))
        found = node[home[near(shared, size[home], size[i])]]
        a.append(found)
        b.append(np.full(len(found), node[i]))
    a, b = stars(np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def few(df: DataFrame) -> DataFrame:
    """``df``, a stored table, marked for broadcasting if it is small."""
    return F.broadcast(df) if df.count() <= FEW else df


def to_lots(n: str):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))


def dealt(n: str):
    return F.pmod(F.xxhash64("node"), F.col(n))


def near_links(docs: DataFrame, nodes: DataFrame, words_each: int) -> DataFrame:
    """Links (a, b) that connect what all pairs of ``nodes`` (stored: node, line, anchors) at a similarity of 0.8 or more connect."""
    spark = docs.sparkSession
    met = nodes.select("node", F.explode("anchors").alias("anchor")).repartition(parts_of(spark), "anchor").sortWithinPartitions("anchor")
    candidates = keep(components(met.mapInArrow(_meetings, "a bigint, b bigint")))
    size = candidates.groupBy("root").agg(F.count(F.lit(1)).alias("members")).withColumn("lots", F.ceil(F.col("members") / LOT))
    wanted = keep(candidates.join(nodes.select("node", "line"), "node").join(size, "root"))
    lines = texts(docs, line_of().alias("line")).join(few(wanted), "line").select("node", "root", "lots", "members", "text")
    schema = "node bigint, root bigint, lots bigint, members bigint, own array<bigint>"
    members = keep(lines.mapInArrow(partial(_sets, words_each=words_each), schema).dropDuplicates(["node"]))
    pivots = members.filter("node = root").select("root", F.col("own").alias("first"), to_lots("lots").alias("lot"))
    beside = members.filter("node <> root").withColumn("lot", dealt("lots")).join(pivots, ["root", "lot"])
    shared = F.size(F.array_intersect("own", "first"))
    judged = keep(beside.select("node", "root", "members", near(shared, F.size("own"), F.size("first")).alias("near")))
    loose = judged.filter("not near and members > 2")
    crowd = loose.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / LOT).alias("homes"))
    rest = members.filter("node <> root").join(few(keep(crowd)), "root")  # a row per crowded set
    homes = rest.join(loose.select("node"), "node").select("root", "node", "own", F.lit(1).alias("loose"), dealt("homes").alias("home"), to_lots("lots").alias("lot"))
    visitors = rest.select("root", "node", "own", F.lit(0).alias("loose"), to_lots("homes").alias("home"), dealt("lots").alias("lot"))
    found = homes.unionByName(visitors).groupBy("root", "home", "lot").applyInArrow(_compare, "a bigint, b bigint")
    return judged.filter("near").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found)


def line_of():
    """A number of a row by its doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), whole_text())


def near_groups(docs: DataFrame, words_each: int) -> DataFrame:
    """doc_id and component_id (smallest doc_id that links lead to) of every row of ``docs``."""
    schema = "doc_id bigint, line bigint, mark0 bigint, mark1 bigint, anchors array<bigint>"
    own = keep(texts(docs, line_of().alias("line")).mapInArrow(partial(_sketches, words_each=words_each), schema))
    same = own.groupBy("mark0", "mark1").agg(F.min("doc_id").alias("first_id"), F.min("line").alias("line"), F.first("anchors").alias("anchors"))
    nodes = keep(same.withColumn("node", F.monotonically_increasing_id()))
    roots = keep(components(near_links(docs, nodes, words_each)))
    named = nodes.select("mark0", "mark1", "node", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return own.select("doc_id", "mark0", "mark1").join(named.join(smallest, "root"), ["mark0", "mark1"]).select("doc_id", "component_id")


def keep_one_of_each_group(docs: DataFrame, words_each: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each group of near copies the one with the smallest doc_id.

    Rows with a null doc_id stay, and so do repeated rows of the one that stays.
    """
    gone = fresh(docs, "gone")
    going = near_groups(docs, words_each).filter("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(going, docs["doc_id"].cast("long") == going[gone], "left_anti")
