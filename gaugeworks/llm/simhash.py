"""SimHash near-dedup by anchor-point covering.

A fingerprint of 64 bits is cut into bands so that two fingerprints within the threshold differ by at most one bit in some
band. In each band the anchors are a covering code: a Hamming code on the largest 2^r - 1 bits and all settings of the rest, so
that every point has one anchor within covering radius 1, its home. A fingerprint goes home, and is replicated to every anchor
within covering radius plus the band's threshold; whatever it is near to is then at home at one of these anchors. Of two points
that differ in one bit, one has an odd number of bits, so only odd points are replicated and even ones just go home. Anchors
are compared with numpy in blocks, homes against replicas; a block hands on a star per connected set instead of its pairs, so
what leaves a group grows with its members, not with their square. Homes of a crowded anchor are dealt out to several
tasks, each of which sees all replicas in a stream.

Only distinct fingerprints are compared: exact copies, and copies that differ in a few words, cost one row each.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; with fewer words than a shingle the whole
sequence is the one shingle; a null doc_id has a fingerprint but never names a component, unless all ids in it are null;
repeated rows get equal results; very long texts are hashed in slices; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import near_copies
from gaugeworks.llm.common import documents, fresh, keep, parts_of, rows_per_task, texts
from gaugeworks.llm.components import components, stars

__all__ = ["fingerprint", "fingerprints", "keep_one_of_each_group", "near_groups", "near_links", "op1_simhash_near_dedup"]

BITS = 64
SEED = 42
#: Words of a shingle, and bits in which linked fingerprints may differ.
WORDS, THRESHOLD = 3, 2
#: Homes of one anchor that one task compares with the anchor's replicas.
HOMES = 4096
#: Crowded anchors that may go to every task as a list.
FEW = 100_000
#: Pairs that are compared at once inside a task, and shingles that are hashed at once.
PAIRS, SLICE = 1 << 21, 1 << 16


def remixed(h: np.ndarray, number: int) -> np.ndarray:
    """The hashes as they are for number 0, and independent looking ones made of them for others."""
    if not number:
        return h
    x = h * np.uint64(0x9E3779B97F4A7C15 * (2 * number + 1) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def fingerprint(text: bytes, words_each: int, width: int = 1) -> list[int]:
    """``width`` numbers of 64 bits: majority of the bits of the XXH64 of all word shingles, repeats included."""
    words = text.lower().split()  # of bytes: A-Z only, and the blanks of common.BLANK
    if not words:
        return [0] * width
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start, joined, n = (end - size).tolist(), b" ".join(words), max(1, len(words) - words_each + 1)
    end = end[min(words_each, len(words)) - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros((width, BITS), np.int64)
    for at in range(0, n, SLICE):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(start[at:at + SLICE], end[at:at + SLICE])], "<u8")  # noqa: B905
        for i in range(width):
            ones[i] += np.unpackbits(remixed(h, i).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > n, axis=1, bitorder="little").view("<u8").ravel().tolist()


def _fingerprints(batches: Iterator[pa.RecordBatch], words_each: int, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = [fingerprint(t, words_each, width) for _, t in rows_per_task([batch], ("doc_id", "text"))]
        columns = np.array(marks, np.uint64).reshape(-1, width).astype(np.int64).T
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], names=["doc_id", *names_of(width)])


def names_of(width: int) -> list[str]:
    return [f"mark{i}" for i in range(width)]


def fingerprints(docs: DataFrame, words_each: int, width: int = 1) -> DataFrame:
    """doc_id and ``width`` fingerprints of 64 bits (signed): mark0, mark1, ..."""
    schema = ", ".join(["doc_id bigint", *(f"{m} bigint" for m in names_of(width))])
    return texts(docs).mapInArrow(partial(_fingerprints, words_each=words_each, width=width), schema)


@lru_cache
def bands(threshold: int) -> list[tuple[int, int]]:
    """(first bit, width) of the bands: so many that one of them has at most one differing bit."""
    n = threshold // 2 + 1
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]  # noqa: B905


@lru_cache
def steps_to_anchors(width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Syndrome of each bit of a band, and by syndrome the flips that lead to an anchor: home first, then all within radius 2.

    Bit i < 2^r - 1 has syndrome i + 1 and bits above have 0. A point is an anchor where the syndromes of its set bits cancel.
    """
    n = (1 << (width + 1).bit_length() - 1) - 1
    of_bit = np.array([i + 1 if i < n else 0 for i in range(width)])
    flips: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
    for weight in range(3):  # covering radius 1 and a threshold of 1 in the band
        for chosen in combinations(range(width), weight):
            flips[int(np.bitwise_xor.reduce(of_bit[list(chosen)])) if chosen else 0].append((weight, sum(1 << i for i in chosen)))
    return of_bit, [np.array([mask for _, mask in sorted(f)], np.uint64) for f in flips]


def _replicas(batches: Iterator[pa.RecordBatch], marks: list[str], threshold: int, homes_only: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, away, node, marks): home is where away is 0."""
    for whole in batches:
        for batch in (whole.slice(i, 4096) for i in range(0, whole.num_rows, 4096)):
            own = [batch.column(c).to_numpy() for c in ("node", *marks)]
            for w, mark in enumerate(own[1:]):
                for number, (first, width) in enumerate(bands(threshold)):
                    part = mark.astype(np.uint64) >> np.uint64(first) & np.uint64((1 << width) - 1)
                    of_bit, flips = steps_to_anchors(width)
                    syndrome = np.zeros(len(part), np.int64)
                    for i, s in enumerate(of_bit.tolist()):
                        syndrome ^= s * (part >> np.uint64(i) & np.uint64(1)).astype(np.int64)
                    tag = np.int64((w * BITS + number) << 40)
                    even = np.bitwise_count(part) & 1 == 0
                    for s, alone in [(s, alone) for s in np.unique(syndrome) for alone in (True, False)]:
                        at, masks = np.flatnonzero((syndrome == s) & (even == alone)), flips[s][:1] if alone else flips[s]
                        if not len(at):
                            continue
                        if homes_only:
                            yield pa.RecordBatch.from_arrays([pa.array((part[at] ^ masks[0]).astype(np.int64) | tag)], names=["anchor"])
                            continue
                        anchors = (part[at, None] ^ masks[None, :]).astype(np.int64) | tag
                        home = np.zeros(len(at), np.int64)
                        rows = np.concatenate([np.repeat(at, len(masks)), at])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.concatenate([anchors.ravel(), anchors[:, 0]])), pa.array(np.concatenate([np.ones(anchors.size, np.int8), home.astype(np.int8)])),
                             *(pa.array(x[rows]) for x in own)], names=["anchor", "away", "node", *marks])


def _compare(batches: Iterator[pa.RecordBatch], marks: list[str], threshold: int, total: int) -> Iterator[pa.RecordBatch]:
    """Links found between homes and replicas of each (anchor, lot); rows come sorted by anchor, lot, away."""
    held = None  # homes of the group that may go on in the next batch
    for batch in batches:
        rows = [batch.column(c).to_numpy() for c in ("anchor", "lot", "away", "node", *marks)]
        if held is not None:
            rows = [np.concatenate(p) for p in zip(held, rows)]  # noqa: B905
        anchor, lot, away, node, *marked = rows
        change = np.flatnonzero((anchor[1:] != anchor[:-1]) | (lot[1:] != lot[:-1])) + 1
        start = np.concatenate([[0], change])
        group = np.repeat(np.arange(len(start)), np.diff(np.concatenate([start, [len(anchor)]])))
        homes = np.bincount(group, away == 0, len(start)).astype(np.int64)
        last = slice(start[-1], start[-1] + homes[-1]) if len(anchor) else slice(0, 0)
        held = [x[last].copy() for x in rows]
        visitors = np.flatnonzero((away == 1) & (homes[group] > 0))
        ends = np.cumsum(homes[group[visitors]])
        at = 0
        while at < len(visitors):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            some = visitors[at:upto]
            each = homes[group[some]]
            y = np.repeat(some, each)
            x = np.arange(len(y)) - np.repeat(np.cumsum(each) - each, each) + start[group[y]]
            apart = [np.bitwise_count(m[x] ^ m[y]) for m in marked]
            near = (np.minimum.reduce(apart) <= threshold) & (node[x] != node[y])
            if len(apart) > 1:
                near &= sum(d.astype(np.int64) for d in apart) <= total
            if near.any():
                a, b = stars(node[x[near]], node[y[near]])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            at = upto


def near_links(nodes: DataFrame, marks: list[str], threshold: int, total: int) -> DataFrame:
    """Links (a, b) that connect all ``nodes`` (node, marks; a stored table) within the threshold of each other."""
    fields = ", ".join(["anchor bigint", "away tinyint", "node bigint", *(f"{m} bigint" for m in marks)])
    rows = nodes.mapInArrow(partial(_replicas, marks=marks, threshold=threshold), fields)
    homes = nodes.mapInArrow(partial(_replicas, marks=marks, threshold=threshold, homes_only=True), "anchor bigint")
    crowded = keep(homes.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / HOMES).alias("lots")).filter("lots > 1"))
    if crowded.count() <= FEW:
        crowded = F.broadcast(crowded)
    mine = F.pmod(F.xxhash64("node"), F.coalesce("lots", F.lit(1)))
    lots = F.when(F.col("away") == 0, F.array(mine)).otherwise(F.sequence(F.lit(0).cast("long"), F.coalesce("lots", F.lit(1)) - 1))
    dealt = rows.join(crowded, "anchor", "left").select("anchor", "away", "node", *marks, F.explode(lots).alias("lot"))
    sorted_rows = dealt.repartition(parts_of(nodes.sparkSession), "anchor", "lot").sortWithinPartitions("anchor", "lot", "away")
    return sorted_rows.mapInArrow(partial(_compare, marks=marks, threshold=threshold, total=total), "a bigint, b bigint")


def near_groups(docs: DataFrame, words_each: int, threshold: int, width: int = 1, total: int | None = None) -> DataFrame:
    """doc_id, the fingerprints and component_id (smallest doc_id that links lead to) of every row of ``docs``.

    Two texts are linked where one of their ``width`` fingerprints differs in at most ``threshold`` bits and all of them differ in
    at most ``total`` bits together.
    """
    marks = names_of(width)
    own = keep(fingerprints(docs, words_each, width))
    nodes = keep(own.groupBy(*marks).agg(F.min("doc_id").alias("first_id")).withColumn("node", F.monotonically_increasing_id()))
    roots = keep(components(near_links(nodes.select("node", *marks), marks, threshold, threshold if total is None else total)))
    named = nodes.join(roots, "node").select(*marks, "root", "first_id")
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = keep(named.join(smallest, "root").select(*marks, "component_id"))
    alone = nodes.join(linked, marks, "left_anti").select(*marks, F.col("first_id").alias("component_id"))
    return own.join(linked.unionByName(alone), marks).select("doc_id", *marks, "component_id")


def keep_one_of_each_group(docs: DataFrame, words_each: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each group of near copies the one with the smallest doc_id.

    Groups are those of the fingerprints, as in op1, joined with those of exact shingle sets (``near_copies``), since fingerprints alone miss
    many pairs at a similarity of 0.8. Rows with a null doc_id stay, and so do repeated rows of the one that stays.
    """
    marked = near_groups(docs, words_each=WORDS, threshold=THRESHOLD).select("doc_id", "component_id")
    links = marked.unionByName(near_copies.near_groups(docs, words_each)).filter("doc_id <> component_id")
    found = components(keep(links.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")).distinct()))
    gone = fresh(docs, "gone")
    going = found.filter("node <> root").select(F.col("node").alias(gone))
    return docs.join(going, docs["doc_id"].cast("long") == going[gone], "left_anti")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(documents(spark, sf_dir), words_each=WORDS, threshold=THRESHOLD)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("mark0")), 16, "0").alias("fingerprint"), "component_id")
