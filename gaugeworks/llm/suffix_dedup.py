"""Removal of repeated passages by blockwise suffix sorting with a difference cover.

Every string of ``LENGTH`` bytes that also starts earlier (in a smaller doc_id, or earlier in the same document) is removed.

Suffix buckets. A window of LENGTH bytes belongs to the smallest hash among its grams of ``GRAM`` bytes; equal windows
choose the same gram, so only suffixes in the same bucket can share LENGTH bytes. Neighbouring windows with the same gram form a
segment, and buckets are shipped as segments: about one short row for 33 suffixes. Buckets with a single segment are dropped
after a grouped count. Segments that are equal as a whole are settled by their hashes; what is left are buckets of unlike segments.

Sorting a bucket. The segments' text is fetched and buckets are sorted one block at a time. Suffixes are ordered by their first
``COVER`` bytes; ties are resolved by ranks, computed beforehand, of the suffixes at positions in a difference cover: for any
two positions there is a shift smaller than COVER that brings both into the cover, and their order is that of the ranks there.
Neighbours in the order that agree on LENGTH bytes form a class; all but its first member go. A block holds a bounded
number of segments, so the memory of a task does not depend on the size of the corpus or of a bucket: crowded buckets are dealt
into lots by the segment's hash, and the first windows of each lot are then compared between lots by a grouped minimum.

Defined cases: a null text is empty; texts shorter than LENGTH lose nothing; a null doc_id comes before all others; rows with the
same doc_id are one document if their texts are equal (repeated rows get equal results), otherwise separate ones in the order of
their hashes; very long texts are cut into overlapping slices for hashing; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from numpy.lib.stride_tricks import sliding_window_view as windows
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import documents, keep, parts_of, texts

LENGTH, GRAM, COVER = 100, 36, 32
#: Windows that are hashed at once; segments that are sorted in one block and that make one lot of a bucket.
SLICE, BLOCK = 1 << 20, 2048
FIRST_ID = -(1 << 63)
SEGMENTS = "h bigint, sh bigint, doc bigint, tag bigint, start bigint, n int, gone boolean"
_BASE = 0x9E3779B97F4A7C15 | 1
_POSITION = np.uint64((1 << 21) - 1)


@lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    def run(base: int) -> np.ndarray:
        out = np.full(size, np.uint64(base & ((1 << 64) - 1)))
        out[0] = 1
        return np.multiply.accumulate(out)
    return run(_BASE), run(pow(_BASE, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def segments(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of the documents that ``text`` (bytes) is a concatenation of, ``ends`` being where they end.

    Returns the place of each segment in ``text``, its number of windows, the hash of its gram and that of its whole text.
    """
    total = len(text) - LENGTH + 1
    empty = np.zeros(0, np.int64)
    if total <= 0:
        return empty, empty, empty, empty
    power, inverse = _powers(SLICE + (1 << 18)) if len(text) < SLICE + (1 << 18) else _powers.__wrapped__(len(text) + 1)
    upto = np.concatenate([[np.uint64(0)], np.cumsum(text * power[:len(text)], dtype=np.uint64)])
    gram = _mixed((upto[GRAM:] - upto[:-GRAM]) * inverse[:len(text) - GRAM + 1])
    least = gram & ~_POSITION | np.arange(len(gram), dtype=np.uint64)
    width, grams = 1, LENGTH - GRAM + 1
    while width < grams:  # smallest key of the grams in each window, the leftmost of equal ones
        step = min(width, grams - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    chosen = (least & _POSITION).astype(np.int64)
    last = np.zeros(len(text) + 1, bool)  # windows that start here run into the next document
    for end in ends:
        last[max(0, end - LENGTH + 1):end] = True
    valid = ~last[:total]
    new = np.empty(total, bool)
    new[0] = True
    new[1:] = (chosen[1:] != chosen[:-1]) | (valid[1:] != valid[:-1])
    start = np.flatnonzero(new)
    n = np.diff(np.append(start, total))
    ok = valid[start]
    start, n = start[ok], n[ok]
    whole = _mixed((upto[start + n + LENGTH - 1] - upto[start]) * inverse[start]) + n.astype(np.uint64) * np.uint64(_BASE)
    return start, n, gram[chosen[start]].view(np.int64), whole.view(np.int64)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of whole documents, or of overlapping slices of a long one: bytes, ends, rows, and places of the rows' first bytes."""
    parts, rows, offsets, size = [], [], [], 0

    def made():
        ends = np.cumsum([len(p) for p in parts])
        return np.frombuffer(b"".join(parts), np.uint8), ends, np.array(rows), np.array(offsets)

    for row, value in enumerate(batch.column("text")):
        text = value.as_buffer().to_pybytes() if len(value.as_buffer()) >= LENGTH else b""
        for at in range(0, max(len(text) - LENGTH + 1, 0), SLICE):
            part = text[at:at + SLICE + LENGTH - 1]
            if parts and size + len(part) > SLICE:
                yield made()
                parts, rows, offsets, size = [], [], [], 0
            parts.append(part)
            rows.append(row)
            offsets.append(at)
            size += len(part)
    if parts:
        yield made()


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of all documents; of equal segments in a batch all but the first are already gone."""
    for batch in batches:
        doc, tag = batch.column("doc").to_numpy(), batch.column("tag").to_numpy()
        found = []
        for text, ends, rows, offsets in _slices(batch):
            start, n, h, sh = segments(text, ends)
            part = np.searchsorted(ends, start, "right")
            found.append((h, sh, doc[rows[part]], tag[rows[part]], start - np.append(0, ends)[part] + offsets[part], n))
        if not found:
            continue
        h, sh, d, t, start, n = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((start, t, d, sh, h))
        same = np.zeros(len(order), bool)
        a, b = order[1:], order[:-1]
        same[1:] = (h[a] == h[b]) & (sh[a] == sh[b])
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        f = order[first]
        gone = np.empty(len(order), bool)  # a repeated row is no earlier document
        gone[order] = same & ((d[order] != d[f]) | (t[order] != t[f]) | (start[order] != start[f]))
        for at in range(0, len(h), 1 << 16):
            s = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([*(pa.array(c[s]) for c in (h, sh, d, t, start)), pa.array(n[s].astype(np.int32)), pa.array(gone[s])],
                                             names=["h", "sh", "doc", "tag", "start", "n", "gone"])


@lru_cache(1)
def cover(period: int = COVER) -> tuple[np.ndarray, np.ndarray]:
    """A difference cover modulo ``period`` as a mask, and for two residues the smallest shift into it.

    0 .. r-1 and the multiples of r, with r the root of the period rounded up, have all differences between them.
    """
    r = int(np.ceil(np.sqrt(period)))
    chosen = np.zeros(period, bool)
    chosen[:r] = chosen[::r] = True
    both = chosen[(np.arange(period)[:, None, None] + np.arange(period)) % period] & chosen[(np.arange(period)[None, :, None] + np.arange(period)) % period]
    return chosen, both.argmax(2)


def cover_ranks(text: np.ndarray, place: np.ndarray, end: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Rank of the suffix at each position in the cover, up to the end of its segment; -1 elsewhere.

    ``place`` is the position's residue in its document, ``end`` the end of its segment in ``text``.
    """
    chosen, _ = cover()
    at = np.flatnonzero(chosen[place])
    length = end[at] - at
    width = int(length.max()) if len(at) else 0
    strings = windows(np.append(text, np.zeros(width, np.uint8)), width)[at] * (np.arange(width) < length[:, None])
    ranks = np.full(len(text), -1)
    if len(at):
        _, ranks[at] = np.unique(np.ascontiguousarray(strings).view(f"S{width}").ravel(), return_inverse=True)
    return ranks


def sorted_suffixes(text: np.ndarray, place: np.ndarray, end: np.ndarray, at: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``at`` within their buckets, and which of them tie on COVER bytes with the one before."""
    words = windows(text, COVER)[at].view(">u8").astype(np.uint64)
    order = np.lexsort((*words.T[::-1], bucket))
    tie = np.zeros(len(order), bool)
    a, b = order[1:], order[:-1]
    tie[1:] = (bucket[a] == bucket[b]) & (words[a] == words[b]).all(1)
    ranks, (_, shift) = cover_ranks(text, place, end, at), cover()
    group = np.cumsum(~tie) - 1
    rest = np.flatnonzero(tie | np.append(tie[1:], False))  # places in the order whose suffixes tie
    while len(rest):
        g = group[rest]
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        size = np.diff(np.append(first, len(g)))
        pivot, mine = at[order[rest[np.repeat(first + size // 2, size)]]], at[order[rest]]
        by = shift[place[mine], place[pivot]]
        side = np.sign(ranks[mine + by] - ranks[pivot + by])
        moved = np.lexsort((side, g))
        order[rest], side = order[rest[moved]], side[moved]
        split = np.append(True, (g[1:] != g[:-1]) | (side[1:] != side[:-1]))
        part = np.cumsum(split)
        group[rest] = part  # numbers only tell neighbours apart among those that are left
        members = np.bincount(part)
        keep_on = (side != 0) & (members[part] > 1)
        rest = rest[keep_on]
    return order, tie


def repeated_windows(parts: list[bytes], bucket: np.ndarray, doc: np.ndarray, tag: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of the segments of a block: segment, place in it, and whether an earlier equal window is in the block."""
    size = np.array([len(p) for p in parts])
    ends = np.cumsum(size)
    text = np.frombuffer(b"".join(parts), np.uint8)
    owner = np.repeat(np.arange(len(parts)), size)
    inside = np.arange(len(text)) - (ends - size)[owner]
    at = np.flatnonzero(inside < (size - LENGTH + 1)[owner])
    segment, window = owner[at], inside[at]
    place = (start[owner] + inside) % COVER
    order, tie = sorted_suffixes(text, place, ends[owner], at, bucket[segment])
    same = np.zeros(len(order), bool)
    pairs = np.flatnonzero(tie)
    for i in range(0, len(pairs), 1 << 15):
        p = pairs[i:i + (1 << 15)]
        x, y = at[order[p]], at[order[p - 1]]
        same[p] = (windows(text, LENGTH)[x] == windows(text, LENGTH)[y]).all(1)
    number = np.empty(len(at), np.int64)  # order of the windows in the corpus
    by_place = np.lexsort((start[segment] + window, tag[segment], doc[segment]))
    x, y = by_place[1:], by_place[:-1]
    step = (doc[segment[x]] != doc[segment[y]]) | (tag[segment[x]] != tag[segment[y]]) | ((start[segment] + window)[x] != (start[segment] + window)[y])
    number[by_place] = np.append(0, np.cumsum(step)) if len(at) else []
    classes = np.cumsum(~same) - 1
    earliest = np.minimum.reduceat(number[order], np.flatnonzero(~same)) if len(at) else number
    gone = np.empty(len(at), bool)
    gone[order] = number[order] > earliest[classes]
    return segment, window, gone


def _sort_buckets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows of each (h, lot), a block of whole buckets at a time; rows come sorted by both.

    Rows with ``lots`` > 1 that are first in their lot come out with the hash of their window, to be compared between lots. A lot
    that is too large for a block goes on in several blocks; all its rows, those still to come included, are compared like lots.
    """
    held: list[tuple] = []
    crowded = None
    for batch in batches:
        for part in (batch.slice(i, size) for i in range(0, batch.num_rows, size)):
            rows = zip(*(part.column(c).to_pylist() for c in ("h", "lot", "lots", "doc", "tag", "start", "part")), strict=True)
            held += [(*r[:2], 2, *r[3:]) if r[:2] == crowded else r for r in rows]
            done = len(held) - next((i for i, r in enumerate(reversed(held)) if r[:2] != held[-1][:2]), len(held))
            if done >= size:
                yield _block(held[:done])
                held = held[done:]
            while len(held) >= 4 * size:  # hashes dealt a lot unevenly
                crowded = held[size - 1][:2]
                yield _block([(*r[:2], 2, *r[3:]) for r in held[:size]])
                held = [(*r[:2], 2, *r[3:]) if r[:2] == crowded else r for r in held[size:]]
    if held:
        yield _block(held)


def _block(rows: list[tuple]) -> pa.RecordBatch:
    h, lot, lots, doc, tag, start = (np.array(c, np.int64) for c in list(zip(*rows, strict=True))[:6])
    parts = [r[6] for r in rows]
    bucket = np.cumsum(np.append(0, (h[1:] != h[:-1]) | (lot[1:] != lot[:-1])))
    segment, window, gone = repeated_windows(parts, bucket, doc, tag, start)
    run = np.flatnonzero(gone & ~np.append(False, gone[:-1] & (segment[1:] == segment[:-1])))
    stop = np.flatnonzero(gone & ~np.append(gone[1:] & (segment[1:] == segment[:-1]), False))
    open_ = np.flatnonzero(~gone & (lots[segment] > 1))
    digests = np.array([xxhash.xxh64_intdigest(parts[s][w:w + LENGTH]) for s, w in zip(segment[open_].tolist(), window[open_].tolist(), strict=True)], np.uint64)
    which = np.concatenate([segment[run], segment[open_]])
    first = np.concatenate([window[run], window[open_]])
    n = np.concatenate([stop - run + 1, np.ones(len(open_), np.int64)])
    wh = np.concatenate([np.zeros(len(run), np.int64), digests.view(np.int64)])
    settled = np.arange(len(which)) < len(run)
    return pa.RecordBatch.from_arrays([pa.array(h[which]), pa.array(wh), pa.array(doc[which]), pa.array(tag[which]), pa.array(start[which] + first), pa.array(n.astype(np.int32)), pa.array(settled)],
                                      names=["h", "wh", "doc", "tag", "start", "n", "settled"])


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [squeeze.compress(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "doc", "tag")), pa.array(packed, pa.binary())], names=["doc_id", "doc", "tag", "packed"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each wanted segment."""
    unpack = zstandard.ZstdDecompressor()
    for whole in batches:
        for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
            rows = []
            for doc, tag, packed, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc", "tag", "packed", "wanted")), strict=True):
                text = unpack.decompress(packed)
                rows += [(w["h"], w["lot"], w["lots"], doc, tag, w["start"], text[w["start"]:w["start"] + w["n"] + LENGTH - 1]) for w in wanted]
            kinds = [pa.int64()] * 6 + [pa.binary()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["h", "lot", "lots", "doc", "tag", "start", "part"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _removed(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for whole in batches:
        for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
            rows = []
            for doc_id, packed, runs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "packed", "runs")), strict=True):
                text = unpack.decompress(packed)
                spans = merged([(r["start"], r["start"] + r["n"] + LENGTH - 1) for r in runs or []])
                at, left = 0, []
                for a, b in [*spans, (len(text), len(text))]:
                    left.append(text[at:a])
                    at = b
                kept = b"".join(left)
                rows.append((doc_id, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), *((kept,) if with_text else ())))
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def repeated_runs(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Runs (doc, tag, start, n) of windows of LENGTH bytes that also start earlier; ``rows`` is (doc, tag, text)."""
    found = rows.mapInArrow(_segments, SEGMENTS)
    # stored, so that both sides of the join are dealt out by it and Spark can split a crowded bucket
    shared = keep(found.groupBy("h").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"))
    stored = keep(found.join(shared, "h"))
    here = ["doc", "tag", "start", "n"]
    gone = stored.filter("gone").select(*here)
    left = stored.filter("NOT gone")
    first = keep(left.groupBy("h", "sh", "n").agg(F.min(F.struct("doc", "tag", "start")).alias("first")))
    later = left.join(first, ["h", "sh", "n"]).filter(F.struct("doc", "tag", "start") != F.col("first")).select(*here)

    unlike = keep(first.groupBy("h").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("h", F.ceil(F.col("members") / block).alias("lots")))
    wanted = (first.join(unlike, "h").select("first.*", "n", "h", F.pmod("sh", "lots").alias("lot"), "lots")
              .groupBy("doc", "tag").agg(F.collect_list(F.struct("h", "lot", "lots", "start", "n")).alias("wanted")))
    packed = rows.select(F.lit(0).cast("long").alias("doc_id"), "doc", "tag", "text").mapInArrow(_compressed, "doc_id bigint, doc bigint, tag bigint, packed binary")
    packed = packed.select("doc", "tag", "packed")
    cut = packed.join(wanted, ["doc", "tag"]).mapInArrow(_cut_out, "h bigint, lot bigint, lots bigint, doc bigint, tag bigint, start bigint, part binary")
    dealt = cut.repartition(parts_of(rows.sparkSession), "h", "lot").sortWithinPartitions("h", "lot")
    sorted_out = keep(dealt.mapInArrow(partial(_sort_buckets, size=block), "h bigint, wh bigint, doc bigint, tag bigint, start bigint, n int, settled boolean"))
    settled = sorted_out.filter("settled").select(*here)
    open_ = sorted_out.filter("NOT settled")
    earliest = open_.groupBy("h", "wh").agg(F.min(F.struct("doc", "tag", "start")).alias("first"))
    between = open_.join(earliest, ["h", "wh"]).filter(F.struct("doc", "tag", "start") != F.col("first")).select(*here)
    return gone.unionByName(later).unionByName(settled).unionByName(between)


def remove_repeats(docs: DataFrame, with_text: bool = False, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs``, and the bytes that stay if asked for."""
    alike = docs.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    tag = F.xxhash64(F.coalesce("text", F.lit(""))) if alike else F.lit(0).cast("long")
    rows = texts(docs, F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)).alias("doc"), tag.alias("tag"))
    runs = repeated_runs(rows.select("doc", "tag", "text"), block).groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    packed = rows.mapInArrow(_compressed, "doc_id bigint, doc bigint, tag bigint, packed binary")
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_text else "")
    return packed.join(runs, ["doc", "tag"], "left").select("doc_id", "packed", "runs").mapInArrow(partial(_removed, with_text=with_text), schema)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
