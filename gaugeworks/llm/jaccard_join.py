"""Self-join of documents on the exact Jaccard similarity of their word shingle sets, 0.9 or more.

Which sets may be linked is settled without loss by the pigeonhole. Two linked sets, the larger of size y, differ in at most
2y/19 values. The range of the shingle hashes is cut into a few more segments than that, so that some segments hold the
same values in both, and sets meet at the hashes of their segments' values. Sizes share a number of segments in classes; a
set takes part in its own class and in those of the larger sets that it may be linked to. Segments without values are no
meeting point; sets with so many empty segments that they alone could make the difference meet at one more point.
Unlike a rare word, a whole segment is seldom shared by texts that are not near copies, so common phrases gather no crowds.
What is shuffled is (point, node), and of rows of one batch that meet only the first, with links to it.

Sets that meetings connect are compared in tiles, to which the texts go, since a text takes less room than its set. A tile
sorts its sets by size, so that each set has a band of partners. A hashed bitmap of each set gives, by the bits in which two
differ, an upper bound of their overlap; pairs that pass are decided by intersecting the sorted arrays, unless they are connected
already. A small candidate set is one tile.

In a crowded one, sets are first held against each other by parities: bits that each value of a set turns over, an eighth of the
set at most. Parities of two sets differ in no more bits than the sets in values, so no link is lost. Rounds follow: every member
names the partners that its parities allow and that it is not connected with; those pairs are decided on the texts, a text
going to the one it named and nowhere else; what is connected by then, or was found not to be linked, is not named again. Members without
a partner to name are done. A round lets each member name four times as many partners as the last. So only parities are copied to
many tiles, and texts are moved once for each partner that is named.

Sets are of 64-bit hashes; texts with equal sets are one node.

Defined cases: a text that is null, empty or blank has the empty set and is linked with nothing, not even with its like; with fewer
words than a shingle the whole sequence is the one shingle; a null doc_id may link others but names no component, unless all ids
in it are null; repeated rows get equal results; very long texts are whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import documents, forget, keep, parts_of, rows_per_task, texts, whole_text
from gaugeworks.llm.components import components, stars

#: Words of a shingle.
WORDS = 3
SEED = 42
#: Linked are sets with 100 * shared >= 90 * united, that is 19 * shared >= 9 * (one + other).
SHARED, BOTH = 19, 9
#: Sets of one lot of a tile, and values of them all, about.
LOT, LOT_VALUES = 512, 1 << 17
#: Bitmap words that are compared at once.
CHUNK = 1 << 20
#: Rows up to which candidates go to every task as a list.
FEW = 1_000_000
#: Links whose components the driver finds.
FEW_LINKS = 1 << 18
#: Lots of parities are so many times as large.
WIDER = 16
#: Bands of sizes are this many times as wide as they are low.
BAND = 10 / 9

_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * _MIX
    return x ^ x >> np.uint64(29)


def shingle_set(text: bytes, words_each: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a UTF-8 text, A-Z in lower case."""
    words = text.lower().split()  # of bytes: A-Z only, and the blanks of common.BLANK
    if not words:
        return np.zeros(0, np.uint64)
    each = min(words_each, len(words))
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - each + 1
    out = np.full(n, SEED + each, np.uint64)
    for i in range(each):
        out = mixed(out + h[i:i + n])
    return np.unique(out)


def _classes() -> list[tuple[int, int, int]]:
    """(largest size, segments, empty segments that may be common): differences allowed grow by a half from class to class."""
    out, differ = [], 1
    while differ < 1 << 28:
        reserve = 1 + differ // 8
        out.append(((19 * (differ + 1) - 1) // 2, differ + 1 + reserve, reserve))
        differ = max(differ + 1, differ * 3 // 2)
    return out


CLASSES = _classes()
_LARGEST = [c[0] for c in CLASSES]


def meeting_points(own: np.ndarray) -> np.ndarray:
    """Points at which a set meets every other that it may be linked to; none for a set that is only linked to its equals."""
    n, out = len(own), []
    if n * 10 // 9 < 10:
        return np.zeros(0, np.uint64)
    for c in range(bisect_left(_LARGEST, n), bisect_left(_LARGEST, n * 10 // 9) + 1):
        _, segments, reserve = CLASSES[c]
        place = (own >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)
        start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        tag = place[start] | np.uint64(c << 32)
        out.append(mixed(mixed(np.add.reduceat(own, start)) + mixed(tag)))
        if segments - len(start) > reserve:
            out.append(mixed(np.array([1 << 63 | c], np.uint64)))
    return np.concatenate(out)


def _sketches(batches: Iterator[pa.RecordBatch], words_each: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "line", "mark0", "mark1", "n", "points"]
    for batch in batches:
        marks, sizes, points = ([], []), [], []
        for _, text in rows_per_task([batch], ("doc_id", "text")):
            own = shingle_set(text, words_each)
            for seed, m in enumerate(marks):
                m.append(xxhash.xxh64_intdigest(own.tobytes(), seed))
            sizes.append(len(own))
            points.append(meeting_points(own).astype(np.int64))
        ends = np.cumsum([0, *map(len, points)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("line"), *(pa.array(np.array(m, np.uint64).astype(np.int64)) for m in marks), pa.array(sizes, pa.int64()),
             pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *points])))], names=names)


def _point_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (point, node). Of nodes of a batch that meet at a point the first goes there; each other meets it at a point of their own."""
    for batch in batches:
        lists = batch.column("points")
        point = lists.flatten().to_numpy()
        node = np.repeat(batch.column("node").to_numpy(), lists.value_lengths().to_numpy())
        order = np.argsort(point, kind="stable")
        point, node = point[order], node[order]
        start = np.concatenate([np.ones(min(len(point), 1), bool), point[1:] != point[:-1]])
        first = node[start][np.cumsum(start) - 1]
        pairs = np.unique(np.stack([node[~start], first[~start]], 1), axis=0)
        between = mixed(mixed(pairs[:, 0].astype(np.uint64)) + pairs[:, 1].astype(np.uint64)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([point[start], between, between])), pa.array(np.concatenate([node[start], pairs[:, 0], pairs[:, 1]]))],
                                         names=["point", "node"])


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of all nodes at a point with its first one; rows come sorted by point."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        point, node = (batch.column(c).to_numpy() for c in ("point", "node"))
        start = np.concatenate([[True], point[1:] != point[:-1]])
        first = node[np.flatnonzero(start)][np.cumsum(start) - 1]
        if last is not None and last[0] == point[0]:
            first[:np.searchsorted(point, point[0], "right")] = last[1]
        last = point[-1], first[-1]
        pairs = np.unique(np.stack([node, first], 1)[node != first], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node once a task: repeated rows have the same one."""
    seen = set()
    for batch in batches:
        new = [i for i, node in enumerate(batch.column("node").to_pylist()) if not (node in seen or seen.add(node))]
        yield batch.take(pa.array(new, pa.int64()))


def parity_bits(n: int) -> int:
    return max(64, 1 << int(4 * n - 1).bit_length())


def parities(own: np.ndarray) -> bytes:
    """Bits that are set where an odd number of values fall."""
    bits = parity_bits(len(own))
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _parity_rows(batches: Iterator[pa.RecordBatch], words_each: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t, words_each) for t in batch.column("text").to_pylist()]
        assert list(map(len, sets)) == batch.column("n").to_pylist(), "two texts have one line number"
        bits = [parities(s) for s in sets]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "root", "n")), pa.array(bits, pa.binary())], names=["node", "root", "n", "bits"])


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """One row of 64-bit words per set, with a bit for each value."""
    out = np.zeros((len(sets), bits), bool)
    for i, s in enumerate(sets):
        out[i, (s & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, axis=1).view(np.uint64)


def linked(one: np.ndarray, other: np.ndarray) -> bool:
    """Exact: ``one`` and ``other`` are sorted arrays of distinct values."""
    at = np.searchsorted(one, other)
    shared = int((one[np.minimum(at, len(one) - 1)] == other).sum())
    return SHARED * shared >= BOTH * (len(one) + len(other))


def tile_links(node: np.ndarray, sets: list[np.ndarray], home: np.ndarray, settled: np.ndarray, star: bool = False) -> list[tuple[int, int]]:
    """Links between ``home`` sets and all sets of a tile, enough to connect what all those links connect.

    ``settled`` sets are known to be connected. With ``star`` all links are wanted, of one home.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    order = np.argsort(size, kind="stable")
    node, size, home, settled, sets = node[order], size[order], home[order], settled[order], [sets[i] for i in order]
    maps = bitmaps(sets, max(64, 1 << int(4 * size[-1] - 1).bit_length()))
    parent = list(range(len(sets)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    together = np.flatnonzero(settled)
    for i in together[1:].tolist():
        parent[i] = int(together[0])
    out = []
    for i in np.flatnonzero(home).tolist():
        low, high = np.searchsorted(size, -(-size[i] * 9 // 10)), np.searchsorted(size, size[i] * 10 // 9, "right")
        step = max(1, CHUNK // maps.shape[1])
        for at in range(low, high, step):
            some = slice(at, min(at + step, high))
            apart = np.bitwise_count(maps[some] ^ maps[i]).sum(1, dtype=np.int64)
            for j in (np.flatnonzero(apart * 19 <= size[some] + size[i]) + at).tolist():
                if node[j] != node[i] and (j < i or not home[j]) and (star or top(i) != top(j)) and linked(sets[i], sets[j]):
                    parent[top(j)] = top(i)
                    out.append((int(node[j]), int(node[i])))
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each root and tile; rows come sorted by these."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        root, tile = (batch.column(c).to_numpy() for c in ("root", "tile"))
        edges = [0, *(np.flatnonzero((root[1:] != root[:-1]) | (tile[1:] != tile[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):  # noqa: B905
            if held and (root[a], tile[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = root[a], tile[a]
    if held:
        yield pa.Table.from_batches(held)


def _tiles(batches: Iterator[pa.RecordBatch], words_each: int) -> Iterator[pa.RecordBatch]:
    """Links of all tiles; rows (root, tile, node, text) come sorted by root and tile."""
    for rows in _groups(batches):
        own = dict(zip(rows["node"].to_pylist(), rows["text"].to_pylist(), strict=True))
        if len(own) > 1:
            yes = np.ones(len(own), bool)
            yield _pairs(tile_links(np.fromiter(own, np.int64, len(own)), [shingle_set(t, words_each) for t in own.values()], yes, ~yes))


def closest(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, other, label of other, unsure) of up to ``width`` partners of each home row that parities allow.

    Left out are partners of the same label and those in a node's list ``apart``. Those well within the bound come first, then
    small labels, so that members of one group name the same partner.
    """
    rows = rows.take(np.argsort(rows["n"].to_numpy(), kind="stable")).combine_chunks()
    node, size, label, home = (rows[c].to_numpy() for c in ("node", "n", "label", "home"))
    home = home.astype(bool)
    beside = home if home.all() else ~home
    refuted, texts_of = rows["apart"].to_pylist(), rows["bits"].to_pylist()
    own = np.fromiter((len(t) * 8 for t in texts_of), np.int64, len(rows))
    ends, held = {}, {}
    for bits in np.unique(own).tolist():
        start, mid, end = (int(np.searchsorted(own, x)) for x in (bits, 2 * bits, 4 * bits))
        ends[bits] = start, mid
        same = [np.frombuffer(t, np.uint64) for t in texts_of[start:mid]]
        folded = [x[:len(x) // 2] ^ x[len(x) // 2:] for x in (np.frombuffer(t, np.uint64) for t in texts_of[mid:end])]
        held[bits] = start, end, np.stack(same + folded)
    found = []
    for i in np.flatnonzero(home).tolist():
        low, high = int(np.searchsorted(size, -(-size[i] * 9 // 10))), int(np.searchsorted(size, size[i] * 10 // 9, "right"))
        for bits in (int(own[i]) // 2, int(own[i])):
            if bits not in held:
                continue
            start, end, maps = held[bits]
            stop = min(high, ends[bits][1] if bits < own[i] else end)
            step = max(1, CHUNK // maps.shape[1])
            for at in range(max(low, start), stop, step):
                some = slice(at, min(at + step, stop))
                differ = np.bitwise_count(maps[some.start - start:some.stop - start] ^ maps[i - start]).sum(1, dtype=np.int64)
                both = size[some] + size[i]
                j = np.flatnonzero((differ * 19 <= both) & beside[some] & (label[some] != label[i]))
                if refuted[i] and len(j):
                    j = j[~np.isin(node[some][j], refuted[i])]
                if len(j):
                    unsure = differ[j] * 24 > both[j]
                    best = np.lexsort((node[some][j], label[some][j], unsure))[:width]
                    found.append((np.full(len(best), node[i]), node[some][j[best]], label[some][j[best]], unsure[best]))
    if not found:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _closest_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for rows in _groups(batches):
        if rows.num_rows > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in closest(rows, width)], names=["node", "other", "its_label", "unsure"])


def _judged(batches: Iterator[pa.RecordBatch], words_each: int) -> Iterator[pa.RecordBatch]:
    """Whether the other rows of a tile are linked with its home row, which comes first."""
    last = first = None
    for batch in batches:
        out = []
        for root, tile, home, node, text in rows_per_task([batch], ("root", "tile", "home", "node", "text")):
            if home:
                if last != (root, tile):
                    last, first = (root, tile), shingle_set(text, words_each)
            else:
                out.append((node, root, linked(first, shingle_set(text, words_each))))
        a, b, yes = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(yes, pa.bool_())], names=["a", "b", "yes"])


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def few(df: DataFrame) -> DataFrame:
    """``df``, a stored table, marked for broadcasting if it is small."""
    return F.broadcast(df) if df.count() <= FEW else df


def by_tile(rows: DataFrame, *order) -> DataFrame:
    """``rows`` (root, tile, ...) sorted for the functions that go through tiles."""
    return rows.repartition(parts_of(rows.sparkSession), "root", "tile").sortWithinPartitions("root", "tile", *order)


def drop_shuffles(spark: SparkSession) -> None:
    """Shuffle files of finished jobs stay until the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def joined(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that ``links`` (a, b; stored) lead to; a short list is worked out at once."""
    if links.count() > FEW_LINKS:
        return components(links)
    some = links.select(F.col("a").cast("long"), F.col("b").cast("long")).toArrow()
    node, root = stars(some["a"].to_numpy(), some["b"].to_numpy())
    own = np.unique(root)
    found = pa.table({"node": pa.array(np.concatenate([node, own]), pa.int64()), "root": pa.array(np.concatenate([root, own]), pa.int64())})
    return links.sparkSession.createDataFrame(found)


def candidates_of(nodes: DataFrame) -> DataFrame:
    """Stored node, root: which of ``nodes`` (stored: node, points) are connected by meetings."""
    met = nodes.select("node", "points").mapInArrow(_point_rows, "point bigint, node bigint")
    met = met.repartition(parts_of(nodes.sparkSession), "point").sortWithinPartitions("point", "node")
    return keep(joined(keep(met.mapInArrow(_meetings, "a bigint, b bigint").distinct())))


def _lots(rows: str, values: str, wider: int = 1):
    return F.ceil(F.greatest(F.col(rows) / (LOT * wider), F.col(values) / (LOT_VALUES * wider)))


def _each(n):
    """One copy of the row for each of the lots 0 .. n - 1."""
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def _dealt(n, column: str = "node"):
    return F.pmod(F.xxhash64(column), n)


def parity_lots(bits: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``bits`` (stored) with the lots of its whole root; of roots with more than one, the pairs of neighbouring size bands and their lots."""
    totals = bits.groupBy("root").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("values"))
    totals = few(keep(totals.select("root", _lots("rows", "values", WIDER).alias("all"))))
    rows = bits.join(totals, "root").withColumn("band", F.floor(F.log("n") / F.log(F.lit(BAND))).cast("long"))
    if not totals.filter("all > 1").head(1):
        return rows, None
    bands = rows.filter("all > 1").groupBy("root", "band").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("values"))
    bands = keep(bands.select("root", "band", _lots("rows", "values", WIDER).alias("lots")))
    other = bands.select(F.col("root").alias("of"), F.col("band").alias("home_band"), F.col("lots").alias("homes"))
    beside = bands.join(other, (F.col("root") == F.col("of")) & (F.abs(F.col("band") - F.col("home_band")) <= 1)).drop("of")
    return rows, few(keep(beside))  # a row per crowded set and pair of neighbouring bands


def parity_tiles(active: DataFrame, beside: DataFrame | None) -> DataFrame:
    """Rows (root, tile, home, ...) in which every two members of neighbouring size bands meet."""
    no, yes = F.lit(False), F.lit(True)
    what = ["node", "n", "bits", "label", "apart"]
    whole = active.filter("all = 1").select("root", F.lit(0).cast("long").alias("tile"), yes.alias("home"), *what)
    if beside is None:
        return whole
    rows = active.filter("all > 1")
    tile = F.xxhash64("home_band", "band", "home_lot", "lot").alias("tile")
    homes = rows.withColumnRenamed("band", "home_band").join(beside, ["root", "home_band"])
    homes = homes.withColumn("home_lot", _dealt(F.col("homes"))).withColumn("lot", _each(F.col("lots")))
    visitors = rows.join(beside, ["root", "band"]).withColumn("lot", _dealt(F.col("lots"))).withColumn("home_lot", _each(F.col("homes")))
    return whole.unionByName(homes.select("root", tile, yes.alias("home"), *what)).unionByName(visitors.select("root", tile, no.alias("home"), *what))


def judged_pairs(members: DataFrame, named: DataFrame, words_each: int) -> DataFrame:
    """Stored (a, b, yes) of the pairs ``named`` (stored: node, other, n): texts go to the partner they named, dealt to bounded lots."""
    lots = named.groupBy("other").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("values")).select("other", _lots("rows", "values").alias("lots"))
    beside = named.join(lots, "other").select("node", F.col("other").alias("root"), _dealt(F.col("lots")).alias("tile"), F.lit(False).alias("home"))
    homes = lots.select(F.col("other").alias("node"), F.col("other").alias("root"), _each(F.col("lots")).alias("tile"), F.lit(True).alias("home"))
    wanted = beside.unionByName(homes)  # less than twice as many rows as named
    wanted = F.broadcast(wanted) if 2 * named.count() <= FEW else wanted
    rows = by_tile(members.select("node", "text").join(wanted, "node"), F.desc("home"))
    return keep(rows.mapInArrow(partial(_judged, words_each=words_each), "a bigint, b bigint, yes boolean"))


def crowded_links(members: DataFrame, words_each: int) -> DataFrame:
    """Links in candidate sets of more than one lot; ``members`` is stored (node, root, n, text)."""
    spark, none = members.sparkSession, F.array().cast("array<bigint>")
    schema = "node bigint, root bigint, n bigint, bits binary"
    bits = keep(members.mapInArrow(partial(_parity_rows, words_each=words_each), schema).dropDuplicates(["node"]))
    rows, beside = parity_lots(bits)
    active = rows.withColumn("label", F.col("node")).withColumn("apart", none)
    pairs, width = None, 1
    while True:
        found = by_tile(parity_tiles(active, beside)).mapInArrow(partial(_closest_rows, width=width), "node bigint, other bigint, its_label bigint, unsure boolean")
        place = F.row_number().over(Window.partitionBy("node").orderBy("unsure", "its_label", "other"))
        named = keep(found.withColumn("place", place).filter(F.col("place") <= width).join(bits.select("node", "n"), "node").select("node", "other", "n"))
        if not named.head(1):
            break
        judged = judged_pairs(members, named, words_each)
        pairs = judged if pairs is None else pairs.unionByName(judged)
        label = few(joined(pairs.filter("yes").select("a", "b"))).withColumnRenamed("root", "label")
        no = pairs.filter("not yes").select("a", "b")
        apart = no.unionByName(no.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("apart"))
        again = rows.join(few(named.select("node")), "node", "left_semi").join(label, "node", "left").join(apart, "node", "left")
        active = again.withColumn("label", F.coalesce("label", "node")).withColumn("apart", F.coalesce("apart", none))
        drop_shuffles(spark)
        width *= 4
    forget(bits)
    return spark.createDataFrame([], "a bigint, b bigint") if pairs is None else pairs.filter("yes").select("a", "b")


def linked_nodes(docs: DataFrame, nodes: DataFrame, candidates: DataFrame, words_each: int) -> DataFrame:
    """Links (a, b) that connect what all links of ``nodes`` (stored: node, line, n) connect; ``candidates`` is stored (node, root)."""
    own = candidates.join(nodes.select("node", "line", "n"), "node")
    size = candidates.join(nodes.select("node", "n"), "node").groupBy("root").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("values"))
    wanted = keep(own.join(size.select("root", _lots("rows", "values").alias("lots")), "root"))

    def rows(which: str) -> DataFrame:
        lines = texts(docs, line_of().alias("line")).join(few(wanted.filter(which).drop("lots")), "line").select("node", "root", "n", "text")
        return lines.mapInArrow(_once, "node bigint, root bigint, n bigint, text binary")

    small = by_tile(rows("lots = 1").select("root", F.lit(0).cast("long").alias("tile"), "node", "text"))
    found = small.mapInArrow(partial(_tiles, words_each=words_each), "a bigint, b bigint")
    if not wanted.filter("lots > 1").head(1):
        return found
    found = keep(found)
    drop_shuffles(docs.sparkSession)
    members = keep(rows("lots > 1"))
    drop_shuffles(docs.sparkSession)
    crowded = crowded_links(members, words_each)
    forget(members)
    return found.unionByName(crowded)


def line_of():
    """A number of a row by its doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), whole_text())


def jaccard_groups(docs: DataFrame, words_each: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id that links lead to) of every row of ``docs``."""
    schema = "doc_id bigint, line bigint, mark0 bigint, mark1 bigint, n bigint, points array<bigint>"
    own = keep(texts(docs, line_of().alias("line")).mapInArrow(partial(_sketches, words_each=words_each), schema))
    same = own.filter("n > 0").groupBy("mark0", "mark1").agg(
        F.min("doc_id").alias("first_id"), F.min("line").alias("line"), F.min("n").alias("n"), F.first("points").alias("points"))
    met = keep(same.withColumn("node", F.monotonically_increasing_id()))
    drop_shuffles(docs.sparkSession)
    wide, own = own, keep(own.drop("points"))
    forget(wide)
    candidates = candidates_of(met)
    nodes = keep(met.drop("points"))
    forget(met)
    drop_shuffles(docs.sparkSession)
    roots = keep(joined(keep(linked_nodes(docs, nodes, candidates, words_each))))
    named = nodes.select("mark0", "mark1", "node", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    groups = keep(named.join(smallest, "root").select("mark0", "mark1", "component_id"))
    forget(nodes)
    return own.join(groups, ["mark0", "mark1"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(documents(spark, sf_dir))


OP12_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')] ELSE
         list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS own FROM w),
v AS (SELECT doc_id, len(own) AS n, unnest(own) AS x FROM s),
links AS (
  SELECT p.doc_id AS a, q.doc_id AS b FROM v p JOIN v q ON p.x = q.x AND p.doc_id <> q.doc_id AND p.n * 10 >= q.n * 9 AND q.n * 10 >= p.n * 9
  GROUP BY p.doc_id, q.doc_id, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))),
reached AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b)
SELECT s.doc_id, CAST(len(own) AS BIGINT) AS n_shingles, m.component_id
FROM s JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY a) m ON m.a = s.doc_id
"""
