import random

import numpy as np
import pyarrow as pa
import pytest
from odd import empty, prose, table

from gaugeworks.llm import jaccard_join
from gaugeworks.llm.jaccard_join import bitmaps, closest, jaccard_groups, linked, meeting_points, parities, parity_bits, shingle_set, tile_links

BLANKS = " \t\n\x0b\x0c\r"


def plain_set(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in BLANKS:
            words, word = words + [word] if word else words, ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    if len(words) < 3:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 3]) for i in range(len(words) - 2)}


def brute(rows):
    """(doc_id, n_shingles, component_id) by comparing everything with everything."""
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= 90 * (len(sets[i]) + len(sets[j]) - shared):
                parent[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(doc_id, least.get(top(i), doc_id))
    return sorted(((d, len(s), least.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got(docs):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(docs).collect()), key=str)


def changed(rng, text, n, vocabulary):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
    return " ".join(words)


def families(seed, n, copies, most):
    """Texts of many lengths, each with copies of copies around the threshold."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgilmnorst") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    out = []
    for _ in range(n):
        out.append(prose(rng, rng.choice([4, 12, 13, 25, 60, 140, 400]), vocabulary))
        for _ in range(rng.randint(0, copies)):
            out.append(changed(rng, rng.choice(out[-3:]), rng.randint(0, most), vocabulary))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed, n, copies, most", [(1, 60, 4, 3), (2, 4, 60, 5)])
def test_against_brute_force(spark, seed, n, copies, most):
    rows = families(seed, n, copies, most)
    want = brute(rows)
    assert len({c for *_, c in want}) < len(want)
    assert got(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)) == want


def test_crowded_sets_in_small_lots(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LOT", 5)  # read by the driver only
    rows = families(3, 3, 50, 4)
    assert got(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)) == brute(rows)


def test_odd_rows(spark):
    docs = table(spark)
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert jaccard_groups(empty(spark)).count() == 0


def test_linked_sets_always_meet():
    rng = np.random.default_rng(5)
    for size in [9, 10, 11, 18, 19, 28, 29, 30, 57, 58, 100, 181, 400, 2000]:
        for _ in range(40):
            one = np.unique(rng.integers(0, 1 << 64, size, np.uint64, endpoint=False))
            other = one[rng.permutation(len(one))]
            while True:  # as many changes as the threshold allows
                less = rng.random() < 0.5
                new = np.concatenate([other[1:], rng.integers(0, 1 << 64, 1 - less, np.uint64, endpoint=False)])
                shared = len(np.intersect1d(new, one))
                if not len(new) or 19 * shared < 9 * (len(new) + len(one)):
                    break
                other = new
            other = np.unique(other)
            assert linked(one, other) and linked(other, one)
            assert len(other) == len(one) and (one == other).all() or np.intersect1d(meeting_points(one), meeting_points(other)).size


def test_sets_in_few_segments_meet():
    low = np.arange(1, 12, dtype=np.uint64)  # all in the first segment
    assert np.intersect1d(meeting_points(low), meeting_points(low[1:])).size


def test_bitmaps_bound_the_overlap_from_above():
    rng = np.random.default_rng(6)
    for bits in (64, 1024):
        one, other = (np.unique(rng.integers(0, 90, 60).astype(np.uint64)) for _ in range(2))
        a, b = bitmaps([one, other], bits)
        assert len(np.intersect1d(one, other)) <= (len(one) + len(other) - int(np.bitwise_count(a ^ b).sum())) / 2


def test_tiles_skip_what_is_connected():
    sets = [np.arange(i, 100 + i, dtype=np.uint64) for i in range(4)]
    node, yes = np.arange(4), np.ones(4, bool)
    assert len(tile_links(node, sets, yes, ~yes)) == 3
    assert tile_links(node, sets, np.array([True, False, False, False]), ~yes, star=True) == [(1, 0), (2, 0), (3, 0)]
    assert len(tile_links(node, sets, np.array([True, False, False, False]), np.array([False, True, True, True]))) == 1


def test_shingles():
    assert len(shingle_set(b" A b\tC d ")) == 2 and (shingle_set(b"a B c D") == shingle_set(b"A b  C d")).all()
    assert len(shingle_set(b"")) == 0 and len(shingle_set(b"x y")) == 1
    assert shingle_set("É".encode())[0] != shingle_set("é".encode())[0]


def shuffled(spark):
    """Bytes written to shuffles by all stages so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_crowded_long_texts_are_not_copied_to_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LOT_VALUES", 1 << 14)  # read by the driver only
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefgilmnorst") for _ in range(5)) for _ in range(400)]
    base = prose(rng, 3000, vocabulary)
    rows = [(i, changed(rng, base, rng.randint(20, 50), vocabulary)) for i in range(60)]
    docs, before = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2), shuffled(spark)
    found = got(docs)
    moved = shuffled(spark) - before
    assert found == brute(rows)
    assert moved < 3 * 8 * sum(n for _, n, _ in found), moved


def test_parities_never_rule_out_a_link():
    rng = np.random.default_rng(8)
    sets = []
    for size in (12, 60, 120, 127, 128, 130, 400):
        base = rng.integers(0, 1 << 64, size, np.uint64, endpoint=False)
        for less in range(0, size // 6, max(1, size // 40)):
            sets.append(np.unique(np.concatenate([base[less:], rng.integers(0, 1 << 64, less // 2, np.uint64, endpoint=False)])))
    many = len(sets)
    rows = pa.table({"node": np.arange(many), "n": [len(s) for s in sets], "label": np.arange(many), "home": np.ones(many, bool),
                     "bits": pa.array([parities(s) for s in sets], pa.binary()), "apart": pa.array([[]] * many, pa.list_(pa.int64()))})
    node, other, _, _ = closest(rows, many)
    named = set(zip(node.tolist(), other.tolist(), strict=True))
    want = {(i, j) for i in range(many) for j in range(many) if i != j and linked(sets[i], sets[j])}
    assert len({parity_bits(len(s)) for s in sets}) > 3 and want and want <= named
    assert len(closest(rows.set_column(rows.schema.get_field_index("label"), "label", pa.array(np.zeros(many, np.int64))), many)[0]) == 0
