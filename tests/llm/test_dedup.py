"""Exact dedup, SimHash groups and repeated passages against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from gaugeworks.llm import exact_dedup, simhash, suffix_dedup
from gaugeworks.llm.components import components
from tests.llm import odd


def test_exact_batch_can_be_repeated_after_a_stop(spark):
    index = exact_dedup.own_index(spark)
    docs = spark.createDataFrame([(i, f"text {i % 6}") for i in range(12)], "doc_id bigint, text string").repartition(3)
    exact_dedup.exact_dedup(docs.filter("doc_id = 5"), index, "earlier")
    index.admit(exact_dedup.digest_rows(docs), "mine")  # and stopped before its verdict
    again = docs.repartition(5)  # rows are numbered otherwise in the second attempt
    for _ in range(2):
        kept = exact_dedup.keep_first_copies(again, index, "mine")
        assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4]
        assert sorted(r.doc_id for r in exact_dedup.exact_dedup(again, index, "mine").filter("kept").collect()) == [0, 1, 2, 3, 4]
    assert index.read().count() == 6 and exact_dedup.keep_first_copies(again, index, "later").count() == 0


def test_exact_verdicts(spark):
    found = exact_dedup.exact_dedup(odd.table(spark), exact_dedup.own_index(spark)).collect()
    groups = defaultdict(list)
    for r in odd.rows():
        groups[re.sub(r"[\x20\x09-\x0d]", "", r[1] or "")].append(r)
    assert len(found) == len(odd.rows())
    by_digest = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in found:
        members = by_digest[r.text_sha256]
        stays = min(members, key=lambda m: (-len(m[1] or ""), m[0] is not None, m[0] or 0))
        assert (r.keep_id, r.group_size) == (stays[0], len(members))
    assert sum(r.kept for r in found) == len(groups)


def test_exact_index_lasts(spark):
    index = exact_dedup.own_index(spark)
    docs = odd.table(spark)
    first = exact_dedup.exact_dedup(docs.filter("doc_id < 20"), index)
    assert first.filter("kept").count() == index.read().count()
    again = exact_dedup.exact_dedup(docs, index).collect()
    assert not any(r.kept for r in again if r.doc_id is not None and r.doc_id < 20)
    assert index.read().count() == len({r.text_sha256 for r in again})
    assert exact_dedup.exact_dedup(docs, index).filter("kept").count() == 0
    assert exact_dedup.exact_dedup(odd.empty(spark), index).count() == 0


def test_batches_meet_what_came_before(spark):
    """Texts of the first batch stay with it; of the others the longest spelling in the second batch stays."""
    index = exact_dedup.own_index(spark)
    rows = [(i, f"text {i % 6}" + " " * (i % 4)) for i in range(24)] + [(None, "text 0")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = exact_dedup.dedup_in_batches(docs, index, F.when(F.col("doc_id") < 3, 0).otherwise(1), 3).collect()
    assert len(found) == 25 and index.read().count() == 6
    want = {k: k if k < 3 else min(range(k, 24, 6), key=lambda i: (-(i % 4), i)) for k in range(6)}
    assert {r.doc_id for r in found if r.kept} == set(want.values()) and sum(r.kept for r in found) == 6
    assert all(r.keep_id == want[(r.doc_id or 0) % 6] and r.batch == int(r.doc_id is None or r.doc_id > 2) for r in found)
    empty = exact_dedup.dedup_in_batches(odd.empty(spark), index, F.lit(0), 2)
    assert empty.count() == 0 and index.read().count() == 6


def test_exact_native_plan(spark):
    plan = exact_dedup.exact_dedup(odd.table(spark), exact_dedup.own_index(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_first_copies_stay(spark):
    kept = exact_dedup.keep_first_copies(odd.table(spark), exact_dedup.own_index(spark))
    assert kept.columns == odd.table(spark).columns
    texts = [re.sub(r"\s", "", r.text or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"\s", "", r[1] or "") for r in odd.rows()})


def plain_fingerprint(text, k):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(marks, near):
    """Brute-force components of marks by a link rule."""
    marks, label = list(marks), {}
    for m in marks:
        same = {label[o] for o in label if near(o, m)}
        label[m] = m
        for o in label:
            if label[o] in same:
                label[o] = m
    return label


def test_fingerprints_and_groups(spark):
    docs = odd.table(spark)
    found = simhash.near_groups(docs, 3, 2).collect()
    mark = {(r[0], r[1]): plain_fingerprint(r[1], 3) for r in odd.rows()}
    label = groups_of(set(mark.values()), lambda a, b: (a ^ b).bit_count() <= 2)
    smallest = defaultdict(list)
    for (doc_id, _), m in mark.items():
        smallest[label[m]].append(doc_id)
    want = sorted((str(d), m, min((x for x in smallest[label[m]] if x is not None), default=None)) for (d, t), m in mark.items() for _ in range(2 if d == 115 else 1))
    assert sorted((str(r.doc_id), r.mark0 % 2 ** 64, r.component_id) for r in found) == want
    assert simhash.near_groups(odd.empty(spark), 3, 2).count() == 0


def test_long_texts_are_hashed_in_slices(monkeypatch):
    text = " ".join(str(i * i) for i in range(1000))
    monkeypatch.setattr(simhash, "SLICE", 17)
    assert simhash.fingerprint(text.encode(), 3) == [plain_fingerprint(text, 3)]


def test_anchors_find_all_links(spark, monkeypatch):
    """Clouds of near points, with crowded anchors split and small comparison blocks."""
    monkeypatch.setattr(simhash, "HOMES", 7)
    rng = np.random.default_rng(3)
    points = set()
    for _ in range(12):
        centre = int(rng.integers(0, 2 ** 63))
        points |= {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(40)}
    points = sorted(p & (2 ** 63 - 1) for p in points)
    nodes = spark.createDataFrame([(i, p) for i, p in enumerate(points)], "node bigint, mark0 bigint")
    for threshold in (2, 7):
        links = simhash.near_links(nodes, ["mark0"], threshold, threshold)
        root = {r.node: r.root for r in components(links).collect()}
        label = groups_of(points, lambda a, b, t=threshold: (a ^ b).bit_count() <= t)
        want, got = defaultdict(set), defaultdict(set)
        for i, p in enumerate(points):
            want[label[p]].add(i)
            got[root.get(i, i)].add(i)
        assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (-5, -9), (-9, -5)], "a bigint, b bigint")
    found = {r.node: r.root for r in components(links).collect()}
    assert found == {**{i: 0 for i in range(61)}, -5: -9, -9: -9}


def test_near_copies_leave_one(spark):
    kept = {r.doc_id for r in simhash.keep_one_of_each_group(odd.table(spark)).select("doc_id").collect()}
    assert {105, 108} <= kept and not kept & {106, 107, 110, 111} and None in kept


def plain_removal(docs, length=100):
    seen, out = set(), {}
    for key, raw in docs:
        hit = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            window = raw[i:i + length]
            if window in seen:
                hit[i:i + length] = True
            seen.add(window)
        kept = bytes(b for b, x in zip(raw, hit, strict=True) if not x)
        out[key] = (len(raw), int(hit.sum()), int((hit & ~np.append(False, hit[:-1])).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_against_brute_force(spark):
    rows = odd.rows()
    key = lambda r: (r[0] is not None, r[0] or 0)
    single = [r for r in rows if r[0] is not None]
    want = plain_removal([(r[0], (r[1] or "").encode()) for r in sorted({r[:2]: r for r in single}.values(), key=key)])
    docs = odd.table(spark).filter("doc_id IS NOT NULL")
    for block in (2048, 3):  # small blocks: buckets in several lots
        found = suffix_dedup.remove_repeats(docs, block=block).collect()
        assert len(found) == len(single)
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == want
    assert suffix_dedup.remove_repeats(odd.empty(spark)).count() == 0
    assert suffix_dedup.remove_repeats(odd.table(spark)).filter("doc_id IS NULL").count() == 2


def test_rows_after_an_overflow_are_still_compared():
    rng = np.random.default_rng(3)
    parts = [bytes(rng.integers(97, 123, 120).astype(np.uint8)) for _ in range(40)]
    parts[30] = parts[0]  # comes long after the first block has gone
    names = ("h", "lot", "lots", "doc", "tag", "start")
    rows = [(7, 0, 1, i, 0, 0, p) for i, p in enumerate(parts)] + [(8, 0, 1, 99, 0, 0, parts[1])]
    batches = [pa.RecordBatch.from_pylist([dict(zip((*names, "part"), r, strict=True)) for r in rows[i:i + 8]]) for i in range(0, len(rows), 8)]
    found = [r for b in suffix_dedup._sort_buckets(iter(batches), 4) for r in b.to_pylist()]
    open_ = {}
    for r in found:
        if not r["settled"]:
            open_.setdefault((r["h"], r["wh"]), set()).add(r["doc"])
    assert sum(docs == {0, 30} for docs in open_.values()) == 21 and not any(r["settled"] for r in found)


def test_slices_of_long_texts(monkeypatch):
    rng = np.random.default_rng(5)
    text = rng.integers(97, 101, 5000).astype(np.uint8)
    whole = suffix_dedup.segments(text, np.array([5000]))
    windows = lambda s: {(int(a) + i, int(h)) for a, n, h, _ in zip(*s, strict=True) for i in range(n)}
    assert len(windows(whole)) == 4901
    parts = set()
    for at in range(0, 4901, 700):
        found = suffix_dedup.segments(text[at:at + 799], np.array([len(text[at:at + 799])]))
        parts |= {(p + at, h) for p, h in windows(found)}
    assert parts == windows(whole)


def test_suffix_order_matches_plain_sort():
    rng = np.random.default_rng(9)
    shared = bytes(rng.integers(97, 99, 150).astype(np.uint8))
    parts = [bytes(rng.integers(97, 99, 30).astype(np.uint8)) + shared[:rng.integers(90, 150)] for _ in range(30)] + [b"a" * 140, b"a" * 150]
    text = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts])
    end = np.repeat(np.cumsum(size), size)
    inside = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
    at = np.flatnonzero(end - np.arange(len(text)) >= suffix_dedup.LENGTH)
    place = (inside + np.repeat(rng.integers(0, 999, len(parts)), size)) % suffix_dedup.COVER
    order, tie = suffix_dedup.sorted_suffixes(text, place, end, at, np.zeros(len(at), np.int64))
    suffixes = [text[a:end[a]].tobytes() for a in at[order]]
    assert suffixes == sorted(suffixes)
    assert [False] + [a[:32] == b[:32] for a, b in zip(suffixes, suffixes[1:])] == tie.tolist()  # noqa: B905
