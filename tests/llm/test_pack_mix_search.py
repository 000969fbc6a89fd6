"""Packing, mixing, top-k search and the pipeline."""

import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from gaugeworks.llm import mixing, packing, queries, topk
from tests.llm import odd


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 9), min_size=1, max_size=30))
@settings(max_examples=60, deadline=None)
def test_plan_uses_every_piece_once(counts):
    bins = packing.plan(counts, 64)
    used = defaultdict(int)
    for times, content in bins:
        assert sum(k * m for k, m in content.items()) <= 64
        for k, m in content.items():
            used[k] += m * times
    assert dict(used) == counts
    total = sum(k * n for k, n in counts.items())
    assert sum(t for t, _ in bins) <= math.ceil(total / 64) * 1.7 + 1


@given(st.integers(0, 60), st.lists(st.tuples(st.integers(1, 40), st.integers(1, 3)), max_size=6, unique_by=lambda x: x[0]))
@settings(max_examples=100, deadline=None)
def test_fullest_combination(room, left):
    best = {0}
    for length, n in left:
        best = {b + length * m for b in best for m in range(n + 1) if b + length * m <= room}
    found = packing.fullest(room, sorted(left, reverse=True))
    assert sum(k * m for k, m in found.items()) == max(best)
    assert all(found[k] <= n for k, n in left if k in found)


@given(st.text(max_size=80))
@settings(max_examples=150, deadline=None)
def test_word_ids_are_those_of_the_whole_text(text):
    encode = packing.word_ids(packing.default_tokenizer())
    text = text.encode("utf-8", "ignore").decode()
    want = encode.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encode(text.encode()), "<u4").tolist() == want


def test_word_ids_with_little_memory(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED_WORDS", 5)
    encode = packing.WordIds(packing.default_tokenizer())
    for text in ("one two, three four. five! six seven eight nine. ten", "one two <|endoftext|> Three, TWO. it's its'"):
        assert np.frombuffer(encode(text.encode(), 3), "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_word_ids_of_many_texts_at_once():
    encode = packing.WordIds(packing.default_tokenizer(), 50)
    texts = ["Ärger, ÄRGER ΑΣ ας İstanbul été ﬁn e\u0301te\u0301. a1b2 x!! !x gever### été... x[1]", "", "日本語 テスト。 q <|endoftext|> <|EndOfText|>, kİ ß ẞ", "한국 ǅ ʰ don't, it's. y'",
             " ".join(f"word{'abc'[i % 3] * (i % 7)}{'xyz'[i % 3]} rest{i}," for i in range(300)), "été gever### word"] * 2
    for step in (4, 1 << 16):
        for text, ids in zip(texts, encode.of_texts([t.encode() for t in texts], step), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_packed_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ROWS", 4)
    docs, tokenizer = odd.table(spark), packing.word_ids(packing.default_tokenizer()).tokenizer
    placed = packing.pack(packing.pieces_of(docs, packing.default_tokenizer(), with_ids=True))
    found = placed.drop("ids").collect()
    want = []
    for r in odd.rows():
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want += [(str(r[0]), k, k * 2048, len(ids[k * 2048:][:2048]), zlib.crc32(np.array(ids[k * 2048:][:2048], "<u4").tobytes())) for k in range(-(-len(ids) // 2048))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(want)
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == math.ceil(sum(w[3] for w in want) / 2048)
    assert {r.sequence_id: len(r.ids) for r in packing.sequences(placed).collect()} == {k: sum(n for _, n in v) for k, v in bins.items()}
    assert packing.pack(packing.pieces_of(odd.empty(spark), packing.default_tokenizer())).count() == 0


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in names if s not in capped)
        left = total - sum(most * sizes[s] for s in capped)
        over = {s for s in names if s not in capped and weight[s] * left / free > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else weight[s] * left / free for s in names}
        capped |= over


def test_mix_of_odd_documents(spark):
    docs = odd.table(spark)
    found = mixing.repetitions(mixing.sized(docs)).collect()
    sizes = defaultdict(int)
    for r in odd.rows():
        sizes[r[3]] += len((r[1] or "").split())
    want = plain_targets(sizes)
    assert len(found) == len(odd.rows())
    for source in sizes:
        mine = [r for r in found if r.source == source]
        assert all(r.source_size == sizes[source] and math.isclose(r.target, want[source]) for r in mine)
        assert all(0 <= r.times <= 3 for r in mine)
        assert abs(sum(r.size * r.times for r in mine) - want[source]) <= max(r.size for r in mine) / 2 + 1
    again = mixing.repetitions(mixing.sized(docs.repartition(7))).collect()
    key = lambda rows: sorted((str(r.doc_id), r.size, r.times) for r in rows if r.doc_id not in (None, 115))
    assert key(found) == key(again)
    taken = mixing.mixed_documents(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r.times for r in found)
    assert mixing.repetitions(mixing.sized(odd.empty(spark))).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1, "c": 1}, {"a": 5, "b": 0, None: 7}, {"only": 3}, {"a": 0}, {f"s{i:03}": i * i % 97 for i in range(60)}])
def test_water_level(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    found = {r.source: r.target for r in mixing.water_filled(mixing.source_weights(table)).collect()}
    want = plain_targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    assert found.keys() == want.keys() and all(math.isclose(found[s], want[s]) for s in sizes)


def plain_best(rows, k):
    out = {}
    for q, v in rows:
        if q % 50 == 0:
            scores = sorted(((-int(np.dot(v, w)), i) for i, w in rows if i != q))
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def test_top_products_against_brute_force(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (9, 12))
    vectors = [(i, (centres[i % 9] + rng.normal(0, 0.05, 12)).astype(float).tolist()) for i in range(900)] + [(i, [0.5] * 12) for i in range(900, 1300)]
    bad = [(1350, None), (1400, []), (1450, [None] * 12), (1500, [float("nan")] * 12), (1550, [float("inf")] * 12), (None, [0.5] * 12), (1600, [1.0]), (900, [0.5] * 12)]
    table = spark.createDataFrame(vectors + bad, "vec_id bigint, embedding array<double>")
    want = plain_best([(i, np.floor(256 * np.array(v))) for i, v in vectors], 5)
    rows = topk.vectors_of(table)
    for block, parts in ((8192, 128), (100, 4), (8192, 1)):
        got = defaultdict(list)
        for r in sorted(topk.top_products(rows, rows.filter("vec_id % 50 = 0"), block=block, most_parts=parts).collect(), key=lambda r: (r.query_id, r.rank)):
            got[r.query_id].append((r.vec_id, r.score))
        assert got == want
    empty = topk.vectors_of(table.limit(0))
    assert topk.top_products(empty, empty).count() == 0


def test_parts_that_cannot_reach_the_floor_are_not_visited():
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(c, 0.02, (50, 8)) for c in rng.normal(0, 1, (20, 8))]) * 1000
    centres = topk.far_apart(points, 20)
    assert len(centres) == 20 and len(topk.far_apart(np.repeat(points[:3], 9, 0), 20)) == 3
    nearest = ((points[:, None] - centres) ** 2).sum(2).argmin(1)
    radius = np.array([np.sqrt(((points[nearest == i] - c) ** 2).sum(1)).max() for i, c in enumerate(centres)])
    lots = np.full(20, 2)
    lots[nearest[-1]] = 0  # taken for empty
    products = points @ points.T
    floor = np.sort(products, 1)[:, -5]
    batch = pa.RecordBatch.from_pydict({"dim": [8] * 1000, "crew": [0] * 1000, "floor": floor, "vec_id": range(1000), "v": points.tolist()})
    visits = {first: [(r["vec_id"], r["part"], r["lot"]) for b in topk._visits(iter([batch]), {8: topk.Part(centres, radius, lots)}, first) for r in b.to_pylist()] for first in (True, False)}
    assert len(visits[True]) == 2000 and len(set(visits[True])) == 2000
    assert len(visits[False]) < 0.3 * 1000 * 19 * 2 and not set(visits[True]) & set(visits[False])
    met = {(q, p) for v in visits.values() for q, p, _ in v}
    assert all((q, nearest[x]) in met for q, x in np.argwhere(products >= floor[:, None]) if nearest[x] != nearest[-1])


def test_trees_cover_and_prune():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(c, 0.02, (300, 8)) for c in rng.normal(0, 1, (20, 8))])
    seen, stack = [], [topk.cover_tree(points)]
    while stack:
        node = stack.pop()
        assert np.sqrt(((points[node.members] - node.centre) ** 2).sum(1)).max() <= node.radius + 1e-6
        stack += node.children
        seen += [] if node.children else node.members.tolist()
    assert sorted(seen) == list(range(len(points)))
    search = topk.Search(np.arange(600) + 10 ** 6, points[:600], np.arange(len(points)), points, 5)
    search.run()
    assert search.compared < 0.15 * 600 * len(points)
    assert np.allclose(search.scores, -np.sort(-(points[:600] @ points.T), axis=1)[:, :5])


def test_pipeline_stages(spark, tmp_path):
    odd.table(spark).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
    ids = {r.doc_id for r in spark.read.parquet(f"{tmp_path}/simhash_near_dedup").collect()}
    assert 103 not in ids and 105 in ids and not ids & {106, 107, 111}
    assert counts[0] >= counts[1] >= counts[2] and counts[4] >= counts[3]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from check import TABLES, rows_of
    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in TABLES.split():
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = queries.QUERIES[name](spark, folder)
    rel = duck.execute(queries.SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, rel.fetchall())
