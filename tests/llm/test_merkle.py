import zlib
from hashlib import sha256

import pytest
from odd import empty, table

from gaugeworks.llm.merkle import fold, levels_of, manifest, paths, reduced


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    out = ""
    for value in (row.doc_id, row.source, row.lang, row.n_chars if row.n_chars is None else row.n_chars + more, row.text):
        out += "-" if value is None else f"{len(str(value).encode())}:{value}"
    return digest(out)


def plain_tree(nodes):
    """Root, and for each leaf the siblings by level with their side."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    proofs = []
    for i in range(len(nodes)):
        proof = []
        for level in levels[:-1]:
            run = level[i // 2 * 2:i // 2 * 2 + 2]
            proof.append((run[1 - i % 2] if len(run) > 1 else "", i % 2))
            i //= 2
        proofs.append(proof)
    return levels[-1][0], proofs


def brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r.lang, []).append(r)
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    parts = {}
    for lang in order:
        parts[lang] = sorted(trees[lang], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
    below = {lang: plain_tree([leaf(r) for r in parts[lang]]) for lang in order}
    root, above = plain_tree([below[lang][0] for lang in order])
    out = []
    for lang, top in zip(order, above, strict=True):
        for r, proof in zip(parts[lang], below[lang][1], strict=True):
            tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            h = leaf(r, int(tampered))
            for sibling, right in proof + top:
                h = digest(sibling, h) if right else digest(h, sibling)
            out.append((str(r.doc_id), leaf(r), below[lang][0], root, digest(*(s for s, _ in proof + top)), h, h == root))
    return sorted(out)


def got(docs, bits):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in manifest(docs, bits).collect())


@pytest.mark.parametrize("bits", [2, 10])
def test_odd_rows_against_brute_force(spark, bits):
    docs = table(spark)
    want = brute(docs.collect())
    assert got(docs, bits) == want
    assert {w[-1] for w in want} == {True, False}


def test_many_languages_and_one_row_each(spark):
    schema = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree string, place int"
    docs = spark.createDataFrame([(i, "s", f"l{i:03d}é" if i % 9 else None, 5, "x", "t", 1) for i in range(75)], schema).repartition(7)
    assert got(docs, 3) == brute(docs.collect())
    one = docs.filter("doc_id = 4")
    assert got(one, 3) == brute(one.collect()) and one.count() == 1
    two = docs.filter("doc_id in (4, 5)")
    assert got(two, 10) == brute(two.collect())


def test_one_repeated_row(spark):
    docs = table(spark).filter("doc_id = 108")
    docs = docs.unionByName(docs).unionByName(docs).unionByName(docs).unionByName(docs)
    out = manifest(docs, 1).collect()
    assert len(out) == 5 and len({r.leaf for r in out}) == 1 and len({r.proof_sha256 for r in out}) == 2
    assert got(docs, 1) == brute(docs.collect())


def test_empty(spark):
    out = manifest(empty(spark))
    assert out.count() == 0 and out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_pure_parts():
    nodes = [digest(str(i)) for i in range(13)]
    levels = reduced(nodes, None)
    assert [len(x) for x in levels] == [13, 7, 4, 2, 1]
    assert all(fold(n, p) == levels[-1][0] for n, p in zip(nodes, paths(levels), strict=True))
    assert fold(digest("other"), paths(levels)[0]) != levels[-1][0]
    assert [len(x) for x in reduced(nodes[:1], 3)] == [1, 1, 1, 1] and levels_of(8, 3) is None and levels_of(9, 3) == 3
