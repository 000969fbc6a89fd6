"""Near copies of the pipeline against brute force over exact five-word Jaccard similarities."""

import random

from gaugeworks.llm import near_copies, simhash


def plain_set(text):
    words = text.split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def altered(rng, words, places):
    words = list(words)
    for at in rng.sample(range(len(words)), places):
        words[at] = f"x{rng.randrange(10 ** 9)}"
    return words


def clouds(seed, groups, each, length, places):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(length)]
        out += [" ".join(altered(rng, base, rng.randint(*places) if i else 0)) for i in range(each)]
    rng.shuffle(out)
    return out


def plain_kept(texts):
    sets, label = [plain_set(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 5 * both >= 4 * (len(a) + len(sets[j]) - both) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return {i for i, x in enumerate(label) if x == i}


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id for r in simhash.keep_one_of_each_group(docs).select("doc_id").collect()}


def test_pairs_on_both_sides_of_the_similarity(spark):
    texts = clouds(1, 150, 2, 250, (3, 9))
    assert kept(spark, texts) == plain_kept(texts)


def test_crowded_sets_in_small_lots(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "LOT", 5)
    monkeypatch.setattr(near_copies, "SLICE", 33)
    texts = clouds(2, 6, 30, 220, (1, 6))
    want = plain_kept(texts)
    assert 6 < len(want) < 120
    assert kept(spark, texts) == want
