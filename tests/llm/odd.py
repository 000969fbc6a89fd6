"""Awkward document tables for all operators."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, kept boolean, h string, doc bigint, times int"


def prose(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def rows(seed=1, n=40):
    """Nulls in every column, empty and long texts, exact and near copies, repeated rows, ties and columns with clashing names."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgilmnorst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    long = prose(rng, 4000, words)
    base = prose(rng, 120, words)
    out = [(i, prose(rng, rng.randint(1, 150), words), rng.choice(["en", "de", None]), rng.choice(["a", "b", None])) for i in range(n)]
    out += [(100, None, "en", "a"), (101, "", None, None), (102, " \t\n", "de", "b"), (103, "?!. 123", "en", "a"), (104, "x", "en", "a"),
            (105, long, "en", "b"), (106, long, "de", "b"), (107, long + " end", "en", "a"), (108, base, "en", "a"), (109, base + " more words", "en", "a"),
            (110, base.replace(" ", "  "), "en", "b"), (111, base, None, "c"), (112, "é" * 300, "fr", "c"), (113, "日本 " * 80, None, "c"),
            (114, "a" * 700, "en", "a"), (None, base, "en", "a"), (None, None, None, None), (115, "x", "en", "a"), (115, "x", "en", "a"), (116, "Zeile " + base, "de", "b")]
    return [(i, t, lang, source, len(t) if t else None, 1, True, "h", 2, 3) for i, t, lang, source in out]


def table(spark, **options):
    return spark.createDataFrame(rows(**options), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
