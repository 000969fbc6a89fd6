"""The near-dedup stage of the pipeline goes by SimHash fingerprints, and joins groups of exact sets to theirs."""

import corpus_pipeline
from gaugeworks.llm import simhash


def test_near_fingerprints_leave_one(spark):
    line = " ".join(f"w{i}" for i in range(12))
    texts = [" ".join([line] * 60 + [f"{tail}{i}" for i in range(12)]) for tail in "xy"]  # equal majorities, sets at a similarity below 0.5
    texts += ["one quite other text that stays", line]
    marks = [simhash.fingerprint(t.encode(), 3)[0] for t in texts]
    assert (marks[0] ^ marks[1]).bit_count() <= 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    groups = {r.doc_id: r.component_id for r in simhash.near_groups(docs, 3, 2).collect()}
    kept = {r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()}
    assert kept == {d for d, c in groups.items() if d == c} and 0 in kept and 1 not in kept and 2 in kept
