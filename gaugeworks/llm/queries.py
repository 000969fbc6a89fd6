"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module of this subpackage; each module holds the query under its own name and its SQL, where SQL can say it.
MODULES = {
    "op1_simhash_near_dedup": "simhash",
    "op2_language_id": "language_id",
    "op3_secrets": "secrets",
    "op4_suffix_dedup": "suffix_dedup",
    "op5_best_fit_packing": "packing",
    "op6_hmm_scoring": "hmm",
    "op7_exact_topk": "topk",
    "op8_exact_dedup": "exact_dedup",
    "exact_dedup_batches": "exact_dedup",
    "op10_toxicity": "toxicity",
    "op9_mixing": "mixing",
    "op11_merkle_manifest": "merkle",
    "op12_ngram_jaccard_join": "jaccard_join",
    "op13_embedding_whitening": "whitening",
}


def _load():
    queries, sql = {}, {}
    for name, module in MODULES.items():
        own = import_module(f"gaugeworks.llm.{module}")
        queries[name] = getattr(own, name)
        statement = getattr(own, name.split("_")[0].upper() + "_SQL", None)
        if statement:
            sql[name] = statement
    return queries, sql


QUERIES, SQL = _load()
