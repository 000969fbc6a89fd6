"""Language of a text: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1-, 2- and 3-grams of the lower-cased text, with everything that is no letter folded to single blanks, are hashed to a
fixed number of features. Document frequencies are counted over all training documents: each task sums its own and the sums
are grouped by feature. The classifier is fitted on a sample of at most about ``fit_rows`` labelled documents, drawn by a hash of
doc_id, with follow-the-regularised-leader updates (L1 and L2 penalties) in ``SHARDS`` shards whose states are averaged after
each epoch. A fifth of the sample is kept out of the fit and sets the temperature of the softmax. What reaches the driver and
what is broadcast is bounded by features x languages.

Defined cases: a text that is null or has no letter is ``und`` with score 0; without any labelled training document
every text is; with one language every text with a letter is that language with score 1; repeated rows get equal results; very
long texts are read in slices; an empty table gives an empty result; other columns are ignored, or passed on by the filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import documents, fold_of, forget, keep, texts

FEATURES = 1 << 15
ORDERS = (1, 2, 3)
FIT_ROWS = 8000
#: Rows that are drawn of a language with a smaller share, as far as it has them.
LEAST_ROWS = 200
SHARDS, EPOCHS = 8, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-4
UNKNOWN = "und"
SLICE = 1 << 20


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def gram_counts(text: str) -> np.ndarray | None:
    """How often each hashed n-gram occurs; None if the text has no letter."""
    counts, some, is_letter = np.zeros(FEATURES, np.int64), False, letters()
    for at in range(0, len(text), SLICE):
        code = np.frombuffer((" " + text[at:at + SLICE].lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        known = is_letter[code]
        some |= bool(known.any())
        code = np.where(known, code, 32).astype(np.uint64)
        code = code[np.concatenate([[True], known[1:] | known[:-1]])]  # runs of others become one blank
        h = np.zeros(len(code), np.uint64)
        for n in ORDERS:
            if len(code) < n:
                break
            h = h[:len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1:] + np.uint64(1)
            counts += np.bincount((h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 15)).astype(np.int64), minlength=FEATURES)
    return counts if some else None


def weighted(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the TF-IDF vector of length one."""
    at = np.flatnonzero(counts)
    value = (1 + np.log(counts[at])) * idf[at]
    return at, value / max(float(np.sqrt(value @ value)), 1e-12)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each feature; feature -1: documents."""
    total, n = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            counts = gram_counts(text.decode("utf-8", "replace"))
            if counts is not None:
                total += counts > 0
                n += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], n))], names=["feature", "n"])


def _vectors(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, text in enumerate(batch.column("text").to_pylist()):
            counts = gram_counts(text.decode("utf-8", "replace"))
            if counts is not None:
                at, value = weighted(counts, idf)
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([row.column("draw"), row.column("lang"), pa.array([at.astype(np.int32)]), pa.array([value.astype(np.float32)])],
                                                 names=["draw", "lang", "at", "value"])


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights that follow from the leader's state: zero inside the L1 band."""
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max())
    return e / e.sum()


def _epoch(batches: Iterator[pa.RecordBatch], state: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """One pass of a shard over its rows; the state's last row is the intercept."""
    z, n, some = state[0].copy(), state[1].copy(), False
    for batch in batches:
        some |= batch.num_rows > 0
        for lang, at, value in zip(batch.column("lang").to_pylist(), batch.column("at"), batch.column("value"), strict=True):
            at, x = np.append(at.values.to_numpy(), FEATURES), np.append(value.values.to_numpy(), 1.0)
            w = weights_of(z[at], n[at])
            p = softmax(x @ w)
            p[names.index(lang)] -= 1
            g = x[:, None] * p[None, :]
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    if some:  # tasks without rows have learned nothing
        yield pa.RecordBatch.from_arrays([pa.array([np.stack([z, n]).tobytes()])], names=["state"])


def _logits(batches: Iterator[pa.RecordBatch], weights: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(names.index(lang), np.append(v.values.to_numpy(), 1.0) @ weights[np.append(a.values.to_numpy(), FEATURES)])
                for lang, a, v in zip(batch.column("lang").to_pylist(), batch.column("at"), batch.column("value"), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1].tolist() for r in rows], pa.list_(pa.float64()))],
                                         names=["truth", "logits"])


def best_temperature(truth: np.ndarray, logits: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search over its logarithm."""
    if not len(truth):
        return 1.0

    def loss(log_t: float) -> float:
        scaled = logits / np.exp(log_t)
        top = scaled.max(1)
        return float((top + np.log(np.exp(scaled - top[:, None]).sum(1)) - scaled[np.arange(len(truth)), truth]).mean())

    low, high, ratio = -3.0, 3.0, (5 ** 0.5 - 1) / 2
    while high - low > 1e-3:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


class LanguageModel:
    """Names, weights by feature, inverse document frequencies and temperature; small enough to go with every task."""

    def __init__(self, names: list[str], weights: np.ndarray, idf: np.ndarray, temperature: float):
        self.names, self.weights, self.idf, self.temperature = names, weights, idf, temperature

    def __call__(self, text: str | None) -> tuple[str, float]:
        counts = gram_counts(text) if text and self.names else None
        if counts is None:
            return UNKNOWN, 0.0
        at, value = weighted(counts, self.idf)
        p = softmax((value @ self.weights[at] + self.weights[FEATURES]) / self.temperature)
        best = int(p.argmax())
        return self.names[best], float(min(max(p[best], 0.0), 1.0))


def drawn_shares(languages: dict[str, int], fit_rows: int, least: int = LEAST_ROWS) -> dict[str, float]:
    """The share of each language's rows that is drawn: the same for all, but for those that would give fewer than ``least`` rows."""
    usual = min(1.0, fit_rows / max(1, sum(languages.values())))
    return {name: max(usual, min(1.0, least / n)) for name, n in languages.items()}


def fit(training: DataFrame, fit_rows: int = FIT_ROWS, least: int = LEAST_ROWS) -> LanguageModel:
    """Learn from ``training`` (doc_id, text, lang); rows without lang must be left out.

    Languages are counted over all rows. A rare one is drawn with a larger share, and its calibrated odds are lowered by as much.
    """
    rows = texts(training, F.col("lang").cast("string").alias("lang"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).alias("draw"))
    counted = rows.select("text").mapInArrow(_frequencies, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))
    seen = {r.feature: r.n for r in counted.collect()}  # FEATURES + 1 rows at most
    n = seen.pop(-1, 0)
    df = np.zeros(FEATURES)
    df[list(seen)] = list(seen.values())
    idf = np.log((1 + n) / (1 + df)) + 1
    languages = {r.lang: r.n for r in training.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    shares = drawn_shares(languages, fit_rows, least)
    usual = min(shares.values(), default=1.0)
    rare = [F.when(F.col("lang") == name, int((1 << 20) * share)) for name, share in shares.items() if share > usual]
    drawn = keep(rows.filter(F.col("draw") < F.coalesce(*rare, F.lit(int((1 << 20) * usual)))).mapInArrow(partial(_vectors, idf=idf), "draw bigint, lang string, at array<int>, value array<float>"))
    names = sorted(languages)
    state = np.zeros((2, FEATURES + 1, len(names)))
    shard = F.pmod(F.xxhash64("draw"), F.lit(SHARDS)).cast("int")
    held = F.pmod(F.xxhash64(F.lit(1), "draw"), F.lit(5)) == 0
    if len(names) > 1:
        fitting = drawn.filter(~held).repartition(SHARDS, shard).sortWithinPartitions(F.xxhash64(F.lit(2), "draw"))
        for _ in range(EPOCHS):
            found = fitting.mapInArrow(partial(_epoch, state=state, names=names), "state binary").collect()  # a state per task
            if found:
                state = np.mean([np.frombuffer(r.state).reshape(state.shape) for r in found], axis=0)
    weights = weights_of(*state)
    checked = drawn.filter(held).mapInArrow(partial(_logits, weights=weights, names=names), "truth int, logits array<double>").collect() if len(names) > 1 else []
    forget(drawn)
    temperature = best_temperature(np.array([r.truth for r in checked], np.int64), np.array([r.logits for r in checked]))
    weights[FEATURES] += [temperature * np.log(usual / shares[name]) for name in names]  # the calibrated odds go back to those of all rows
    return LanguageModel(names, weights, idf, temperature)


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows to learn from: labelled, and not in the fold that is held out."""
    return docs.filter(F.col("lang").isNotNull() & (fold_of("doc_id", 4) != 2))


def _predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [model.value(t.decode("utf-8", "replace")) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                                         names=["doc_id", "held_out", "lang_pred", "score"])


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = texts(docs, (fold_of("doc_id", 4) == 2).alias("held_out"))
    return rows.mapInArrow(partial(_predict, model=sent), "doc_id bigint, held_out boolean, lang_pred string, score double")


def _accepted(batches: Iterator[pa.RecordBatch], model, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [model.value(t) for t in batch.column("text").to_pylist()]
        yield batch.filter(pa.array([name != UNKNOWN and score >= least for name, score in found], pa.bool_()))


def keep_known_languages(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text is in one of the learned languages, with a score of ``least`` or more.

    Very short texts of a known language score 0.3 to 0.5 among four; only what is hardly above chance is turned away.
    """
    texts(docs)  # bounds the batches
    sent = docs.sparkSession.sparkContext.broadcast(fit(training_rows(docs)))
    return docs.mapInArrow(partial(_accepted, model=sent, least=least), docs.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, fit(training_rows(docs)))
