"""Toxicity of a text: a weighted lexicon matched by Aho-Corasick after folding, normalised by length, with exception phrases.

Folding lower-cases, maps look-alike letters and digits that stand for letters to plain letters and everything else to
single blanks; signs at the end of a word are no letters. The lexicon is learned: whole words and beginnings of words that are much more frequent in toxic than in other
labelled documents, with their log odds as weights. A phrase of two words with a lexicon word in it is an exception where it is
found in other documents at least as often as in toxic ones; words inside an exception do not count. A text's score is a
logistic function of the summed weights over a power of its length in words; power, slope and intercept are fitted on labelled
documents that had no part in the lexicon. Learning reads at most about ``fit_rows`` labelled documents, drawn by a hash of doc_id, and
``least`` more: labels are counted over all rows, and a rare kind is drawn with a larger share, by which counts and odds are set right again.

Defined cases: a null, empty or letterless text has no match and gets the score of a text without any; a document with several
labels counts as toxic if one of them says so, and null labels are left out; without labels of both kinds the score is the share of
toxic labels (0 without labels); repeated rows get equal results; very long texts are matched in one stream; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import documents, fold_of, forget, keep, texts

FIT_ROWS = 16_000
#: Rows that are drawn of the rarer kind of label, as far as it has them.
LEAST_ROWS = 1000
#: Lengths of word beginnings that may become lexicon terms.
BEGINNINGS = (4, 5, 6)
#: A term needs so many toxic documents, and so large log odds after smoothing.
LEAST_TOXIC, LEAST_ODDS = 3, 2.0
POWERS = (0.0, 0.25, 0.5, 0.75, 1.0)

#: Digits and signs that stand for letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: Cyrillic and Greek letters that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ӏ": "l", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
}


class Folding(dict):
    """For str.translate: what each character of a lower-cased text becomes; filled as characters turn up."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        out = SIGNS.get(c) or LOOK_ALIKES.get(c)
        if not out:
            wide = unicodedata.normalize("NFKC", c).lower()  # full-width and mathematical letters
            out = wide if wide.isalpha() and wide != c else c if c.isalpha() else " "
        self[code] = out
        return out


_FOLDING = Folding()
#: Signs that end a word are marks, not letters.
_MARKS = re.compile(r"[!$@]+(?![^\W_])")


def folded(text: str) -> str:
    """Words of plain letters with one blank before and after each."""
    words = _MARKS.sub(" ", text.lower()).translate(_FOLDING).split()
    return f" {' '.join(words)} " if words else " "


def terms_of(word: str) -> set[str]:
    """The word itself (with a blank at both ends) and its beginnings (with one before)."""
    return {f" {word} "} | {f" {word[:n]}" for n in BEGINNINGS if len(word) > n}


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled documents of each kind that hold a term; terms of toxic documents only are kept by the caller."""
    counts = Counter(), Counter()
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            found = set()
            for word in set(folded(text.decode("utf-8", "replace")).split()):
                found |= terms_of(word)
            counts[toxic].update(found)
        if sum(map(len, counts)) > 500_000:
            yield _as_rows(counts)
            counts = Counter(), Counter()
    yield _as_rows(counts)


def _as_rows(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
    terms = list(counts[0].keys() | counts[1].keys())
    return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([counts[0][t] for t in terms], pa.int64())],
                                      names=["term", "toxic", "other"])


class Lexicon:
    """Weighted terms and exception phrases as one automaton; bounded by what ``fit_rows`` documents can teach."""

    def __init__(self, weights: dict[str, float], exceptions: set[str] = frozenset()):
        self.weights, self.exceptions = weights, set(exceptions)
        self._automaton = None

    def __getstate__(self):
        return self.weights, self.exceptions

    def __setstate__(self, state):
        self.__init__(*state)

    def _matches(self, text: str) -> Iterator[tuple[int, int, float | None]]:
        """Start, end and weight of every match in a folded text; None: an exception."""
        if self._automaton is None:
            import ahocorasick
            self._automaton = ahocorasick.Automaton()
            for phrase in self.exceptions:
                self._automaton.add_word(phrase, (len(phrase), None))
            for term, weight in self.weights.items():
                self._automaton.add_word(term, (len(term), weight))
            self._automaton.make_automaton()
        if len(self._automaton):
            for last, (length, weight) in self._automaton.iter(text):
                yield last + 1 - length, last + 1, weight

    def hits(self, text: str) -> list[tuple[int, float]]:
        """Place and weight of every word of a folded text that counts: its heaviest term, unless an exception covers it."""
        best, spared = {}, []
        for start, end, weight in self._matches(text):
            if weight is None:
                spared.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        if spared:
            best = {s: w for s, w in best.items() if not any(a <= s < b - 1 for a, b in spared)}
        return sorted(best.items())

    def summed(self, text: str) -> tuple[float, int]:
        """Summed weights and number of words of a text."""
        plain = folded(text)
        return sum(w for _, w in self.hits(plain)), max(plain.count(" ") - 1, 0)


def chosen_terms(rows: list, toxic: int, other: int) -> dict[str, float]:
    """Weights of the terms to keep: a term gives way to a beginning of it that is as telling."""
    odds = {r.term: float(np.log((r.toxic + 0.5) / (toxic + 1)) - np.log((r.other + 0.5) / (other + 1))) for r in rows}
    kept: dict[str, float] = {}
    for term in sorted((t for t in odds if odds[t] >= LEAST_ODDS), key=lambda t: (len(t), t)):
        shorter = [kept[term[:n]] for n in range(2, len(term)) if term[:n] in kept]
        if not shorter or max(shorter) < odds[term] - 0.5:
            kept[term] = odds[term]
    return kept


def _phrases(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    """Two-word phrases around lexicon words, by kind of document."""
    counts = Counter(), Counter()
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            plain = folded(text.decode("utf-8", "replace"))
            found = set()
            for start, _ in lexicon.hits(plain):
                end = plain.index(" ", start + 1)
                before, after = plain.rfind(" ", 0, start), plain.find(" ", end + 1)
                if before >= 0:
                    found.add(plain[before:end + 1])
                if after >= 0:
                    found.add(plain[start:after + 1])
            counts[toxic].update(found)
    yield _as_rows(counts)


def _features(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [lexicon.summed(t.decode("utf-8", "replace")) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64()), batch.column("toxic")],
                                         names=["summed", "words", "toxic"])


def logistic(x: np.ndarray | float, slope: float, intercept: float):
    return 1 / (1 + np.exp(-np.clip(slope * x + intercept, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float, float]:
    """Slope, intercept and log loss of a logistic curve in one variable, by Newton steps."""
    a = np.stack([x, np.ones_like(x)], 1)
    b = np.zeros(2)
    for _ in range(50):
        p = logistic(x, *b)
        g = a.T @ (p - y) + ridge * b
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), g)
        step *= min(1.0, 2.0 / max(float(np.abs(step).max()), 1e-12))
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(logistic(x, *b), 1e-12, 1 - 1e-12)
    return float(b[0]), float(b[1]), float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


class ToxicityModel:
    def __init__(self, lexicon: Lexicon, power: float, slope: float, intercept: float):
        self.lexicon, self.power, self.slope, self.intercept = lexicon, power, slope, intercept

    def __call__(self, text: str) -> float:
        summed, words = self.lexicon.summed(text)
        return float(logistic(summed / max(words, 1) ** self.power, self.slope, self.intercept))


def drawn_shares(other: int, toxic: int, fit_rows: int, least: int) -> tuple[float, float]:
    """Shares of the two kinds of labels that are drawn: the same, but for a kind of which that would give fewer than ``least`` rows."""
    usual = min(1.0, fit_rows / (other + toxic))
    return tuple(max(usual, min(1.0, least / n)) for n in (other, toxic))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, least: int = LEAST_ROWS) -> ToxicityModel:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); rows not to be learned from must be left out."""
    known = keep(labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
                 .agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    total, positive = known.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not total or positive in (0, total):
        share = positive / total if total else 0.0
        return ToxicityModel(Lexicon({}), 0.0, 0.0, float(np.log(share / (1 - share))) if 0 < share < 1 else 35.0 if share else -35.0)
    shares = drawn_shares(total - positive, positive, fit_rows, least)
    part = F.when(F.col("toxic") == 1, int((1 << 20) * shares[1])).otherwise(int((1 << 20) * shares[0]))
    drawn = F.broadcast(known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < part))  # fit_rows + least rows, about
    rows = texts(docs).join(drawn, "doc_id")
    rows = keep(rows.select("doc_id", "text", "toxic"))
    teaching = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(3)) != 0
    learn, check = rows.filter(teaching), rows.filter(~teaching)
    toxic, other = learn.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    counted = (learn.mapInArrow(_term_counts, "term string, toxic bigint, other bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
               .filter((F.col("toxic") >= LEAST_TOXIC) & (F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("other") + 0.5) / (other + 1.0)) >= LEAST_ODDS)))
    weights = chosen_terms(counted.collect(), toxic, other)  # terms of fit_rows documents at most
    lexicon = Lexicon(weights)
    phrases = (learn.mapInArrow(partial(_phrases, lexicon=lexicon), "term string, toxic bigint, other bigint").groupBy("term")
               .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).filter((F.col("other") >= 2) & (F.col("other") / shares[0] >= F.col("toxic") / shares[1])).select("term").collect())
    lexicon = Lexicon(weights, {r.term for r in phrases})
    seen = check.mapInArrow(partial(_features, lexicon=lexicon), "summed double, words bigint, toxic int").collect()  # fit_rows / 3 rows
    forget(rows, known)
    x, n, y = (np.array([r[i] for r in seen], float) for i in range(3))
    if not len(y) or y.min() == y.max():
        return ToxicityModel(lexicon, 0.0, 1.0, -LEAST_ODDS)
    fits = {p: fit_logistic(x / np.maximum(n, 1) ** p, y) for p in POWERS}
    power = min(fits, key=lambda p: fits[p][2])
    slope, intercept, _ = fits[power]
    return ToxicityModel(lexicon, power, slope, intercept + float(np.log(shares[0] / shares[1])))  # odds of all rows, not of those drawn


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = [model.value(t.decode("utf-8", "replace")) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                                         names=["doc_id", "held_out", "score", "predicted"])


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return texts(docs, (fold_of("doc_id", 5) == 0).alias("held_out")).mapInArrow(partial(_score, model=sent), "doc_id bigint, held_out boolean, score double, predicted int")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(docs, fit(docs, labels.filter(fold_of("doc_id", 5) != 0)))
