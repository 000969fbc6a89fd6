"""Scoring texts with a hidden Markov language model over words, beside an add-half unigram score.

Words are counted over all training documents. Words with at least a fixed share of all tokens are few by arithmetic (at most
1 / share of them), so they go to the tasks as a dictionary: those with ``DICTIONARY`` bring their counts along, and those
with ``SYMBOLS`` are the symbols of the model. All other words are rare: they share one symbol, within which a word has its
smoothed share of the counts, and get those by a join on the word's hash, so no count is cut off and no key of that join is hot in
the training documents. Texts are turned into symbol sequences once and stored.

Latent states are trained by Baum-Welch: each task adds up expected counts of first states, transitions and emissions with
scaled forward and backward recursions over groups of documents of like length, the sums are grouped by symbol, and the
new parameters, bounded by states x symbols, come back. ``WARM_UP`` rounds each use one of ``SHARDS`` shares of the training
documents in turn, so what they read grows with the corpus; the last round uses all of them. The score of a text is the exact
likelihood of its whole sequence by the scaled forward recursion, times that of its rare words within their symbol.

Defined cases: a null or blank text is the end token alone; without training documents every text gets the untrained model's
score; repeated rows get equal results; a very long text is trained in pieces that go on from each other's forward state, and
scored as a whole; an empty table gives an empty result; other columns are ignored. Rare words whose 64-bit hashes collide would share
their counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import documents, fold_of, keep, texts

STATES = 8
#: Least share of all training tokens of a word with its count in the dictionary, and of a word with a symbol of its own.
DICTIONARY, SYMBOLS = 2.0 ** -18, 2.0 ** -16
END, RARE, FIRST_SYMBOL = 0, 1, 2
WARM_UP, SHARDS = 6, 8
#: Documents that step through the recursion together; longest piece that is trained at once.
TOGETHER, PIECE = 256, 8192
#: Tokens' worth of the overall word shares that every state's emissions start from, and of even transitions.
PRIOR_EMISSIONS, PRIOR_TRANSITIONS = 100.0, 1.0
#: Different words that a task counts before it hands on what it has.
COUNTED = 300_000


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words; the end token is null."""
    def rows() -> pa.RecordBatch:
        words = [*counts, None]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([*counts.values(), ends], pa.int64())], names=["word", "n"])

    counts, ends = Counter(), 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            counts.update(text.lower().split())  # of bytes: A-Z only, and the blanks of common.BLANK
            ends += 1
            if len(counts) > COUNTED:
                yield rows()
                counts, ends = Counter(), 0
    yield rows()


class Vocabulary:
    """Totals of the training tokens and what is known of frequent words: word -> (symbol, count)."""

    def __init__(self, total: int, distinct: int, known: dict[bytes, tuple[int, int]], end_count: int, symbols: int, rare_total: float):
        self.total, self.distinct, self.known, self.end_count, self.symbols, self.rare_total = total, distinct, known, end_count, symbols, rare_total

    @property
    def divisor(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)


def count_words(training: DataFrame) -> DataFrame:
    """Stored counts (word, n) of all training tokens."""
    rows = texts(training).select("text").mapInArrow(_word_counts, "word binary, n bigint")
    return keep(rows.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    total, distinct = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    total = total or 0
    frequent = counts.filter((F.col("n") >= F.lit(total * DICTIONARY)) & F.col("word").isNotNull()).toArrow()  # 1 / DICTIONARY rows at most
    order = np.argsort(frequent.column("word").to_numpy(zero_copy_only=False), kind="stable")
    words, n = frequent.column("word").take(order).to_pylist(), frequent.column("n").take(order).to_pylist()
    known, symbols, own = {}, FIRST_SYMBOL, 0.0
    for word, c in zip(words, n, strict=True):
        has_symbol = c >= total * SYMBOLS
        known[bytes(word)] = (symbols if has_symbol else RARE, c)
        symbols += has_symbol
        own += (c + 0.5) * has_symbol
    ends = counts.filter("word IS NULL").agg(F.sum("n")).first()[0] or 0
    rare_total = total + 0.5 * (distinct + 1) - own - (ends + 0.5 if ends else 0.0)  # of all words with symbol RARE, the unknown one included
    return Vocabulary(total, distinct, known, ends, symbols, max(rare_total, 0.5))


def _sequences(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """Symbols of each text, what the dictionary says about it, and the words it doesn't know with how often they occur."""
    vocabulary: Vocabulary = sent.value
    number = {w: i + 1 for i, w in enumerate(vocabulary.known)}  # 0: not in the dictionary
    symbol = np.array([RARE, *(s for s, _ in vocabulary.known.values())], np.int32)
    log = np.array([0.0, *(np.log10(c + 0.5) for _, c in vocabulary.known.values())])
    log_rare, log_divisor, end_log = log * (symbol == RARE), np.log10(vocabulary.divisor), np.log10(vocabulary.end_count + 0.5)
    words_type, times_type = pa.list_(pa.binary()), pa.list_(pa.int32())
    for whole in batches:
        for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
            out = []
            for text in batch.column("text").to_pylist():
                words = text.lower().split()
                at = np.array([number.get(w, 0) for w in words], np.int64)
                symbols = symbol[at]
                unknown = Counter([words[i] for i in np.flatnonzero(at == 0)])
                n_known = len(words) - unknown.total()
                n_end = int(vocabulary.end_count > 0)
                out.append((len(words) + 1, n_known + n_end, float(log[at].sum()) + end_log - (n_known + 1) * log_divisor, float(log_rare[at].sum()),
                            int((symbols == RARE).sum()), np.append(symbols, np.int32(END)), list(unknown), list(unknown.values())))
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int32()), words_type, times_type]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), batch.column("draw"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                                             names=["doc_id", "held_out", "draw", "n_tokens", "n_known", "base", "rare", "n_rare", "symbols", "words", "times"])


SEQUENCES = ("doc_id bigint, held_out boolean, draw bigint, n_tokens bigint, n_known bigint, base double, rare double, n_rare bigint, "
             "symbols array<int>, words array<binary>, times array<int>")


class Parameters:
    """First-state, transition and emission probabilities (by symbol and state)."""

    def __init__(self, first: np.ndarray, moves: np.ndarray, emits: np.ndarray):
        self.first, self.moves, self.emits = first, moves, emits


def starting(shares: np.ndarray, states: int = STATES, seed: int = 7) -> Parameters:
    """The overall word shares, bent differently for each state, and states that mostly stay."""
    emits = shares[:, None] * np.random.default_rng(seed).lognormal(0.0, 1.0, (len(shares), states))
    moves = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
    return Parameters(np.full(states, 1 / states), moves, emits / emits.sum(0))


def in_step(sequences: list[np.ndarray]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Groups of sequences of like length, longest first: their places and, for each step, the symbols of those that go on."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    for at in range(0, len(order), TOGETHER):
        group = order[at:at + TOGETHER]
        lengths = np.array([len(sequences[i]) for i in group])
        flat = np.concatenate([sequences[i] for i in group])
        start = np.cumsum(lengths) - lengths
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # sequences longer than each step
        yield group, [flat[start[:a] + t] for t, a in enumerate(active.tolist())]


def forward(steps: list[np.ndarray], p: Parameters, begin: np.ndarray, keep_all: bool):
    """Scaled forward recursion: log likelihoods, states after the last step of each, and all scaled states and scales if asked for."""
    logs, last = np.zeros(len(begin)), np.array(begin)
    states, scales, now = [], [], begin
    for t, symbols in enumerate(steps):
        now = (now[:len(symbols)] @ p.moves if t else now[:len(symbols)]) * p.emits[symbols]
        scale = now.sum(1)
        now = now / scale[:, None]
        logs[:len(symbols)] += np.log(scale)
        last[:len(symbols)] = now
        if keep_all:
            states.append(now)
            scales.append(scale)
    return logs, last, states, scales


def add_expected(sequences: list[np.ndarray], p: Parameters, totals: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    """Add the expected counts of first states, transitions and emissions to ``totals``."""
    begins: list[np.ndarray | None] = [None] * len(sequences)
    left, at = list(range(len(sequences))), 0
    while left:  # pieces of long sequences go on from the state that the piece before ended in
        pieces = [sequences[i][at:at + PIECE] for i in left]
        for group, steps in in_step(pieces):
            begin = np.stack([p.first if begins[left[g]] is None else begins[left[g]] @ p.moves for g in group])
            _, last, states, scales = forward(steps, p, begin, True)
            for g, state in zip(group, last, strict=True):
                begins[left[g]] = state
            back = np.ones((len(steps[-1]), p.moves.shape[0]))
            gammas = [None] * len(steps)
            for t in range(len(steps) - 1, -1, -1):
                n = len(steps[t])
                if n > len(back):  # sequences that end here
                    back = np.concatenate([back, np.ones((n - len(back), back.shape[1]))])
                gammas[t] = states[t] * back
                seen = p.emits[steps[t]] * back / scales[t][:, None]
                if t:
                    totals[1][:] += p.moves * (states[t - 1][:n].T @ seen)
                    back = seen @ p.moves.T
            if at == 0:
                totals[0][:] += gammas[0].sum(0)
            symbols, gamma = np.concatenate(steps), np.concatenate(gammas)
            for k in range(gamma.shape[1]):
                totals[2][:, k] += np.bincount(symbols, gamma[:, k], totals[2].shape[0])
        at += PIECE
        left = [i for i in left if len(sequences[i]) > at]


def _expected(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """Expected counts of a task by symbol; symbol -1 is the first state, -2 - k what follows state k."""
    p: Parameters = sent.value
    totals = np.zeros_like(p.first), np.zeros_like(p.moves), np.zeros_like(p.emits)
    for batch in batches:
        add_expected([s.values.to_numpy() for s in batch.column("symbols")], p, totals)
    used = np.flatnonzero(totals[2].any(1))
    rows = np.concatenate([totals[0][None], totals[1], totals[2][used]])
    names = np.concatenate([[-1], -2 - np.arange(len(p.moves)), used]).astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(names), *(pa.array(c) for c in rows.T.copy())], names=["symbol", *(f"c{k}" for k in range(rows.shape[1]))])


def round_of(stored: DataFrame, p: Parameters, shares: np.ndarray) -> Parameters:
    """One Baum-Welch round over ``stored`` sequences."""
    states = len(p.first)
    fields = ", ".join(["symbol int", *(f"c{k} double" for k in range(states))])
    sent = stored.sparkSession.sparkContext.broadcast(p)
    sums = stored.select("symbols").mapInArrow(partial(_expected, sent=sent), fields).groupBy("symbol").agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(states)))
    found = sums.toArrow()  # symbols + states rows at most
    at = found.column("symbol").to_numpy()
    values = np.stack([found.column(f"c{k}").to_numpy() for k in range(states)], 1)
    counts = np.zeros((states + 1 + len(shares), states))
    counts[np.where(at < 0, -at - 1, at + states + 1)] = values
    if not counts[0].any():  # no sequence began, so there were none
        return p
    first = counts[0] + PRIOR_TRANSITIONS
    moves = counts[1:states + 1] + PRIOR_TRANSITIONS
    emits = counts[states + 1:] + PRIOR_EMISSIONS * shares[:, None]
    return Parameters(first / first.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(0))


def train(stored: DataFrame, vocabulary: Vocabulary) -> Parameters:
    """Latent states from the stored sequences that are not held out."""
    shares = np.full(vocabulary.symbols, 0.5)
    shares[END] += vocabulary.end_count
    for symbol, c in vocabulary.known.values():
        shares[symbol] += c * (symbol != RARE)
    shares[RARE] = vocabulary.rare_total
    shares /= shares.sum()
    p, training = starting(shares), stored.filter("NOT held_out")
    for i in range(WARM_UP):
        p = round_of(training.filter(F.col("draw") % SHARDS == i % SHARDS), p, shares)
    return round_of(training, p, shares)


def _likelihoods(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    p: Parameters = sent.value
    for batch in batches:
        sequences = [s.values.to_numpy() for s in batch.column("symbols")]
        found = np.zeros(len(sequences))
        for group, steps in in_step(sequences):
            found[group] = forward(steps, p, np.repeat(p.first[None], len(group), 0), False)[0] / np.log(10)
        own = [c for c in batch.schema.names if c != "symbols"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(found)], names=[*own, "likelihood"])


def score(docs: DataFrame, training: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``."""
    spark = docs.sparkSession
    counts = count_words(training)
    words = vocabulary(counts)
    rows = texts(docs, held_out.alias("held_out"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("draw"))
    made = rows.mapInArrow(partial(_sequences, sent=spark.sparkContext.broadcast(words)), SEQUENCES)
    stored = keep(made.withColumn("row", F.monotonically_increasing_id()))
    p = train(stored, words)

    rest = stored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.xxhash64("w.words").alias("word"), F.col("w.times").alias("m"))
    few = counts.filter((F.col("n") < F.lit(words.total * DICTIONARY)) & F.col("word").isNotNull()).groupBy(F.xxhash64("word").alias("word")).agg(F.sum("n").alias("n"))
    n = F.coalesce("n", F.lit(0))
    logs = (rest.join(few, "word", "left").groupBy("row")
            .agg(F.sum("m").alias("m"), F.sum(F.when(n > 0, F.col("m")).otherwise(0)).alias("m_known"), F.sum(F.col("m") * F.log10(n + 0.5)).alias("logs")))
    sent = spark.sparkContext.broadcast(p)
    columns = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, rare double, n_rare bigint, row bigint, likelihood double"
    found = stored.select("doc_id", "held_out", "n_tokens", "n_known", "base", "rare", "n_rare", "row", "symbols").mapInArrow(partial(_likelihoods, sent=sent), columns)
    zero = F.lit(0)
    return found.join(logs, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("m_known", zero)).alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0)) - F.coalesce("m", zero) * F.lit(float(np.log10(words.divisor)))).alias("base_score"),
        (F.col("likelihood") + F.col("rare") + F.coalesce("logs", F.lit(0.0)) - F.col("n_rare") * F.lit(float(np.log10(words.rare_total)))).alias("score"))


def op6_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold_of("doc_id", 5) == 1
    return score(docs, docs.filter(~held_out), held_out)
