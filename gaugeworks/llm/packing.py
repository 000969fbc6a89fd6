"""Packing token sequences by minimum bin slack.

Documents are tokenized and cut into pieces once, in Arrow batches, and the pieces are stored. What is to be packed is then only
a question of how many pieces of each length there are: a table of at most ``capacity`` counts, whatever the size of the corpus.
For each kind of bin the plan takes the longest length left and finds, by a bitset of reachable sums over the lengths left, the
fullest combination that goes with it; the combination is used as often as the counts allow and removed. The plan is a list of
length intervals (at most a few thousand), so pieces find their place by their number within their length. Pieces are numbered
in blocks of a length, so that a length that holds a third of all pieces is spread over many tasks.

Defined cases: a null or empty text is one piece that holds only the end id; a document longer than the capacity is cut into
pieces of the capacity, the last one shorter; repeated rows are separate documents with the same doc_id; an empty table
gives an empty result; other columns are ignored. Very long texts are tokenized word by word like any other.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from functools import partial
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import documents, keep, rows_per_task, texts

CAPACITY = 2048
END_ID = 0
#: Words after which one Python worker starts a new generation of remembered words.
REMEMBERED_WORDS = 500_000
#: Pieces of one length that are numbered in one group, about.
BLOCK_ROWS = 100_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACED = f"{PIECES}, sequence_id bigint, offset bigint"


class WordIds:
    """Ids of texts by a tokenizer that never looks across blanks; words are remembered as little-endian uint32 bytes.

    Lower case is folded first unless the text may hold a special token, which the tokenizer knows in lower case only. A word
    that ends in marks after a letter is the word without them and the marks: the tokenizer splits there. New words of
    many texts are learned together. Those made of lower-case letters in normal form, which the tokenizer neither changes nor
    splits, go joined by blanks to a copy of it without normalizing, and are told apart by the ids that end a word; should
    these not be as many as the words, each goes alone to the tokenizer itself. Words are remembered in two generations, so that
    those in use stay when the older one is dropped; that changes no result.
    """

    #: Marks that neither belong to a special token nor, as an apostrophe does, to what comes before.
    MARKS = b"!#$%&()*+,-./:;=?@[]^_`{}~"
    LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyz")
    JOINED = 200

    def __init__(self, path: str, remembered: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer, self.remembered, self.known, self.older = Tokenizer.from_file(path), remembered or REMEMBERED_WORDS, {}, {}
        suffix, self.ends = self.tokenizer.model.end_of_word_suffix, None
        if suffix:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
            self.bare = Tokenizer.from_file(path)
            self.bare.normalizer = None
            self.bare.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _single(self, words: list[bytes]) -> None:
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        for word, encoded in zip(words, found, strict=True):
            self.known[word] = np.array(encoded.ids, "<u4").tobytes()

    def _joined(self, words: list[bytes], texts: list[str]) -> None:
        groups = [slice(i, i + self.JOINED) for i in range(0, len(words), self.JOINED)]
        found = self.bare.encode_batch_fast([" ".join(texts[g]) for g in groups], add_special_tokens=False)
        for g, encoded in zip(groups, found, strict=True):
            own, ids = words[g], np.array(encoded.ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(own) or ends[-1] != len(ids):
                self._single(own)
                continue
            raw, cuts = ids.tobytes(), [0, *(ends * 4).tolist()]
            self.known.update(zip(own, (raw[a:b] for a, b in zip(cuts, cuts[1:])), strict=True))  # noqa: B905

    def _learn(self, words: set[bytes]) -> None:
        """Have the ids of ``words`` in ``known``."""
        alone, plain, texts = [], [], []
        for w in words:
            if w in self.known:
                continue
            if w in self.older:
                self.known[w] = self.older[w]
                continue
            text = w.decode("utf-8", "replace")
            if self.ends is not None and text.isalpha() and text == text.lower() and is_normalized("NFC", text):
                plain.append(w)
                texts.append(text)
            else:
                alone.append(w)
        self._single(alone)
        self._joined(plain, texts)

    def _split(self, word: bytes) -> tuple[bytes, bytes] | None:
        """A word and the marks after its last letter."""
        stem = word.rstrip(self.MARKS)
        if len(stem) == len(word) or not stem:
            return None
        if stem[-1] in self.LETTERS or stem[-1] > 127 and stem.decode("utf-8", "replace")[-1].isalpha():
            return stem, word[len(stem):]
        return None

    def remember(self, words: set[bytes]) -> None:
        """Have the ids of new ``words`` in ``known``."""
        known, split, whole = self.known, {}, set()
        for w in [bytes(bytearray(w)) for w in words]:  # copies lie close together, words of texts all over the memory
            if w in self.older:
                known[w] = self.older[w]
            elif parts := self._split(w):
                split[w] = parts
            else:
                whole.add(w)
        self._learn(whole.union(*split.values()))
        for w, (stem, marks) in split.items():
            known[w] = known[stem] + known[marks]

    def of_texts(self, texts: Iterable[bytes], step: int = 1 << 16) -> Iterator[bytes]:
        """Ids of each text; about ``step`` words are held as such at a time, and a longer text is gone through in steps."""
        held, n = [], 0
        for text in texts:
            words = (text if b"<|" in text else text.lower()).split()
            if len(words) > step:
                yield from self._of_held(held)
                held, n, out = [], 0, []
                for i in range(0, len(words), step):
                    out += self._of_held([words[i:i + step]])
                yield b"".join(out)
                continue
            held.append(words)
            n += len(words)
            if n > step:
                yield from self._of_held(held)
                held, n = [], 0
        yield from self._of_held(held)

    def _of_held(self, held: list[list[bytes]]) -> list[bytes]:
        if len(self.known) > self.remembered:
            self.known, self.older = {}, self.known
        known = self.known
        found = [list(map(known.get, words)) for words in held]
        gaps = [i for i, ids in enumerate(found) if None in ids]
        if gaps:
            self.remember({w for i in gaps for w, ids in zip(held[i], found[i], strict=True) if ids is None})
            for i in gaps:
                found[i] = [known[w] if ids is None else ids for w, ids in zip(held[i], found[i], strict=True)]
        return list(map(b"".join, found))

    def __call__(self, text: bytes, step: int = 1 << 16) -> bytes:
        return next(self.of_texts([text], step))


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One per Python worker and path, so that remembered words serve all its tasks."""
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode = word_ids(path)
    end = np.array([END_ID], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
    for batch in batches:
        rows, ids_of = [], encode.of_texts(text for _, text in rows_per_task([batch], ("doc_id", "text")))
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), ids_of, strict=True):
            ids += end
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at:at + 4 * capacity]
                rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)) + ((np.frombuffer(part, "<u4").astype("i4"),) if with_ids else ()))
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece, and its ids if asked for."""
    schema = PIECES + (", ids array<int>" if with_ids else "")
    return texts(docs).mapInArrow(partial(_pieces, path=tokenizer_path, capacity=capacity, with_ids=with_ids), schema)


def fullest(room: int, left: list[tuple[int, int]]) -> dict[int, int]:
    """The combination of ``left`` (length, how many; longest first) with the largest sum up to ``room``: length -> how many.

    Bit s of ``reach`` is set where some combination has sum s. A length of which there are n is added in lots of 1, 2, 4, ...
    """
    whole, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length, n in left:
        if length > room:
            continue
        n, lot = min(n, room // length), 1
        while n:
            lot = min(lot, n)
            steps.append((reach, length, lot))
            reach = (reach | reach << length * lot) & whole
            n, lot = n - lot, lot * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for before, length, lot in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + lot
            total -= length * lot
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Bins to make from the pieces of each length: (how many, {length: how many of it in each})."""
    left, bins = {k: n for k, n in sorted(counts.items(), reverse=True) if n > 0}, []
    while left:
        longest = next(iter(left))
        rest = [(k, n - (k == longest)) for k, n in left.items() if n > (k == longest)]
        content = fullest(capacity - longest, rest)
        content[longest] = content.get(longest, 0) + 1
        times = min(left[k] // m for k, m in content.items())
        bins.append((times, content))
        for k, m in content.items():
            left[k] -= m * times
            if not left[k]:
                del left[k]
    return bins


def slots(bins: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Intervals of piece numbers of a length: key (length << 44 | first number), first, lot in a bin, first bin, offset."""
    used, first_bin, out = {}, 0, []
    for times, content in bins:
        offset = 0
        for length, lot in sorted(content.items(), reverse=True):
            start = used.get(length, 0)
            out.append((length << 44 | start, start, lot, first_bin, offset))
            used[length] = start + lot * times
            offset += length * lot
        first_bin += times
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def _place(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
        _, start, lot, first_bin, offset = table[np.searchsorted(table[:, 0], length << 44 | number, "right") - 1].T
        k = number - start
        own = [c for c in batch.schema.names if c != "number"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(first_bin + k // lot), pa.array(offset + k % lot * length)],
                                         names=[*own, "sequence_id", "offset"])


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset. Any other columns of theirs are kept."""
    stored = keep(pieces.withColumn("row", F.monotonically_increasing_id()))
    counts = {r.length: r.n for r in stored.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    if not counts:
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).limit(0)
    blocks = max(1, max(counts.values()) // BLOCK_ROWS)
    dealt = stored.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    running = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = (dealt.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
              .select("length", "block", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before")))
    order = Window.partitionBy("length", "block").orderBy("row")
    numbered = dealt.withColumn("within", F.row_number().over(order) - 1).join(before, ["length", "block"])
    own = [c for c in stored.columns if c != "row"]
    numbered = numbered.select(*own, (F.col("before") + F.col("within")).alias("number"))
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return numbered.mapInArrow(partial(_place, table=slots(plan(counts, capacity))), schema)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from placed pieces with ids: sequence_id and its ids (capacity at most)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def default_tokenizer() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("word_bpe_49k.json"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces_of(documents(spark, sf_dir), default_tokenizer()))
