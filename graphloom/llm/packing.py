"""Packing token sequences into windows by minimum bin slack.

Documents are tokenised once; what is kept of a piece is its length and checksum. A document of more than one
window is cut into whole windows and a rest. The rests are a multiset of lengths below the window, so a
histogram of fixed size says all about them. Each window takes the largest rest that is left and, of all
multisets of the others, one whose sum is closest to the space left: subset sums are bits of one integer,
lengths are added with powers of two of their counts, and the counts are read back by backtracking. A pattern
found is used as often as its lengths last. Only the histogram reaches the driver; every piece finds its place
by its rank among the pieces of its length.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut
from .word_cache import Table, WordIds

WINDOW = 4096
END_ID = 2
#: Words whose ids a task remembers; then it forgets them and begins anew.
CACHE_WORDS = 400_000
#: White space that str.split() cuts at and that isn't in a tokenizer's class \\s, or the other way round.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_SPACE = re.compile("[ \t-\r]+")


def split_words(text: str) -> list[str]:
    """The pieces of text between ASCII white space."""
    return text.split() if not _ODD_SPACE.search(text) else [w for w in _SPACE.split(text) if w]


#: The pattern by which the tokenizer parts words, for words whose characters all lie below U+0250.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[0-9²³¹¼½¾]|(?:[^\w]|_)+")
_PLAIN_BELOW = "\u0250"


class WordTokenizer:
    """Ids of whole texts from ids of their words' parts, each encoded once.

    The tokenizer lower-cases, parts words by its pattern and ends each part's last id with ``</w>``, so parts
    can be encoded many at a time. Words with characters outside Latin, or with a special token, are encoded by
    the tokenizer as they are.
    """

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer
        ends = [i for w, i in tokenizer.get_vocab().items() if w.endswith("</w>")]
        self.ends = np.zeros(max(ends) + 1, bool)
        self.ends[ends] = True
        self.forget()

    def forget(self) -> None:
        self.words, self.parts = WordIds(), WordIds()
        self.by_word, self.by_part = Table(), Table()

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        new, self.words.new = self.words.new, []
        if not new:
            return
        number, keys, sizes, whole = self.parts.__getitem__, [], [], []
        for k, w in enumerate(new):
            if w.isascii() or (max(w) < _PLAIN_BELOW and "\u0130" not in w):
                low = w.lower()
                if low.isalpha():
                    keys.append(number(low))
                    sizes.append(1)
                    continue
                if "<|" not in low and not _ODD_SPACE.search(low):
                    parts = _PARTS.findall(low)
                    keys += map(number, parts)
                    sizes.append(len(parts))
                    continue
            whole.append(k)
            sizes.append(0)
        parts, self.parts.new = self.parts.new, []
        if parts:
            flat = np.fromiter((i for x in self._encode([" ".join(parts[i : i + GROUP]) for i in range(0, len(parts), GROUP)]) for i in x), np.int64)
            stops = np.flatnonzero(self.ends[flat]) + 1
            if len(stops) != len(parts):
                raise ValueError("the tokenizer doesn't end each part of a word with </w>")
            self.by_part.add(flat, np.diff(np.concatenate([[0], stops])))
        flat, many = self.by_part.get(np.array(keys, np.int64))
        bounds = np.concatenate([[0], np.cumsum(many)])
        at = np.concatenate([[0], np.cumsum(sizes)])
        word_sizes = bounds[at[1:]] - bounds[at[:-1]]
        if whole:
            pieces = np.split(flat, bounds[at[1:]])[: len(new)]
            for k, ids in zip(whole, self._encode([new[k] for k in whole]), strict=True):
                pieces[k] = np.array(ids, np.int64)
            flat, word_sizes = np.concatenate(pieces), np.array([len(p) for p in pieces])
        self.by_word.add(flat, word_sizes)

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(self.words) > CACHE_WORDS:
            self.forget()
        number = self.words.__getitem__
        keys = [np.fromiter(map(number, w), np.int64) for w in map(split_words, texts)]
        self._learn()
        for key in keys:
            yield self.by_word.get(key)[0]


def word_tokenizer(spark: SparkSession, path: str):
    """A broadcast tokenizer file; load_tokenizer() makes a WordTokenizer of it on an executor."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def load_tokenizer(shared) -> WordTokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return WordTokenizer(Tokenizer.from_str(shared.value))


#: Texts whose words are numbered together.
GROUP = 256
_PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long"


def token_pieces(docs: DataFrame, tokenizer, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """The pieces of each document: whole windows and a rest, with the task and the rank among its pieces of that length.

    A null or empty text is end_id alone; a null id stays null; repeated rows have pieces each; an empty table
    gives an empty result; other columns are passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode = load_tokenizer(tokenizer)
        ranks = np.zeros(window + 1, np.int64)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").fill_null("")
            for at in range(0, len(ids), GROUP):
                rows: list[tuple] = []
                for doc, tokens in zip(ids[at : at + GROUP], encode(texts[at : at + GROUP].to_pylist()), strict=True):
                    tokens = np.append(tokens, end_id).astype("<u4")
                    for start in range(0, len(tokens), window):
                        piece = tokens[start : start + window]
                        rows.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(tokens), part, int(ranks[len(piece)])))
                        ranks[len(piece)] += 1
                types = (pa.int64(),) * 5 + (pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"],
                )

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(run, _PIECES)


def closest_fill(counts: dict[int, int], space: int) -> dict[int, int]:
    """Of the multisets of lengths with these counts, one whose sum is at most space and closest to it.

    Bit s of ``reach`` says that some multiset has the sum s. A length with count c enters in chunks of 1, 2,
    4, ... and a rest, which add up to any number up to c. It stops as soon as space itself is reached.
    """
    full = (1 << (space + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= space), reverse=True):
        many, chunk = min(counts[length], space // length), 1
        while many:
            chunk = min(chunk, many)
            steps.append((reach, length, chunk))
            reach |= reach << length * chunk & full
            many, chunk = many - chunk, chunk * 2
        if reach >> space & 1:
            break
    left, taken = reach.bit_length() - 1, {}
    for before, length, chunk in reversed(steps):
        if not before >> left & 1:
            taken[length] = taken.get(length, 0) + chunk
            left -= length * chunk
    return taken


def bin_patterns(histogram: dict[int, int], window: int = WINDOW) -> Iterator[tuple[dict[int, int], int]]:
    """(lengths with their counts, number of windows filled like that) until every length is used up."""
    counts = {k: v for k, v in histogram.items() if v}
    while counts:
        largest = max(counts)
        others = dict(counts)
        others[largest] -= 1
        pattern = closest_fill({k: v for k, v in others.items() if v}, window - largest)
        pattern[largest] = pattern.get(largest, 0) + 1
        times = min(counts[k] // n for k, n in pattern.items())
        yield pattern, times
        for k, n in pattern.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]


def _slots(histogram: dict[int, int], window: int) -> tuple[list[tuple], int]:
    """(length, first rank, end rank, first sequence, pieces in a sequence, offset) for each pattern and length."""
    used = dict.fromkeys(histogram, 0)
    rows, sequence = [], 0
    for pattern, times in bin_patterns(histogram, window):
        offset = 0
        for length, many in sorted(pattern.items(), reverse=True):
            rows.append((length, used[length], used[length] + many * times, sequence, many, offset))
            used[length] += many * times
            offset += length * many
        sequence += times
    return rows, sequence


class Places:
    """The slots of bin_patterns() by length: for the ``at``-th piece of a length, its sequence and its offset there.

    Each pattern uses up a length and lengths add up to a window at most, so there are less than window patterns
    of less than sqrt(2 * window) lengths each: what tasks are sent has a bound that the data can't move.
    """

    def __init__(self, rows: list[tuple], whole_from: int, window: int) -> None:
        self.whole_from, self.window = whole_from, window
        table = np.array(sorted(rows), np.int64).reshape(-1, 6)
        self.low, self.first, self.many, self.base = table[:, 1], table[:, 3], table[:, 4], table[:, 5]
        # Slots of a length lie together in order of their first rank; one key says length and rank.
        self.begin = np.searchsorted(table[:, 0], np.arange(window + 1))
        self.lengths = table[:, 0]

    def __call__(self, length: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = self.whole_from + at, np.zeros_like(at)
        for one in np.unique(length[length < self.window]).tolist():
            here = np.flatnonzero(length == one)
            begin, end = self.begin[one], self.begin[one + 1]
            slot = begin + np.searchsorted(self.low[begin:end], at[here], "right") - 1
            turn = at[here] - self.low[slot]
            sequence[here] = self.first[slot] + turn // self.many[slot]
            offset[here] = self.base[slot] + turn % self.many[slot] * one
        return sequence, offset


def _place(places):
    """Rows of pieces with their rank among all pieces of their length, as rows with a sequence and an offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = places.value
        for batch in batches:
            length, at = (batch.column(c).to_numpy() for c in ("length", "at"))
            sequence, offset = find(length, at)
            columns = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[f.split()[0] for f in _PLACED.split(", ")])

    return run


def pack_documents(docs: DataFrame, tokenizer, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece of each row of docs.

    A row's ids are its text's and end_id, so a null or empty text is one id. Rows may repeat; each is packed.
    An empty table gives an empty result; other columns are passed over. The checkpoint of the pieces fixes
    their ranks, so lost executors change no place.
    """
    spark = docs.sparkSession
    pieces = cut(token_pieces(docs, tokenizer, text, doc_id, window, end_id))
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("many"))
    before = by_part.withColumn(
        "before", F.coalesce(F.sum("many").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).select("part", "length", "before")
    totals = {r["length"]: r["many"] for r in by_part.groupBy("length").agg(F.sum("many").alias("many")).collect()}
    rows, sequences = _slots({k: v for k, v in totals.items() if k < window}, window)
    # Whole windows follow the packed ones, one sequence each. Pieces look their slots up where they are: a join by
    # length would send all whole windows to one task.
    places = spark.sparkContext.broadcast(Places(rows, sequences, window))
    ranked = pieces.join(before, ["part", "length"]).withColumn("at", F.col("rank") + F.col("before"))
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "at").mapInArrow(_place(places), _PLACED)
