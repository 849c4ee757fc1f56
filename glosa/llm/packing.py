"""Best-fit packing of token sequences by exact-complement hashing.

Every document becomes token ids and a closing id; only what is longer than a sequence is cut.  Whole pieces
are sequences of their own.  How the rest is packed depends on the lengths alone, so Spark counts the pieces of
each length (fewer counts than a sequence has tokens), the driver plans on those counts, and every piece finds
its place from its number among the pieces of its length.

The plan goes from the longest length to the shortest.  An index has the single lengths and, by their sum, the
pairs of lengths; a triple is its longest member and a pair of the index.  A bin that the current length opens
takes a single, a pair or a triple that fills its gap exactly, as many bins at once as the counts allow.
Lengths without an exact complement go to the open bin with the smallest gap that takes them, else to a new
bin, and the gap that is left is offered to the index again.

Defined results: a null or empty text is the closing id alone; rows are packed independently of their id, so
ties and repeated rows are packed each for itself and a null doc_id is kept; an empty table gives an empty
result; further columns are not read.  A long text is encoded whole, word by word, in one task; a special
string inside a text is the id that the public library gives it.  Numbers of sequences of whole pieces lie
above those of the planned ones and have holes.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glosa.llm import common
from glosa.llm.pretokens import Memo
from glosa.llm.token_counts import byte_symbols
from glosa.session import written

#: Contract: tokens in a sequence, and the id that closes a document.
CAPACITY, CLOSING = 2048, 0
#: Distinct words, and distinct pieces of words, whose ids one Python worker remembers (some 250 MB when full).
WORD_LIMIT, PIECE_LIMIT = 1_000_000, 500_000
#: The vocabulary's pattern, and the last letter before those that normal forms or locales may change.
PIECE, LAST_LATIN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+", "\u024f"
#: Rows of a task number their pieces below this; sequences of whole pieces count tasks in the bits above.
TASK_ROWS = 1 << 33


# --- token ids --------------------------------------------------------------------------------
class WordIds:
    """Ids of a text from the ids of its words, as little-endian unsigned 32-bit numbers.

    The vocabulary's rules drop white space and compose no character across it, so the ids of a text are those
    of its words in a row; and merges stay inside the pieces of a word, so the library's model is asked once for
    each piece.  Words of Latin letters, which no normal form changes, are lower-cased and cut by the vocabulary's
    pattern here, all others by the library, and words with a special string are encoded by it whole.  Both memos
    are emptied at a fixed size and only save work.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.normal, self.split = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.model = self.tokenizer.model.tokenize
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = bytes({s[0] for s in self.special})
        self.symbols = dict(enumerate(byte_symbols()))
        self.cut = regex.compile(PIECE).findall
        self.pieces, self.latin = Memo(self.piece, PIECE_LIMIT), Memo(self.latin_piece, PIECE_LIMIT)
        self.known = Memo(self.word, WORD_LIMIT)

    def piece(self, symbols: str) -> bytes:
        """Ids of one piece, written in the symbols of its bytes."""
        return array("I", [t.id for t in self.model(symbols)]).tobytes()

    def latin_piece(self, piece: str) -> bytes:
        if not piece.isascii() or not piece.isprintable():
            piece = piece.encode().decode("latin-1").translate(self.symbols)
        return self.piece(piece)

    def word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if any(m in word for m in self.marks) and any(s in word for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if max(text) > LAST_LATIN:
            return b"".join([self.pieces[p] for p, _ in self.split(self.normal(text))])
        text = text.lower()
        if text.isalpha():
            return self.latin[text]
        return b"".join(map(self.latin.__getitem__, self.cut(text)))

    def __call__(self, text: str | None) -> bytes:
        return b"".join(map(self.known.__getitem__, common.space_words(text)))


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, with ``task`` and its ``rank`` there by length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, task = word_ids(path), TaskContext.get().partitionId()
        closing, seen = np.uint32(CLOSING).tobytes(), [0] * (capacity + 1)
        for batch in batches:
            rows = []
            for at, text in enumerate(batch.column(1).to_pylist()):
                ids = encode(text) + closing
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    length = len(part) // 4
                    rows.append((at, piece, start, length, zlib.crc32(part), seen[length]))
                    seen[length] += 1
            own = np.array(rows, np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(own[:, 0])), pa.array(own[:, 1].astype(np.int32)), *map(pa.array, own[:, 2:].T.copy()),
                 pa.array(np.full(len(own), task, np.int64))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "rank", "task"],
            )

    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, rank long, task long"
    )


# --- plan -------------------------------------------------------------------------------------
class Complements:
    """Which lengths, one to three of them, add up to a gap exactly, under the counts that are left.

    Counts only fall, so a pair that has run out never comes back: each sum keeps how far its list is used up.
    """

    def __init__(self, left: list[int], capacity: int):
        self.left, self.capacity = left, capacity
        sizes = np.flatnonzero(np.array(left))
        big, small = np.meshgrid(sizes[::-1], sizes, indexing="ij")
        fits = (big >= small) & (big + small <= capacity)
        big, small = big[fits], small[fits]  # for each sum, the pair with the longest member first
        order = np.argsort(big + small, kind="stable")
        self.big, self.small = big[order].tolist(), small[order].tolist()
        ends = np.searchsorted((big + small)[order], np.arange(capacity + 2)).tolist()
        self.first, self.end = ends[:-1], ends[1:]
        self.sizes = sizes[::-1].tolist()

    def pair(self, total: int) -> tuple[int, int] | None:
        """The first pair of this sum whose members are left."""
        at, end, left = self.first[total], self.end[total], self.left
        while at < end:
            a, b = self.big[at], self.small[at]
            if left[a] > (a == b) and left[b]:
                break
            at += 1
        self.first[total] = at
        return (self.big[at], self.small[at]) if at < end else None

    def times(self, lengths: tuple[int, ...]) -> int:
        """How often these lengths can be taken together."""
        return min(self.left[x] // lengths.count(x) for x in lengths)

    def find(self, gap: int, held: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        """Lengths that fill the gap, to be taken together with ``held``."""
        if gap < 1:
            return None
        if self.times((*held, gap)):
            return (gap,)
        two = self.pair(gap)
        if two and self.times((*held, *two)):
            return two
        while self.sizes and not self.left[self.sizes[0]]:
            self.sizes.pop(0)
        for a in self.sizes:
            if a >= gap - 1 or not self.left[a]:
                continue
            if 3 * a < gap:
                break  # the longest of three is a third of their sum at least
            rest = self.pair(gap - a)
            if rest and rest[0] <= a and self.times((*held, a, *rest)):
                return (a, *rest)
        return None


class Plan:
    """Rows (length, base, copies, bins, sequence, offset): pieces ``base`` onwards of a length go ``copies`` to
    each of ``bins`` consecutive sequences, from ``offset`` on."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.bins, self.rows = capacity, 0, []
        self.left = [0] * (capacity + 1)
        for length, n in counts.items():
            self.left[length] = n
        self.used = [0] * (capacity + 1)
        self.index = Complements(self.left, capacity)
        self.open: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, bins)
        for length in range(capacity, 0, -1):
            self.place(length)

    def take(self, lengths: tuple[int, ...], first: int, bins: int, offset: int) -> None:
        for length in dict.fromkeys(lengths):
            copies = lengths.count(length)
            self.rows.append((length, self.used[length], copies, bins, first, offset))
            self.used[length] += copies * bins
            self.left[length] -= copies * bins
            offset += copies * length

    def fresh(self, bins: int) -> int:
        self.bins += bins
        return self.bins - bins

    def settle(self, first: int, bins: int, gap: int) -> None:
        """Fill the gap of these bins exactly, as many as the counts allow; the others stay open."""
        while bins and gap and (found := self.index.find(gap)):
            now = min(bins, self.index.times(found))
            self.take(found, first, now, self.capacity - gap)
            first, bins = first + now, bins - now
        if bins and gap:
            self.open.setdefault(gap, []).append((first, bins))

    def smallest_gap(self, length: int) -> int | None:
        """The open gap that leaves least; gaps below ``length`` wait for shorter pieces."""
        return min((g for g in self.open if g >= length), default=None)

    def place(self, length: int) -> None:
        left, gap = self.left, self.capacity - length
        while left[length] and (gap == 0 or (found := self.index.find(gap, (length,)))):
            whole = (length, *(found if gap else ()))
            bins = self.index.times(whole)
            self.take(whole, self.fresh(bins), bins, 0)
        while left[length]:
            at = self.smallest_gap(length)
            if at is None:
                copies = min(self.capacity // length, left[length])
                bins = left[length] // copies
                first = self.fresh(bins)
                self.take((length,) * copies, first, bins, 0)
                self.settle(first, bins, self.capacity - copies * length)
                continue
            first, bins = self.open[at].pop()
            now = min(bins, left[length])
            if now < bins:
                self.open[at].append((first + now, bins - now))
            if not self.open[at]:
                del self.open[at]
            self.take((length,), first, now, self.capacity - at)
            self.settle(first, now, at - length)


def places(plan: Plan):
    """(length, number among its length) -> sequence and offset, as a Column function.

    The plan's rows are numbers; a step of the plan uses up a length or a class of open bins, so there are a few
    for each of the ``capacity`` lengths, whatever the number of documents.
    """
    rows = np.array(sorted(plan.rows), np.int64).reshape(-1, 6)
    width = np.int64(1 << 44)
    keys = rows[:, 0] * width + rows[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def look_up(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        length, number = length.to_numpy(np.int64), number.to_numpy(np.int64)
        row = rows[np.searchsorted(keys, length * width + number, "right") - 1]
        nth = number - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 4] + nth // row[:, 2], "offset": row[:, 5] + nth % row[:, 2] * length})

    return look_up


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    rows = written(pieces(docs, path, capacity), "pieces")
    short = rows.filter(F.col("length") < capacity)
    counts = written(short.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # < capacity rows
    plan = Plan(total, capacity)
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = short.join(starts, ["length", "task"]).withColumn("number", F.col("before") + F.col("rank"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    planned = numbered.select(*names, places(plan)(F.col("length"), F.col("number")).alias("at_"))
    planned = planned.select(*names, "at_.sequence_id", "at_.offset")
    whole = rows.filter(F.col("length") == capacity).select(
        *names,
        (F.lit(plan.bins) + F.col("task") * F.lit(TASK_ROWS) + F.col("rank")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return planned.unionByName(whole)


@common.query("op13_best_fit_packing")
def op13_best_fit_packing(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    return packed(docs, common.tokenizer_path("word_bpe_49k.json"))
