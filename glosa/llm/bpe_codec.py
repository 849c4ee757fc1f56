"""Byte-level BPE encoding and decoding by DuckDB statements inside each partition.

Texts are split by the public pattern.  The distinct pre-tokens that a task has not seen yet become
token-position rows (word, pos, token).  A recursive query joins neighbouring rows to the merge table,
takes each word's minimum-rank pair, the leftmost of equal ones, contracts it and goes on with the words
that changed until none does.  A document's ids are those of its pre-tokens in order.  Decoding turns ids
into (document, pos, id) rows, joins them to the vocabulary and concatenates the bytes in the order of pos.

Defined results: a null or empty text has no ids and decodes to no bytes; rows are independent, so ties,
repeated rows, empty tables and further columns change nothing.  Work on one pre-token grows with the
square of its length; words over ``LONG_WORD`` bytes are run by themselves, in rounds of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosa.llm import common
from glosa.llm.pretokens import public_pattern, splitter

#: Distinct pre-tokens whose ids one Python worker remembers.
MEMO_LIMIT = 300_000
#: Characters of texts worked on at once.
SLICE = 2_000_000
#: Bytes of pre-tokens that one recursive query takes, and pre-tokens that go alone.
QUERY_BYTES, LONG_WORD = 500_000, 1_000
#: Token rows that one recursive query may make before its state is carried to the next one.
ROUND_ROWS = 2_000_000
#: Ids decoded by one statement.
DECODE_IDS = 500_000
#: Memory of the DuckDB database in a task.
DUCKDB_MEMORY = "250MB"

#: A pair is left << 20 | right; a contraction is rank << 2k | place << k | place of the right side, with
#: k of {bits} bits, in {kind}.  The rank of a merge is the id of the merged token.
ENCODE = """
WITH RECURSIVE step(word, pos, token, turn) AS (
    SELECT word, pos, token, 0 FROM start
    UNION ALL
    (WITH least AS (
        SELECT word, min((merged::{kind} << (2 * {bits})) | (pos::{kind} << {bits}) | next_pos) AS cut
        FROM (
            SELECT word, pos, (token::BIGINT << 20) | lead(token) OVER places AS pair,
                   lead(pos) OVER places AS next_pos, lead(word) OVER places AS next_word
            FROM step WINDOW places AS (ORDER BY word, pos)
        ) JOIN merges USING (pair)
        WHERE word = next_word
        GROUP BY word
    )
    SELECT step.word, pos,
           CASE WHEN pos = ((cut >> {bits}) & ((1::{kind} << {bits}) - 1))
                THEN (cut >> (2 * {bits}))::INTEGER ELSE token END,
           turn + 1
    FROM step JOIN least USING (word)
    WHERE pos <> (cut & ((1::{kind} << {bits}) - 1)) AND turn < $turns)
)
SELECT step.word, step.pos, step.token, turn = $turns AS cut_short
FROM step JOIN (SELECT word, max(turn) AS turn FROM step GROUP BY word) USING (word, turn)
"""
#: Words below 2^20 bytes fit 64-bit arithmetic.
SHORT, ANY_LENGTH = ENCODE.format(kind="BIGINT", bits=20), ENCODE.format(kind="HUGEINT", bits=32)

DECODE = """
SELECT doc, string_agg(bytes, '') AS hex
FROM (SELECT doc, bytes FROM ids JOIN vocabulary USING (id) ORDER BY pos)
GROUP BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: each line is a token in base64 and its rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file) if a}


class Codec:
    """One DuckDB database with the vocabulary and its merge table."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import pyarrow as pa

        self.pa, self.find, self.ranks = pa, splitter(pattern), read_ranks(path)
        pairs = []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs.append(((left << 20) | right, rank))
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": DUCKDB_MEMORY})
        pair_table = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        merge_rows = pa.table({"pair": pair_table[:, 0], "merged": pair_table[:, 1].astype(np.int32)})
        self._create("merges", merge_rows)
        ids = pa.array(list(self.ranks.values()), pa.int32())
        self._create("vocabulary", pa.table({"id": ids, "bytes": [t.hex() for t in self.ranks]}))
        self.id_text = {i: str(i) for i in self.ranks.values()}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.packed: dict[str, bytes] = {}  # pre-token -> its ids as packed numbers

    def _create(self, name: str, rows) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _rows(self, name: str, statement: str, rows, **values):
        self.db.register(name, rows)
        try:
            return self.db.execute(statement, values or None).fetchnumpy()
        finally:
            self.db.unregister(name)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """Ids of all words after all merges, one after another, and where each word's ids begin and end."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
        pos = (np.arange(len(word)) - starts).astype(np.int32)
        token = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        while True:
            turns = max(64, ROUND_ROWS // max(1, len(word)))
            start = self.pa.table({"word": word, "pos": pos, "token": token})
            out = self._rows("start", SHORT if lengths.max() < 1 << 20 else ANY_LENGTH, start, turns=turns)
            order = np.lexsort((out["pos"], out["word"]))
            word, pos, token = (np.asarray(out[c])[order].astype(np.int32) for c in ("word", "pos", "token"))
            if not np.asarray(out["cut_short"]).any():
                break
        return token, np.searchsorted(word, np.arange(len(words) + 1)).tolist()

    def learn(self, words: list[str]) -> None:
        """Put the ids of words that are not known yet into the memo."""
        todo: list[str] = []
        raw: list[bytes] = []
        size = 0

        def flush():
            nonlocal size
            if todo:
                ids, at = self.merge(raw)
                packed = ids.tobytes()
                for w, a, b in zip(todo, at, at[1:], strict=False):
                    self.packed[w] = packed[4 * a : 4 * b]
            todo.clear()
            raw.clear()
            size = 0

        for w in words:
            code = w.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(code)
            if whole is not None:  # a pre-token that is a token needs no merges
                self.packed[w] = whole.to_bytes(4, sys.byteorder)
                continue
            if len(code) > LONG_WORD:
                flush()
            todo.append(w)
            raw.append(code)
            size += len(code)
            if size > QUERY_BYTES or len(code) > LONG_WORD:
                flush()
        flush()

    def encode(self, texts: list[str]) -> list[tuple[str, np.ndarray]]:
        """For each text its ids, as decimal text joined by commas and as numbers."""
        out = []
        for begin, end in self._slices([len(t) for t in texts], SLICE):
            split = [self.find(t) for t in texts[begin:end]]
            seen = set().union(*split)
            new = seen.difference(self.packed)
            if len(self.packed) + len(new) > MEMO_LIMIT:  # what this slice needs stays together
                self.packed.clear()
                new = seen
            self.learn(list(new))
            for words in split:
                ids = np.frombuffer(b"".join(map(self.packed.__getitem__, words)), np.int32)
                out.append((",".join(map(self.id_text.__getitem__, ids.tolist())), ids))
        return out

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids."""
        out = [b""] * len(ids)
        for begin, end in self._slices([len(i) for i in ids], DECODE_IDS):
            some = ids[begin:end]
            doc = np.repeat(np.arange(begin, end, dtype=np.int32), [len(i) for i in some])
            flat = np.concatenate([*some, np.empty(0, np.int32)]).astype(np.int32)
            rows = self.pa.table({"doc": doc, "pos": np.arange(len(doc), dtype=np.int32), "id": flat})
            got = self._rows("ids", DECODE, rows)
            for d, hexes in zip(got["doc"].tolist(), got["hex"].tolist(), strict=True):
                out[d] = bytes.fromhex(hexes)
        return out

    @staticmethod
    def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
        begin = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > most:
                yield begin, i
                begin, total = i, 0
            total += size
        if begin < len(sizes):
            yield begin, len(sizes)


def codec(path: str, pattern: str) -> Codec:
    """The codec of this worker, kept until a task of another operator runs in it."""
    return common.kept(("bpe_codec", path, pattern), lambda: Codec(path, pattern))


def encode(text: Column, path: str, pattern: str | None = None) -> Column:
    """Array of token ids of a text column."""
    pattern = pattern or public_pattern()

    @F.pandas_udf("array<int>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path, pattern)
        for batch in series:
            yield pd.Series([ids for _, ids in own.encode(batch.tolist())], dtype=object)

    return run(F.coalesce(text.cast("string"), F.lit("")))


def decode(ids: Column, path: str, pattern: str | None = None) -> Column:
    """Bytes of an array of token ids (null: none)."""
    pattern = pattern or public_pattern()

    @F.pandas_udf("binary")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path, pattern)
        for batch in series:
            arrays = [np.empty(0, np.int32) if i is None else np.asarray(i, np.int32) for i in batch]
            yield pd.Series(own.decode(arrays), dtype=object)

    return run(ids)


def round_trip(text: Column, path: str, pattern: str | None = None, with_ids: bool = False) -> Column:
    """Struct of n_tokens, ids_sha256 and decoded_sha256 (and ``token_ids``): encoded, then decoded."""
    pattern = pattern or public_pattern()
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"

    @F.pandas_udf(schema + ", token_ids array<int>" if with_ids else schema)
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path, pattern)
        for batch in series:
            texts, rows = batch.tolist(), []
            for begin, end in Codec._slices([len(t) for t in texts], SLICE):
                coded = own.encode(texts[begin:end])
                decoded = own.decode([ids for _, ids in coded])
                for (line, ids), raw in zip(coded, decoded, strict=True):
                    digest = hashlib.sha256(line.encode()).hexdigest()
                    row = (len(ids), digest, hashlib.sha256(raw).hexdigest())
                    rows.append((*row, ids) if with_ids else row)
            names = ["n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]
            yield pd.DataFrame(rows, columns=names[: 3 + with_ids])

    return run(F.coalesce(text.cast("string"), F.lit("")))


def with_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every document."""
    return docs.select("doc_id", round_trip(F.col("text"), path).alias("coded")).select("doc_id", "coded.*")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, ids_sha256 and decoded_sha256 for every document."""
    coded = docs.select("doc_id", round_trip(F.col("text"), path, with_ids=True).alias("coded_"))
    return coded.select("doc_id", "coded_.n_tokens", "coded_.token_ids", "coded_.ids_sha256", "coded_.decoded_sha256")


@common.query("op5_bpe_codec")
def op5_bpe_codec(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    return with_digests(docs, common.tokenizer_path("byte_bpe_multi_50k.tiktoken"))
