"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are produced.

For each pre-token the adjacent pairs that the merge table knows go on a heap as (rank, place).  The
lowest is popped again and again; a popped pair is merged when both of its sides are still what they
were, its neighbours are linked to the merged symbol and the two new pairs are pushed.  The count is
the number of initial symbols minus the number of merges.

Defined results: a null or empty text has 0 tokens; a special string inside a text counts as one
token, as the public library's default; rows are independent, so ties, repeated rows, empty tables and
further columns change nothing.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosa.llm import common
from glosa.llm.pretokens import Memo, public_pattern, splitter

#: Distinct pre-tokens whose counts one Python worker remembers.
MEMO_LIMIT = 400_000


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte.

    Printable Latin-1 characters stand for themselves; the others follow from U+0100 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    names = {b: chr(b) for b in plain}
    for b in range(256):
        names.setdefault(b, chr(256 + len(names) - len(plain)))
    return [names[b] for b in range(256)]


class Merges:
    """Merge table of a tokenizer file: (left, right) -> (rank, merged)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.table = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.start = [ids[s] for s in byte_symbols()]
        self.special = [t["content"] for t in spec["added_tokens"]]

    def count(self, piece: str) -> int:
        symbols = [self.start[b] for b in piece.encode("utf-8", "surrogatepass")]
        n = len(symbols)
        if n < 2:
            return n
        table = self.table
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = table.get((symbols[i], symbols[i + 1]))
            if found:
                heap.append((found[0], i, found[1], symbols[i], symbols[i + 1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, merged, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # one side has been merged since
            merges += 1
            symbols[i], symbols[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = table.get((merged, symbols[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, found[1], merged, symbols[k]))
            h = before[i]
            if h >= 0:
                found = table.get((symbols[h], merged))
                if found:
                    heapq.heappush(heap, (found[0], h, found[1], symbols[h], merged))
        return n - merges


@functools.lru_cache(maxsize=2)
def counter(path: str, pattern: str):
    """text -> number of tokens, with the memo of this worker."""
    import re

    merges = Merges(path)
    find, memo = splitter(pattern), Memo(merges.count, MEMO_LIMIT)
    special = re.compile("|".join(map(re.escape, sorted(merges.special, key=len, reverse=True))) or r"(?!)")

    def count(text: str) -> int:
        pieces = special.split(text)
        total = len(pieces) - 1
        for piece in pieces:
            total += sum(map(memo.__getitem__, find(piece)))
        return total

    return count


def token_count(text: Column, path: str, pattern: str | None = None) -> Column:
    """Number of tokens of a text column under the byte-level vocabulary at ``path``."""
    pattern = pattern or public_pattern()

    @F.pandas_udf("long")
    def counts(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(path, pattern)
        for batch in series:
            yield pd.Series([count(t) for t in batch], dtype="int64")

    return counts(F.coalesce(text.cast("string"), F.lit("")))


def with_token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document."""
    text = common.text_or_empty()
    return docs.select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), token_count(text, path).alias("n_tokens")
    ).withColumn("over_limit", F.col("n_tokens") > limit)


@common.query("op10_token_counts")
def op10_token_counts(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    return with_token_counts(docs, common.tokenizer_path("byte_bpe_50k.json"))
