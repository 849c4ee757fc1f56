"""Statistics of a text, one pass of Python and numpy per row; used by the quality operators."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from glosa.llm import common
from glosa.llm.common import SPACES, rolling

#: Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 5

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Ratios that do not depend on the length of the text, and then its size and vocabulary.
RATIOS = [
    "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "punctuation_share",
    "mark_share", "line_rate", "entropy", "symbol_word_share", "bar_rate", "code_share",
]
SIZES = ["log_words", "distinct_share"]
FEATURES = RATIOS + SIZES
SCHEMA = ", ".join([f"{n} long" for n in BASE] + ["features array<float>"])

_SPACE = np.frombuffer(SPACES, np.uint8)
_SYMBOL = np.frombuffer(SYMBOLS, np.uint8)
_PUNCTUATION = np.frombuffer(b".,;:!?'\"()-", np.uint8)
_IS_SPACE = np.isin(np.arange(256), _SPACE)
_IS_SYMBOL = np.isin(np.arange(256), _SYMBOL)
_CODE = np.frombuffer(b"{}[]=_/\\@~^+`", np.uint8)


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words inside windows whose word sequence is found twice or more in ``words``."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    # equal windows have equal hashes, so texts without equal hashes need no exact count
    hashes = np.sort(rolling(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), window))
    if not (hashes[1:] == hashes[:-1]).any():
        return 0
    seen = Counter(zip(*(words[k:] for k in range(window)), strict=False))
    starts = np.fromiter((seen[t] > 1 for t in zip(*(words[k:] for k in range(window)), strict=False)), np.int8, n)
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += starts
    edge[window:] -= starts
    return int(np.count_nonzero(np.cumsum(edge)[:-1]))


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [line for line in raw.split(b"\n") if line.split(None, 1)]
    return len(lines) - len(set(lines))


def measure(text: str | None) -> tuple[list[int], list[float]]:
    """Base counts and features; a null or empty text has zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    codes = np.frombuffer(raw, np.uint8)
    count = np.bincount(codes, minlength=256)
    n_bytes, n = len(raw), len(words)
    chars = n_bytes - int(count[0x80:0xC0].sum())  # without continuation bytes
    spaces = int(count[_SPACE].sum())
    n_symbols = int(count[_SYMBOL].sum())
    word_chars = chars - spaces
    dup, rep = duplicate_lines(raw), repeated_words(words)
    base = [n, word_chars, n_symbols, dup, rep]
    if not n:
        return base, [0.0] * len(FEATURES)
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    share = count[count > 0] / n_bytes
    symbol_ends = np.count_nonzero(_IS_SYMBOL[codes[:-1]] & _IS_SPACE[codes[1:]]) + int(_IS_SYMBOL[codes[-1]])
    features = [
        word_chars / n,
        n_symbols / word_chars,
        dup / (int(count[10]) + 1),
        rep / n,
        upper / max(1, upper + lower),
        int(count[48:58].sum()) / word_chars,
        int(count[_PUNCTUATION].sum()) / word_chars,
        int(count[33] + count[63]) / n,
        int(count[10]) / n,
        float(-(share * np.log2(share)).sum()),
        symbol_ends / n,
        int(count[124]) / n,
        int(count[_CODE].sum()) / word_chars,
        float(np.log1p(n)),
        len(set(words)) / n,
    ]
    return base, features


def statistics(text: Column) -> Column:
    """Struct of the base counts and the feature array of a text column."""

    @F.pandas_udf(SCHEMA)
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        common.kept()
        for batch in series:
            yield frame(map(measure, batch))

    return run(F.coalesce(text.cast("string"), F.lit("")))


def frame(rows) -> pd.DataFrame:
    rows = list(rows)
    out = pd.DataFrame([r[0] for r in rows], columns=BASE, dtype="int64")
    out["features"] = pd.Series([np.asarray(r[1], np.float32) for r in rows], dtype=object)
    return out


def matrix(features) -> np.ndarray:
    """Feature arrays of many rows as one matrix."""
    rows = [np.asarray(f, np.float32) for f in features]
    return np.vstack(rows) if rows else np.empty((0, len(FEATURES)), np.float32)


