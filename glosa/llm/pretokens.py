"""Splitting of texts before byte-pair merges, shared by the token counter and the encoder."""

from __future__ import annotations

import functools


@functools.lru_cache(maxsize=8)
def splitter(pattern: str):
    """``findall`` of the public split pattern.

    White space is spelled as the Unicode property: the ``\\s`` of the two tokenizer libraries is that.
    """
    import regex

    own = pattern.replace(r"(?!\S)", r"(?!\P{White_Space})").replace(r"\s", r"\p{White_Space}")
    return regex.compile(own).findall


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Memo(dict):
    """Answers already computed in this Python worker; emptied when it holds ``limit`` entries.

    It only saves work: an entry that was dropped is computed again.
    """

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value
