"""Regular expressions built from word lists.

Word characters are letters, numbers and the underscore of any script; Java's
own ``\\w`` and ``\\b`` only know ASCII, so the edges are spelled out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x0B\x1C-\x1F\x85\p{Z}"


def escape(text: str) -> str:
    """Escape a literal for Java and RE2 alike."""
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}-" else c for c in text)


def _is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


def bounded(word: str, raw: bool = False) -> str:
    """One keyword between word boundaries; ``raw`` marks a ready-made pattern."""
    first, last = (True, True) if raw else (_is_word(word[0]), _is_word(word[-1]))
    left = f"(?<![{WORD}])" if first else f"(?<=[{WORD}])"
    right = f"(?![{WORD}])" if last else f"(?=[{WORD}])"
    return left + (word if raw else escape(word)) + right


def alternation(words: Iterable[str]) -> str:
    """Literal alternatives grouped by their first letter.

    A position is tested against a few letters instead of every word.  Words of
    one group keep their order, and words of different groups cannot start at the
    same place, so the match is the one of the plain list.
    """
    groups: dict[str, list[str]] = {}
    for word in words:
        groups.setdefault(word[0].lower(), []).append(escape(word[1:]))
    return "|".join(escape(first) + "(?:" + "|".join(rest) + ")" for first, rest in groups.items())


def any_bounded(words: Iterable[str], lowered: bool = False) -> str:
    """Whole words of a list that start and end with word characters, whatever the case.

    ``lowered=True`` gives the cheaper pattern for an already lower-cased text.
    """
    body = alternation([w.lower() for w in words] if lowered else words)
    return f"{'' if lowered else '(?iu)'}(?<![{WORD}])(?:{body})(?![{WORD}])"


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """True where the text holds one of the words as a substring, whatever the case.

    Plain substring search beats one long alternation; the one-element array
    makes the lower-cased text a variable, so it is computed once for all words.
    """
    needles = [w.lower() for w in words]

    def search(lowered: Column) -> Column:
        found = F.contains(lowered, F.lit(needles[0]))
        for needle in needles[1:]:
            found = found | F.contains(lowered, F.lit(needle))
        return found

    return F.coalesce(F.exists(F.array(F.lower(text)), search), F.lit(False))


def contains_word(text: Column, words: Iterable[str], raw: Iterable[str] = ()) -> Column:
    """True where the text holds one of the words between word boundaries.

    A word's pattern is tried only where the word occurs at all.
    """

    def search(lowered: Column) -> Column:
        found = F.lit(False)
        for word in words:
            word = word.lower()
            found = found | (F.contains(lowered, F.lit(word)) & lowered.rlike(bounded(word)))
        for pattern in raw:
            found = found | lowered.rlike("(?iu)" + bounded(pattern, raw=True))
        return found

    return F.coalesce(F.exists(F.array(F.lower(text)), search), F.lit(False))


def hits(lowered: Column, words: Iterable[str]) -> Column:
    """How many of the words occur in an already lower-cased text."""
    total = F.lit(0)
    for word in words:
        total = total + F.contains(lowered, F.lit(word)).cast("int")
    return total


def matches(lowered: Column, words: Iterable[str], separator: str) -> Column:
    """The words that occur in an already lower-cased text, in list order, as one string."""
    found = [F.when(F.contains(lowered, F.lit(w)), F.lit(w)) for w in words]
    return F.array_join(F.array(*found), separator)


def pattern_hits(lowered: Column, patterns: Iterable[str]) -> Column:
    """How many of the patterns (literals with ``\\w+`` in places) occur in a lower-cased text.

    The longest literal piece is searched for first; a ``\\w+`` at either end needs
    only one word character to be found.
    """
    total = F.lit(0)
    for pattern in patterns:
        piece = max(re.split(r"\\w\+", pattern), key=len)
        found = F.contains(lowered, F.lit(piece))
        if piece != pattern:
            short = re.sub(r"^\\w\+|\\w\+$", r"\\w", pattern).replace(r"\w", f"[{WORD}]")
            found = found & lowered.rlike(short)
        total = total + found.cast("int")
    return total


def occurrences(lowered: Column, word: str) -> Column:
    """Non-overlapping occurrences of one word in an already lower-cased text."""
    return ((F.length(lowered) - F.length(F.replace(lowered, F.lit(word), F.lit("")))) / len(word)).cast(
        "long"
    )
