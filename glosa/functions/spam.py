"""Rule-based spam signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glosa.functions import text as T
from glosa.functions.patterns import SPACE, WORD, contains_any
from glosa.vocab.words import SPAM_BY_YEAR, SPAM_COMMON, TRUE_STRINGS

REPEATED_WORD = f"(?<![{WORD}])([{WORD}]++)[{SPACE}]+\\1(?![{WORD}])"


def spam_word(text: Column, year: Column | None = None, common=tuple(SPAM_COMMON), by_year=None) -> Column:
    """A common spam word, or one of the comment's own year, occurs as a substring."""
    found = contains_any(text, common)
    if year is None:
        return found
    for y, words in (by_year or SPAM_BY_YEAR).items():
        found = found | ((year == y) & contains_any(text, words))
    return found


def letter_run(text: Column, at_least: int = 4) -> Column:
    return F.lower(text).rlike(f"([^\\n])\\1{{{at_least - 1},}}")


def repeated_word(text: Column) -> Column:
    return F.lower(text).rlike(REPEATED_WORD)


def repeated_sentence(text: Column) -> Column:
    """True if some piece X of one line stands as ``X. X.``.

    Pieces between full stops are compared instead of running a back-reference:
    first each piece with the next one, then, only where a piece occurs twice at
    all, runs of m pieces with the m pieces after them.
    """
    line_break = F.lit("\n")

    def search(row: Column) -> Column:
        pieces, bodies = row["pieces"], row["bodies"]
        n = F.size(pieces)

        def indented(i: Column) -> Column:
            return F.length(F.get(bodies, i)) < F.length(F.get(pieces, i))

        def next_repeats(j: Column) -> Column:
            following, body = F.get(pieces, j + 1), F.get(bodies, j + 1)
            last = F.when(F.length(following) > 1, F.right(following, F.lit(1))).otherwise("")
            body = F.when(body != "", body).otherwise(last)
            return indented(j + 1) & (body != "") & ~F.contains(body, line_break) & F.endswith(F.get(pieces, j), body)

        def run_repeats(m: Column) -> Column:
            def at(a: Column) -> Column:
                body, inner = F.get(bodies, a + m), F.slice(pieces, a + 2, m - 1)
                return (
                    indented(a + m) & ~F.contains(body, line_break) & F.endswith(F.get(pieces, a), body)
                    & (inner == F.slice(pieces, a + m + 2, m - 1))
                    & ~F.exists(inner, lambda x: F.contains(x, line_break))
                )

            return F.exists(F.sequence(F.lit(0), n - 2 * m - 1), at)

        near = (n >= 3) & F.exists(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), next_repeats)
        longest = F.floor((n - 1) / 2).cast("int")
        twice = (longest >= 2) & (F.size(F.array_distinct(pieces)) < n)
        return near | (twice & F.exists(F.sequence(F.lit(2), F.greatest(longest, F.lit(2))), run_repeats))

    split = F.split(text, "\\.", -1)
    bodies = F.transform(split, lambda x: F.regexp_replace(x, f"^[{SPACE}]+", ""))
    rows = F.array(F.struct(split.alias("pieces"), bodies.alias("bodies")))
    return F.coalesce(F.contains(text, F.lit(".")) & F.exists(rows, search), F.lit(False))


def rule_filter(df, text: str = "original_comment", year: Column | None = None):
    """Rows that pass every rule, with the lower-cased text as ``cleaned``.

    The word, run and repetition rules are expressions; only rows that pass them
    reach the sentence rule.
    """
    t = F.col(text)
    kept = df.filter(
        (F.length(T.strip(t)) >= 3) & ~spam_word(t, year) & ~letter_run(t) & ~repeated_word(t)
    )
    return kept.withColumn("cleaned", F.lower(t)).filter(~repeated_sentence(F.col("cleaned")))


def is_true(flag: Column) -> Column:
    """Spam flag of any spelling."""
    return F.coalesce(F.lower(flag.cast("string")).isin(TRUE_STRINGS), F.lit(False))
