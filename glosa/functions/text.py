"""Column functions on comment text: cleaning, words, metrics, readability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosa.functions.emoji import spell_in_place
from glosa.functions.patterns import SPACE, WORD, contains_any, contains_word
from glosa.session import compute_once
from glosa.vocab import words as vocab

URL = r"http\S+|www\S+|https\S+"
URL_DOTTED = r"http\S+|www\.\S+"
URL_HTTP = r"http\S+"


def one_line(text: Column) -> Column:
    """Line breaks become spaces."""
    return F.regexp_replace(text, r"\r|\n", " ")


def strip(text: Column) -> Column:
    """Trim white space of any kind on both ends."""
    return F.regexp_replace(text, f"^[{SPACE}]++|(?<![{SPACE}])[{SPACE}]++$", "")


def collapse_spaces(text: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def remove_urls(text: Column, pattern: str = URL) -> Column:
    return F.regexp_replace(text, pattern, "")


def clean(text: Column, punctuation: str = "", url: str = URL) -> Column:
    """URLs out, punctuation out (or replaced), lower case, single spaces."""
    bare = F.regexp_replace(remove_urls(text, url), f"[^{WORD}{SPACE}]", punctuation)
    return collapse_spaces(F.lower(bare))


def emotion_input(text: Column) -> Column:
    """URLs and mentions out, ASCII letters and digits only, lower case."""
    bare = F.regexp_replace(remove_urls(text, URL), f"@[{WORD}]+", "")
    return strip(F.lower(F.regexp_replace(bare, f"[^a-zA-Z0-9{SPACE}]", "")))


def letters_only(text: Column, ascii_only: bool = False) -> Column:
    keep = "a-zA-Z" if ascii_only else r"\p{L}"
    return F.regexp_replace(F.lower(text), f"[^{keep}{SPACE}]", "")


# A run of punctuation is only tried from its first character, which keeps the
# work linear however long the run is.
_MARK = f"[^{WORD}{SPACE}]"
_EDGE_PUNCTUATION = (
    f"(?={_MARK})(?:(?:^|(?<=[{SPACE}])){_MARK}++|(?<!{_MARK}){_MARK}++(?=[{SPACE}]|$))"
)


def words(text: Column, min_length: int = 1) -> Column:
    """Lower-case words without leading and trailing punctuation.

    Punctuation is removed in one pass over the text before the split, not word by word.
    """
    bare = F.regexp_replace(F.lower(text), _EDGE_PUNCTUATION, "")
    tokens = F.array_remove(F.split(bare, f"[{SPACE}]+"), "")
    return tokens if min_length <= 1 else F.filter(tokens, lambda w: F.length(w) >= min_length)


def average_word_length(tokens: Column) -> Column:
    letters = F.length(F.array_join(tokens, ""))
    return F.when(F.size(tokens) > 0, letters / F.size(tokens)).otherwise(F.lit(0.0))


def lexical_diversity(tokens: Column) -> Column:
    distinct = F.size(F.array_distinct(tokens))
    return F.when(F.size(tokens) > 0, distinct / F.size(tokens)).otherwise(F.lit(0.0))


def uppercase_share(text: Column) -> Column:
    upper = F.regexp_count(text, F.lit(r"\p{Lu}"))
    return F.when(F.length(text) > 0, upper / F.length(text)).otherwise(F.lit(0.0))


def repeated_runs(text: Column, at_least: int = 3) -> Column:
    """Number of runs in which one character stands ``at_least`` times in a row."""
    return F.regexp_count(text, F.lit(f"([^\\n])\\1{{{at_least - 1},}}"))


def non_alphabetic_share(text: Column) -> Column:
    other = F.length(F.regexp_replace(text, f"[a-zA-Z{SPACE}]", ""))
    return F.when(F.length(text) > 0, other / F.length(text)).otherwise(F.lit(0.0))


def rough_score(avg_len: Column, diversity: Column, upper: Column, repeats: Column) -> Column:
    return avg_len * 0.2 + diversity * 0.4 - upper * 0.2 - F.log1p(repeats) * 0.2


def enhanced_score(
    flesch: Column, grammar_errors: Column, avg_len: Column, diversity: Column, upper: Column,
    repeats: Column,
) -> Column:
    return (
        (flesch - 50) / 50 * 0.4
        - F.log1p(grammar_errors) * 0.3
        + diversity * 0.15
        + (avg_len - 4) / 4 * 0.05
        - upper * 0.05
        - F.log1p(repeats) * 0.05
    )


def flesch_reading_ease(text: Column) -> Column:
    """206.835 - 1.015 words/sentences - 84.6 syllables/words; a syllable is a run of vowels."""
    n_words = F.regexp_count(text, F.lit(f"[{WORD}]+"))
    n_sentences = F.greatest(F.regexp_count(text, F.lit(r"[.!?]+")), F.lit(1))
    n_syllables = F.regexp_count(F.lower(text), F.lit("[aeiouy]+"))
    score = 206.835 - n_words / n_sentences * 1.015 - n_syllables / n_words * 84.6
    return F.when(n_words > 0, score).otherwise(F.lit(0.0))


def truncate(text: Column, limit: int = 500, ending: str = "...") -> Column:
    """Display form of a long text."""
    short = F.concat(F.substring(text, 1, limit), F.lit(ending))
    return F.when(F.length(text) > limit, short).otherwise(F.coalesce(text, F.lit("")))


def model_input(text: Column, emoji_text: Column) -> Column:
    return F.concat(F.coalesce(text, F.lit("")), F.lit(" "), F.coalesce(emoji_text, F.lit("")))


def topic_flag(text: Column, topic_words=tuple(vocab.TOURISM_EXTENDED), miss: int = 0) -> Column:
    """1 where a topic word occurs; ``miss=-1`` marks the rest for manual review."""
    return F.when(contains_any(text, topic_words), 1).otherwise(miss)


def travel_texts(df: DataFrame, text: Column, name: str, travel_words=tuple(vocab.TRAVEL)) -> DataFrame:
    """The rows whose text mentions travel, with the cleaned text, emoji spelled out, as ``name``.

    Each step is computed once for a row: spelling reads its text four times, and the search reads the cleaned one.
    """
    bare = compute_once(df, {"_bare": remove_urls(text)})
    spelled = compute_once(bare, {"_spelled": spell_in_place(F.col("_bare"))}).drop("_bare")
    cleaned = compute_once(spelled, {name: clean(F.col("_spelled"))}).drop("_spelled")
    return cleaned.filter(contains_word(F.col(name), travel_words))
