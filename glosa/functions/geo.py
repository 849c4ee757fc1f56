"""Geographic signals of one comment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glosa.functions import emoji
from glosa.functions.patterns import any_bounded, bounded, contains_any, contains_word, hits, matches
from glosa.vocab import words as vocab
from glosa.vocab.countries import country_rows


def has_keyword(text: Column, keywords=tuple(vocab.GEO_KEYWORDS)) -> Column:
    return contains_any(text, keywords)


def has_flag(text: Column) -> Column:
    return F.coalesce(text.rlike(emoji.FLAG), F.lit(False))


def has_location(text: Column, places=tuple(vocab.LOCATIONS_ENHANCED), raw=()) -> Column:
    return contains_word(text, places, raw)


def has_basic_location(text: Column) -> Column:
    """The short country list, or any word ending in "city"."""
    return has_location(text, vocab.LOCATIONS_BASIC, [vocab.CITY_SUFFIX_PATTERN])


def matched_keywords(text: Column, keywords=tuple(vocab.GEO_KEYWORDS)) -> Column:
    """Keywords in the text, in list order, joined by ';'; empty if there is none."""
    return matches(F.lower(text), keywords, ";")


def keyword_confidence(text: Column, keywords=tuple(vocab.GEO_KEYWORDS)) -> Column:
    lowered = F.lower(text)
    score = (
        F.lit(0.5)
        + hits(lowered, keywords) * 0.1
        + F.when(F.contains(lowered, F.lit("from")), 0.2).otherwise(0.0)
        - F.when(F.length(text) < 10, 0.2).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def locations(text: Column, places=tuple(vocab.LOCATIONS_ENHANCED)) -> Column:
    """Every place name in the text, as written, left to right."""
    return F.regexp_extract_all(text, F.lit(any_bounded(places)), F.lit(0))


def location_confidence(found: Column, major=tuple(vocab.MAJOR_LOCATIONS)) -> Column:
    score = (
        F.lit(0.6)
        + F.when(F.size(found) > 1, 0.1).otherwise(0.0)
        + F.when(F.arrays_overlap(found, F.array(*[F.lit(m) for m in major])), 0.2).otherwise(0.0)
    )
    return F.when(F.size(found) > 0, F.least(F.lit(1.0), score)).otherwise(F.lit(0.0))


def country_of_text(text: Column, aliases=tuple(vocab.COUNTRY_ALIASES), names=None) -> Column:
    """First alias in list order, else the leftmost country name, in its standard spelling."""
    names = names or [name for _, _, name in country_rows()]
    spelling = F.create_map(*[F.lit(x) for n in names for x in (n.lower(), n)])

    def search(lowered: Column) -> Column:
        by_alias = [
            F.when(F.contains(lowered, F.lit(a.lower())) & lowered.rlike(bounded(a.lower())), F.lit(name))
            for a, name in aliases
        ]
        leftmost = F.regexp_extract(lowered, any_bounded(names, lowered=True), 0)
        return F.coalesce(*by_alias, F.when(leftmost != "", F.element_at(spelling, leftmost)))

    return F.get(F.transform(F.array(F.lower(text)), search), 0)


def first_flag(text: Column) -> Column:
    """The first flag pair, null if there is none."""
    found = F.regexp_extract(text, emoji.FLAG, 0)
    return F.when(found != "", found)
