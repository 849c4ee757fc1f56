"""Emoji and flag functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glosa.vocab.emoji import SKIN_TONES, emoji_class, emoji_names
from glosa.vocab.words import FLAG_NAMES

EMOJI = emoji_class()
FLAG = r"[\x{1F1E6}-\x{1F1FF}]{2}"
TONES = "[" + "".join(f"\\x{{{cp:X}}}" for cp in SKIN_TONES) + "]"


# Almost every character lies below the first symbols; a two-range test settles
# those before the long class is tried.
_PLAIN = r"\x{0}-\x{A8}\x{AF}-\x{203B}"


def extract(text: Column) -> Column:
    """All emoji characters, in order, as one string."""
    return F.regexp_replace(text, f"[{_PLAIN}]++|[^{EMOJI[1:]}++", "")


def remove(text: Column) -> Column:
    return F.regexp_replace(text, f"(?![{_PLAIN}]){EMOJI}", "")


def strip_tones(emojis: Column) -> Column:
    return F.regexp_replace(emojis, TONES, "")


def characters(emojis: Column) -> Column:
    """One array element per code point."""
    return F.regexp_extract_all(emojis, F.lit(r"(?s)."), F.lit(0))


def flags(text: Column) -> Column:
    """Flag pairs, left to right, not overlapping."""
    return F.regexp_extract_all(text, F.lit(FLAG), F.lit(0))


def flag_names(flag_array: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in FLAG_NAMES.items() for x in pair])
    return F.transform(
        flag_array, lambda f: F.coalesce(F.element_at(known, f), F.concat(F.lit("Unknown_"), f))
    )


def flag_alpha2(flag: Column) -> Column:
    """Alpha-2 country code of a flag pair."""
    letters = F.translate(
        flag, "".join(chr(0x1F1E6 + i) for i in range(26)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    )
    return F.when(F.length(flag) == 2, letters)


def name_text(emojis: Column, before: str = ":", after: str = ":") -> Column:
    """Short names of the emoji in a string; a skin tone joins the emoji before it.

    One lookup per character of the already extracted emoji: a tone that follows an
    emoji other than a tone is joined by an underscore, everything else stands apart.
    """
    names = F.create_map(*[F.lit(x) for pair in emoji_names().items() for x in pair])
    tones = [chr(cp) for cp in SKIN_TONES]

    def spell(chars: Column) -> Column:
        def joins(i: Column) -> Column:
            return F.coalesce(F.get(chars, i).isin(tones) & (i > 0) & ~F.get(chars, i - 1).isin(tones), F.lit(False))

        def one(char: Column, i: Column) -> Column:
            name = F.coalesce(F.element_at(names, char), char)
            left = F.when(joins(i), "_").otherwise(before)
            return F.concat(left, name, F.when(joins(i + 1), "").otherwise(after))

        return F.array_join(F.transform(chars, one), "")

    return F.get(F.transform(F.array(characters(emojis)), spell), 0)


def spell_in_place(text: Column, before: str = "", after: str = " ") -> Column:
    """The text with every emoji replaced by its short name."""
    run = F.lit(f"(?:(?![{_PLAIN}]){EMOJI})+")
    runs = F.regexp_extract_all(text, run, F.lit(0))
    pieces = F.zip_with(
        F.split(text, f"(?:(?![{_PLAIN}]){EMOJI})+", -1),
        F.transform(runs, lambda r: name_text(r, before, after)),
        lambda plain, name: F.concat(F.coalesce(plain, F.lit("")), F.coalesce(name, F.lit(""))),
    )
    return F.when(text.rlike(EMOJI), F.array_join(pieces, "")).otherwise(text)
