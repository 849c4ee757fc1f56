"""Geographic extraction: keyword, flag and place hits, one row per distinct text, countries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glosa.functions import emoji, geo
from glosa.functions.spam import is_true
from glosa.session import compute_once
from glosa.vocab.countries import country_table
from glosa.vocab.words import EMOTIONS, GEO_KEYWORDS_BASIC

TEXT = "original_comment"


def _hit(condition, confidence, rank, method, detail):
    fields = [
        confidence.alias("confidence"), F.lit(rank).alias("rank"), F.lit(method).alias("method"),
        detail.alias("detail"),
    ]
    return F.when(condition, F.struct(*fields))


def with_hits(df: DataFrame, text: str = TEXT) -> DataFrame:
    """Adds ``hits``: an array of (confidence, rank, method, detail), empty where nothing matches.

    One pass over the text.  ``rank`` settles equal confidences: flag before
    keyword before place.
    """
    t = F.col(text)
    found = df.withColumns(
        {
            "_keywords": geo.matched_keywords(t),
            "_confidence": geo.keyword_confidence(t),
            "_flags": emoji.flags(t),
            "_places": geo.locations(t),
        }
    )
    hits = F.array_compact(
        F.array(
            _hit(F.size("_flags") > 0, F.lit(0.9), 3, "flag_emoji",
                 F.array_join(emoji.flag_names(F.col("_flags")), ";")),
            _hit(F.col("_keywords") != "", F.col("_confidence"), 2, "keyword", F.col("_keywords")),
            _hit(F.size("_places") > 0, geo.location_confidence(F.col("_places")), 1,
                 "location_mention", F.array_join("_places", ";")),
        )
    )
    return compute_once(found, {"hits": hits}).drop("_keywords", "_confidence", "_flags", "_places")


def all_hits(df: DataFrame, text: str = TEXT) -> DataFrame:
    """One row per comment and method that matches; not de-duplicated."""
    return with_hits(df, text).select("*", F.inline("hits")).drop("hits", "rank")


def best_hits(df: DataFrame, keep_text: bool = False, id_column: str = "comment_id") -> DataFrame:
    """One row per distinct text, with its most confident method.

    Method, confidence and detail depend on the text alone, so the best is chosen inside the row and
    grouped with it; the other columns are those of the smallest id, in buffers of fixed width where they
    are no strings.  Copies of a text combine before the shuffle.  Without ``keep_text`` the texts are
    grouped by their SHA-256 and only digests are shuffled.
    """
    key = F.col(TEXT) if keep_text else F.sha2(TEXT, 256)
    found = with_hits(df).filter(F.size("hits") > 0)
    columns = [c for c in df.columns if c not in (TEXT, id_column)]
    best = F.array_max("hits")
    hit = found.select(key.alias("_key"), id_column, *columns, best["method"].alias("method"),
                       best["confidence"].alias("confidence"), best["detail"].alias("detail"))
    first = hit.groupBy("_key", "method", "confidence", "detail").agg(
        F.min(id_column).alias(id_column), *[F.min_by(c, id_column).alias(c) for c in columns]
    )
    text = [F.col("_key").alias(TEXT)] if keep_text else []
    return first.select(id_column, *columns, *text, "method", "confidence", "detail")


def _dimension(countries: list[tuple] | None, spark) -> DataFrame:
    """The literal country table, the standard one or the caller's (alpha2, alpha3, name) rows, for broadcast."""
    return F.broadcast(country_table(spark, countries))


def unified_countries(
    df: DataFrame, labels: DataFrame | None = None, keep_text: bool = False, countries: list[tuple] | None = None
) -> DataFrame:
    """One row per video and distinct text that names a country.

    A flag wins over words; the country comes from the first flag pair, else from the text of comments with a
    basic keyword or place.  Countries are found first; rows without one go, and with them the texts: what is
    grouped is a digest (unless ``keep_text``) with numbers, so the buffers have a fixed width.  ``labels``
    (comment_id, spam_label) are joined to what is left; without them ``df`` has the column.
    """
    spark, t = df.sparkSession, F.col(TEXT)
    rows = country_table(spark, countries).select("alpha2", "country").collect()  # the literal table
    names = [r.country for r in rows]
    number = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
    of_flag = F.create_map(*[F.lit(x) for i, r in enumerate(rows) for x in (r.alpha2, i)])
    emotions = F.array(*[F.lit(e) for e in EMOTIONS])
    by_words = F.when(geo.has_keyword(t, GEO_KEYWORDS_BASIC) | geo.has_basic_location(t), geo.country_of_text(t, names=names))
    spam = [is_true(F.col("spam_label")).alias("is_spam")] if labels is None else []
    found = compute_once(
        df.select("comment_id", "video", *spam, F.year("published_at").alias("year"),
                  F.array_position(emotions, F.col("emotion_label")).alias("_emotion"), TEXT),
        {"_flagged": F.element_at(of_flag, emoji.flag_alpha2(geo.first_flag(t))), "_named": F.element_at(number, by_words),
         "_key": t if keep_text else F.sha2(t, 256)},
    )
    located = found.filter("coalesce(_flagged, _named) IS NOT NULL AND year IS NOT NULL").select(
        "comment_id", "video", "_key", *(["is_spam"] if spam else []), "year", "_emotion",
        F.coalesce("_flagged", "_named").alias("_country"), F.col("_flagged").isNotNull().alias("_by_flag"),
    )
    fields = [c for c in located.columns if c not in ("comment_id", "video", "_key")]
    first = located.groupBy("video", "_key").agg(
        F.min("comment_id").alias("comment_id"), *[F.min_by(c, "comment_id").alias(c) for c in fields]
    )
    if labels is not None:
        flags = labels.select("comment_id", is_true(F.col("spam_label")).alias("is_spam"))
        first = first.join(flags, "comment_id", "left").fillna(False, ["is_spam"])
    text = [F.col("_key").alias(TEXT)] if keep_text else []
    return first.select(
        "video", "comment_id", "is_spam",
        F.coalesce(F.get(emotions, (F.col("_emotion") - 1).cast("int")), F.lit("unknown")).alias("emotion"), "year",
        F.get(F.array(*[F.lit(n) for n in names]), F.col("_country")).alias("country"),
        F.when(F.col("_by_flag"), "flag").otherwise("text").alias("source"), *text,
    )


def country_counts(unified: DataFrame, countries: list[tuple] | None = None) -> DataFrame:
    """Comments per video and country, with the alpha-3 code; countries without one are left out."""
    counts = unified.groupBy("video", "country").agg(F.count("*").alias("n"))
    return counts.join(_dimension(countries, unified.sparkSession).select("country", "alpha3"), "country")


def country_counts_by_selection(cube: DataFrame, countries: list[tuple] | None = None) -> DataFrame:
    """Comments per video, spam and emotion selection and country, over all years, with the alpha-3 code."""
    counts = cube.groupBy("video", "spam_mode", "emotion_mode", "country").agg(F.sum("n").alias("n"))
    return counts.join(_dimension(countries, cube.sparkSession).select("country", "alpha3"), "country")


def selection_cube(unified: DataFrame) -> DataFrame:
    """Counts per (video, year, country) for every spam and emotion selection, 'All' included.

    Rows are counted once at the finest level; the four grouping sets then run
    over those counts.  The 'unknown' emotion has no selection of its own.
    """
    finest = unified.groupBy("video", "year", "country", "is_spam", "emotion").agg(F.count("*").alias("n"))
    base = ["video", "year", "country"]
    sets = [[F.col(c) for c in base + extra] for extra in ([], ["is_spam"], ["emotion"], ["is_spam", "emotion"])]
    cube = finest.groupingSets(sets, *base, "is_spam", "emotion").agg(
        F.sum("n").alias("n"), F.grouping("is_spam").alias("all_spam"), F.grouping("emotion").alias("all_emotions")
    )
    spam = F.when(F.col("all_spam") == 1, "All").when(F.col("is_spam"), "Spam").otherwise("Non-Spam")
    return cube.filter("all_emotions = 1 OR emotion <> 'unknown'").select(
        *base, spam.alias("spam_mode"),
        F.when(F.col("all_emotions") == 1, "All").otherwise(F.col("emotion")).alias("emotion_mode"), "n",
    )


def top_countries_per_year(cube: DataFrame, k: int = 5) -> DataFrame:
    """The k countries with most comments per video, selection and year; ties by name.

    The window runs over counts: at most one row per country and cell.
    """
    cell = ["video", "spam_mode", "emotion_mode", "year"]
    order = W.partitionBy(*cell).orderBy(F.desc("n"), "country")
    return cube.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def yearly_stats(unified: DataFrame) -> DataFrame:
    """Per video and year: comments, distinct countries, the top country and its count."""
    counts = unified.groupBy("video", "year", "country").agg(F.count("*").alias("n"))
    ranked = counts.withColumn(
        "place", F.row_number().over(W.partitionBy("video", "year").orderBy(F.desc("n"), "country"))
    )
    top = F.col("place") == 1
    return ranked.groupBy("video", "year").agg(
        F.sum("n").alias("total"),
        F.count("*").alias("unique_countries"),
        F.max(F.when(top, F.col("country"))).alias("top_country"),
        F.max(F.when(top, F.col("n"))).alias("top_count"),
    )


def peak_year(stats: DataFrame) -> DataFrame:
    """Per video: total, the year with most comments (earliest on ties) and the most countries in a year."""
    return stats.groupBy("video").agg(
        F.sum("total").alias("total"),
        F.max_by("year", F.struct("total", -F.col("year"))).alias("peak_year"),
        F.max("total").alias("peak_total"),
        F.max("unique_countries").alias("max_countries"),
    )


def signal_coverage(df: DataFrame) -> DataFrame:
    """Rows with each signal, with any of them, and the share of all rows."""
    t = F.col(TEXT)
    keyword, flag, place = geo.has_keyword(t), geo.has_flag(t), geo.has_location(t)
    marked = df.select(keyword.alias("k"), flag.alias("f"), place.alias("p"))
    counts = marked.agg(
        F.count("*").alias("total"),
        F.count_if("k").alias("keyword_rows"),
        F.count_if("f").alias("flag_rows"),
        F.count_if("p").alias("location_rows"),
        F.count_if(F.col("k") | F.col("f") | F.col("p")).alias("any_rows"),
    )
    return counts.withColumn("coverage", F.round(F.try_divide(F.col("any_rows") * 100.0, F.col("total")), 6))
