"""Geographic analysis end to end, countries, counts over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from glosa.functions import emoji, geo
from glosa.functions.patterns import WORD, escape
from glosa.operators import filters, geography, joins, statistics
from glosa.plans import views
from glosa.plans.registry import query, sql_array, sql_rows, sql_text
from glosa.plans.text_queries import (
    SQL_LOCATION_CONF, SQL_LOCATIONS, _FLAG_CASE, _FLAGS, _KEYWORD_CONF, _LOW, sql_has, sql_has_word,
    sql_hits, sql_r6, t,
)
from glosa.plans.views import COMMENTS, with_
from glosa.vocab import words as vocab
from glosa.vocab.countries import country_rows, flag_of

COUNTRY_NAMES = [name for _, _, name in country_rows()]

# ------------------------------------------------------------------ SQL pieces
HITS = f"""sig AS MATERIALIZED (
  SELECT *, {_FLAGS} AS flags, {SQL_LOCATIONS} AS places, {sql_hits(vocab.GEO_KEYWORDS)} AS n_keywords FROM comments),
hits AS MATERIALIZED (
  SELECT * EXCLUDE (flags, places, n_keywords), 0.9::DOUBLE AS confidence, 3 AS rank, 'flag_emoji' AS method,
    array_to_string(list_transform(flags, lambda f: CASE f {_FLAG_CASE} ELSE 'Unknown_' || f END), ';') AS detail
  FROM sig WHERE len(flags) > 0
  UNION ALL SELECT * EXCLUDE (flags, places, n_keywords), CAST({_KEYWORD_CONF} AS DOUBLE), 2, 'keyword',
    array_to_string(list_filter({sql_array(vocab.GEO_KEYWORDS)}, lambda k: contains({_LOW}, k)), ';')
  FROM sig WHERE n_keywords > 0
  UNION ALL SELECT * EXCLUDE (flags, places, n_keywords), CAST({SQL_LOCATION_CONF} AS DOUBLE), 1, 'location_mention',
    array_to_string(places, ';') FROM sig WHERE len(places) > 0)"""

BEST = """best AS MATERIALIZED (
  SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (
    PARTITION BY original_comment ORDER BY confidence DESC, rank DESC, comment_id) AS n FROM hits) WHERE n = 1)"""


def _alias_case() -> str:
    out = []
    for alias, name in vocab.COUNTRY_ALIASES:
        right = f"($|[^{WORD}])" if alias[-1].isalnum() else f"[{WORD}]"
        pattern = f"(^|[^{WORD}]){escape(alias)}{right}"
        out.append(f"WHEN regexp_matches({t}, {sql_text(pattern)}, 'i') THEN {sql_text(name)}")
    return " ".join(out)


_NAMES_RE = sql_text(f"(?i)(^|[^{WORD}])({'|'.join(escape(n) for n in COUNTRY_NAMES)})($|[^{WORD}])")
COUNTRY_TABLE = "country(alpha2, alpha3, name, flag) AS (VALUES " + sql_rows(
    (a2, a3, name, flag_of(a2)) for a2, a3, name in country_rows()
) + ")"
SQL_COUNTRY_OF_TEXT = (
    f"CASE {_alias_case()} ELSE (SELECT min(name) FROM country WHERE lower(name) = "
    f"lower(regexp_extract({t}, {_NAMES_RE}, 2))) END"
)
SQL_ALPHA2 = (
    f"translate(regexp_extract({t}, '{emoji.FLAG}'), {sql_text(''.join(chr(0x1F1E6 + i) for i in range(26)))}, "
    "'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
)
UNIFIED = f"""{COUNTRY_TABLE},
located AS (SELECT *, (SELECT name FROM country WHERE alpha2 = {SQL_ALPHA2}) AS flagged,
  CASE WHEN {sql_has(t, vocab.GEO_KEYWORDS_BASIC)} OR {sql_has_word(t, vocab.LOCATIONS_BASIC, [vocab.CITY_SUFFIX_PATTERN])}
    THEN {SQL_COUNTRY_OF_TEXT} END AS named FROM comments),
unified AS MATERIALIZED (
  SELECT video, comment_id, coalesce(lower(spam_label) = 'spam', false) AS is_spam,
    coalesce(emotion_label, 'unknown') AS emotion, CAST(year(published_at) AS INTEGER) AS year,
    coalesce(flagged, named) AS country, CASE WHEN flagged IS NOT NULL THEN 'flag' ELSE 'text' END AS source
  FROM (SELECT *, row_number() OVER (PARTITION BY video, {t} ORDER BY comment_id) AS n FROM located
    WHERE coalesce(flagged, named) IS NOT NULL) WHERE n = 1)"""
CUBE = """finest AS (SELECT video, year, country, is_spam, emotion, count(*) AS n FROM unified GROUP BY ALL),
cube AS MATERIALIZED (SELECT video, year, country,
  CASE WHEN grouping(is_spam) = 1 THEN 'All' WHEN is_spam THEN 'Spam' ELSE 'Non-Spam' END AS spam_mode,
  CASE WHEN grouping(emotion) = 1 THEN 'All' ELSE emotion END AS emotion_mode, CAST(sum(n) AS BIGINT) AS n
  FROM finest GROUP BY GROUPING SETS ((video, year, country), (video, year, country, is_spam),
    (video, year, country, emotion), (video, year, country, is_spam, emotion))
  HAVING grouping(emotion) = 1 OR emotion <> 'unknown')"""
GEO_MONTHS = "months AS (SELECT strftime(published_at, '%Y-%m') AS period, count(*) AS n FROM best GROUP BY 1)"


def unlabelled(spark, sf):
    return views.comments(spark, sf, labelled=False)


def best_hits(spark, sf):
    return geography.best_hits(unlabelled(spark, sf).select("comment_id", "published_at", t))


def unified(spark, sf):
    labels = views.table(spark, sf, "labels").select(
        F.col("doc_id").alias("comment_id"), views.spam_label(F.col("toxic")).alias("spam_label")
    )
    return geography.unified_countries(unlabelled(spark, sf), labels)


# ---------------------------------------------------------- extraction and dedupe


@query(
    "U01_tagged_hits",
    with_(COMMENTS, HITS) + f"SELECT comment_id, method, {sql_r6('confidence')} AS confidence, detail FROM hits",
)
def tagged_hits(spark, sf):
    hits = geography.all_hits(unlabelled(spark, sf))
    return hits.select("comment_id", "method", F.round("confidence", 6).alias("confidence"), "detail")


@query(
    "U02_union_distinct",
    with_(COMMENTS)
    + f"""SELECT {t}, published_at_text, spam_label, emotion_label FROM (
  SELECT *, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at_text FROM comments WHERE {sql_has(t, vocab.GEO_KEYWORDS_BASIC)}
  UNION SELECT *, strftime(published_at, '%Y-%m-%d %H:%M:%S') FROM comments WHERE regexp_matches({t}, '{emoji.FLAG}')
  UNION SELECT *, strftime(published_at, '%Y-%m-%d %H:%M:%S') FROM comments
    WHERE {sql_has_word(t, vocab.LOCATIONS_BASIC, [vocab.CITY_SUFFIX_PATTERN])})""",
)
def union_distinct(spark, sf):
    """One scan with the three conditions joined by OR equals the union of three scans."""
    c = views.comments(spark, sf)
    text = F.col(t)
    keep = geo.has_flag(text) | geo.has_keyword(text, vocab.GEO_KEYWORDS_BASIC) | geo.has_basic_location(text)
    columns = [t, F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at_text"), "spam_label", "emotion_label"]
    return c.filter(keep).select(*columns).distinct()


@query(
    "W02_best_hit_per_text",
    with_(COMMENTS, HITS, BEST) + f"SELECT comment_id, method, {sql_r6('confidence')} AS confidence, detail FROM best",
)
def best_hit_per_text(spark, sf):
    best = best_hits(spark, sf)
    return best.select("comment_id", "method", F.round("confidence", 6).alias("confidence"), "detail")


@query(
    "E1_geographic_analysis",
    with_(
        COMMENTS.replace("comments AS", "every_comment AS", 1),
        f"comments AS MATERIALIZED (SELECT * FROM every_comment WHERE length({t}) BETWEEN 3 AND 10000 "
        "AND year(published_at) BETWEEN 2005 AND 2025)",
        HITS, BEST,
    )
    + f"""SELECT strftime(published_at, '%Y-%m') AS period, method, count(*) AS n, {sql_r6('avg(confidence)')} AS mean_confidence,
  count(*) FILTER (confidence > 0.8) AS high_confidence FROM best GROUP BY 1, 2""",
)
def geographic_analysis(spark, sf):
    """Validate, extract, keep the best hit per text, count by month and method."""
    valid = filters.validated(unlabelled(spark, sf).select("comment_id", "published_at", t))
    best = geography.best_hits(valid)
    return best.groupBy(F.date_format("published_at", "yyyy-MM").alias("period"), "method").agg(
        F.count("*").alias("n"),
        F.round(F.avg("confidence"), 6).alias("mean_confidence"),
        F.count_if(F.col("confidence") > 0.8).alias("high_confidence"),
    )


# ------------------------------------------------------------------- time


def geo_months(spark, sf):
    return statistics.period_counts(best_hits(spark, sf))


@query("A01_monthly_counts", with_(COMMENTS, HITS, BEST, GEO_MONTHS) + "SELECT period, n FROM months")
def monthly_counts(spark, sf):
    return geo_months(spark, sf)


for _freq, _fmt in {"D": "%Y-%m-%d", "Y": "%Y"}.items():

    @query(
        f"A01_period_counts_{_freq}",
        with_(COMMENTS) + f"SELECT video, strftime(published_at, '{_fmt}') AS period, count(*) AS n FROM comments GROUP BY 1, 2",
    )
    def period_counts(spark, sf, freq=_freq):
        return statistics.period_counts(views.comments(spark, sf, labelled=False, text=False), freq=freq, by=["video"])


@query("A02_value_counts", with_(COMMENTS, HITS, BEST) + "SELECT method, count(*) AS n FROM best GROUP BY 1")
def value_counts(spark, sf):
    return statistics.value_counts(best_hits(spark, sf), "method")


@query(
    "A04_temporal_summary",
    with_(COMMENTS, HITS, BEST, GEO_MONTHS)
    + f"""SELECT count(*) AS periods, arg_max(period, (n, -CAST(replace(period, '-', '') AS BIGINT))) AS peak_period,
  max(n) AS peak_count, {sql_r6('avg(n)')} AS mean_per_period FROM months""",
)
def temporal_summary(spark, sf):
    return statistics.temporal_summary(geo_months(spark, sf))


_MONTHS_BY_VIDEO = "months AS (SELECT video, strftime(published_at, '%Y-%m') AS period, count(*) AS n FROM comments GROUP BY 1, 2)"


def sql_trend(source: str, by: str) -> str:
    return f"""SELECT {by}, count(*) AS periods, CASE WHEN count(*) < 2 THEN 'insufficient_data'
  WHEN stddev_pop(n) > 0 AND corr(x, n) > 0.3 THEN 'increasing' WHEN stddev_pop(n) > 0 AND corr(x, n) < -0.3 THEN 'decreasing'
  ELSE 'stable' END AS trend, CASE WHEN stddev_pop(n) > 0 THEN {sql_r6('corr(x, n)')} END AS r
FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY period) AS x FROM {source}) GROUP BY {by}"""


@query("A05_trend", with_(COMMENTS, _MONTHS_BY_VIDEO) + sql_trend("months", "video"))
def trend(spark, sf):
    months = statistics.period_counts(views.comments(spark, sf, labelled=False, text=False), by=["video"])
    return statistics.trend(months, ["video"])


@query(
    "A05_trend_by_label",
    with_(COMMENTS, "years AS (SELECT emotion_label, strftime(published_at, '%Y') AS period, count(*) AS n FROM comments GROUP BY 1, 2)")
    + sql_trend("years", "emotion_label"),
)
def trend_by_label(spark, sf):
    c = views.comments(spark, sf, labelled=False, text=False)
    return statistics.trend(statistics.period_counts(c, freq="Y", by=["emotion_label"]), ["emotion_label"])


@query(
    "A06_seasonality",
    with_(COMMENTS, _MONTHS_BY_VIDEO)
    + f"""SELECT video, CASE WHEN sum(periods) >= 12 THEN 'detected' ELSE 'insufficient_data' END AS pattern,
  CASE WHEN sum(periods) >= 12 THEN arg_max(month, (mean, -month)) END AS peak_month,
  CASE WHEN sum(periods) >= 12 THEN {sql_r6('stddev_samp(mean)')} END AS seasonal_variation
FROM (SELECT video, CAST(period[6:7] AS INTEGER) AS month, avg(n) AS mean, count(*) AS periods FROM months GROUP BY 1, 2) GROUP BY 1""",
)
def seasonality(spark, sf):
    months = statistics.period_counts(views.comments(spark, sf, labelled=False, text=False), by=["video"])
    return statistics.seasonality(months, ["video"])


@query(
    "A07_confidence_summary",
    with_(COMMENTS, HITS, BEST)
    + f"""SELECT method, count(*) AS n, {sql_r6('avg(confidence)')} AS mean_confidence,
  count(*) FILTER (confidence > 0.8) AS high_confidence FROM best GROUP BY 1""",
)
def confidence_summary(spark, sf):
    best = best_hits(spark, sf)
    return best.groupBy("method").agg(
        F.count("*").alias("n"),
        F.round(F.avg("confidence"), 6).alias("mean_confidence"),
        F.count_if(F.col("confidence") > 0.8).alias("high_confidence"),
    )


@query(
    "A08_top_countries",
    with_(COMMENTS, HITS, BEST)
    + """SELECT country, count(*) AS n FROM (SELECT unnest(string_split(detail, ';')) AS country FROM best
  WHERE method = 'flag_emoji') GROUP BY 1 ORDER BY n DESC, country LIMIT 10""",
)
def top_countries(spark, sf):
    flagged = best_hits(spark, sf).filter("method = 'flag_emoji'")
    countries = flagged.select(F.explode(F.split("detail", ";")).alias("country"))
    return statistics.top(statistics.value_counts(countries, "country"), 10, "country")


# ---------------------------------------------------------------- countries


@query(
    "F20_country_of_flag",
    with_(COMMENTS, COUNTRY_TABLE)
    + f"""SELECT comment_id, name AS country FROM (SELECT comment_id, {SQL_ALPHA2} AS a2 FROM comments) LEFT JOIN country
  ON a2 = alpha2 WHERE a2 <> ''""",
)
def country_of_flag(spark, sf):
    c = unlabelled(spark, sf).withColumn("flag", geo.first_flag(F.col(t))).filter("flag IS NOT NULL")
    countries = geography.country_table(spark).select("alpha2", "country")
    coded = c.select("comment_id", emoji.flag_alpha2(F.col("flag")).alias("alpha2"))
    return coded.join(F.broadcast(countries), "alpha2", "left").select("comment_id", "country")


@query(
    "F21_country_of_text",
    with_(COMMENTS, COUNTRY_TABLE)
    + f"SELECT comment_id, country FROM (SELECT comment_id, {SQL_COUNTRY_OF_TEXT} AS country FROM comments) WHERE country IS NOT NULL",
)
def country_of_text(spark, sf):
    c = unlabelled(spark, sf).withColumn("country", geo.country_of_text(F.col(t)))
    return c.select("comment_id", "country").filter("country IS NOT NULL")


@query(
    "F22_country_codes",
    with_(COMMENTS, UNIFIED)
    + """SELECT DISTINCT u.country, alpha3, coalesce(flag, '🏳️') AS flag FROM unified u LEFT JOIN country ON u.country = name""",
)
def country_codes(spark, sf):
    rows = unified(spark, sf)
    countries = geography.country_table(spark).select("country", "alpha3", "flag")
    named = rows.select("country").distinct().join(F.broadcast(countries), "country", "left")
    return named.fillna("🏳️", ["flag"])


@query(
    "J03_dimension_lookup",
    """SELECT n_nationkey, n_name, r_name, c_count FROM nation JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT c_nationkey, count(*) AS c_count FROM customer GROUP BY 1) ON n_nationkey = c_nationkey""",
)
def dimension_lookup(spark, sf):
    nation, region = views.table(spark, sf, "nation"), views.table(spark, sf, "region")
    counts = views.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("c_count"))
    named = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    joined = named.join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return joined.select("n_nationkey", "n_name", "r_name", "c_count")


@query(
    "J04_dictionary_match",
    with_(
        COMMENTS, COUNTRY_TABLE,
        f"""near AS MATERIALIZED (SELECT comment_id, name, {_LOW} AS low FROM comments JOIN country ON contains({_LOW}, lower(name)))""",
    )
    + f"""SELECT comment_id, name AS country FROM near
WHERE regexp_matches(low, '(^|[^{WORD}])' || regexp_escape(lower(name)) || '($|[^{WORD}])')""",
)
def dictionary_match(spark, sf):
    names = geography.country_table(spark).select(F.col("country").alias("entry"))
    return joins.dictionary_match(unlabelled(spark, sf), t, names, "entry").select("comment_id", F.col("entry").alias("country"))


@query(
    "W03_unified_countries",
    with_(COMMENTS, UNIFIED) + "SELECT comment_id, video, is_spam, emotion, year, country, source FROM unified",
)
def unified_countries(spark, sf):
    rows = unified(spark, sf)
    return rows.select("comment_id", "video", "is_spam", "emotion", "year", "country", "source")


@query(
    "A20_country_counts",
    with_(COMMENTS, UNIFIED)
    + "SELECT video, country, alpha3, count(*) AS n FROM unified JOIN country ON country = name GROUP BY 1, 2, 3",
)
def country_counts(spark, sf):
    rows = unified(spark, sf)
    return geography.country_counts(rows).select("video", "country", "alpha3", "n")


@query(
    "A20_country_counts_by_selection",
    with_(COMMENTS, UNIFIED, CUBE)
    + """SELECT video, spam_mode, emotion_mode, c.country, alpha3, CAST(sum(n) AS BIGINT) AS n
FROM cube c JOIN country ON c.country = name GROUP BY ALL""",
)
def country_counts_by_selection(spark, sf):
    cube = geography.selection_cube(unified(spark, sf))
    return geography.country_counts_by_selection(cube)


@query("A21_selection_cube", with_(COMMENTS, UNIFIED, CUBE) + "SELECT * FROM cube")
def selection_cube(spark, sf):
    return geography.selection_cube(unified(spark, sf))


@query(
    "W01_top5_countries_per_year",
    with_(COMMENTS, UNIFIED, CUBE)
    + """SELECT *, CAST(row_number() OVER (PARTITION BY video, spam_mode, emotion_mode, year ORDER BY n DESC, country) AS INTEGER) AS place
FROM cube QUALIFY place <= 5""",
)
def top5_countries_per_year(spark, sf):
    cube = geography.selection_cube(unified(spark, sf))
    return geography.top_countries_per_year(cube)


_STATS = """ranked AS (SELECT video, year, country, count(*) AS n FROM unified GROUP BY ALL),
stats AS (SELECT video, year, CAST(sum(n) AS BIGINT) AS total, count(*) AS unique_countries,
  first(country ORDER BY n DESC, country) AS top_country, max(n) AS top_count FROM ranked GROUP BY 1, 2)"""


@query("A22_yearly_geo_stats", with_(COMMENTS, UNIFIED, _STATS) + "SELECT * FROM stats")
def yearly_geo_stats(spark, sf):
    return geography.yearly_stats(unified(spark, sf))


@query(
    "A22_peak_year",
    with_(COMMENTS, UNIFIED, _STATS)
    + """SELECT video, CAST(sum(total) AS BIGINT) AS total, arg_max(year, (total, -year)) AS peak_year, max(total) AS peak_total,
  max(unique_countries) AS max_countries FROM stats GROUP BY 1""",
)
def peak_year(spark, sf):
    return geography.peak_year(geography.yearly_stats(unified(spark, sf)))


@query(
    "A30_reference_counts",
    with_(COMMENTS, HITS) + "SELECT video, method, count(*) AS n FROM hits GROUP BY 1, 2",
)
def reference_counts(spark, sf):
    return statistics.value_counts(geography.all_hits(unlabelled(spark, sf)), "video", "method")


@query(
    "A34_signal_coverage",
    with_(COMMENTS)
    + f"""SELECT count(*) AS total, count(*) FILTER (k) AS keyword_rows, count(*) FILTER (f) AS flag_rows,
  count(*) FILTER (p) AS location_rows, count(*) FILTER (k OR f OR p) AS any_rows,
  {sql_r6('count(*) FILTER (k OR f OR p) * 100.0 / count(*)')} AS coverage
FROM (SELECT {sql_has(t, vocab.GEO_KEYWORDS)} AS k, regexp_matches({t}, '{emoji.FLAG}') AS f,
  {sql_has_word(t, vocab.LOCATIONS_ENHANCED)} AS p FROM comments)""",
)
def signal_coverage(spark, sf):
    return geography.signal_coverage(unlabelled(spark, sf))
