"""Cultural identity: signals, summaries, keyword statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from glosa.functions import culture as signals_of
from glosa.functions.culture import short
from glosa.functions.patterns import WORD, contains_any
from glosa.operators import culture
from glosa.plans import views
from glosa.plans.geo_queries import sql_trend
from glosa.plans.registry import query, sql_array, sql_text
from glosa.plans.text_queries import SQL_FIRST, _LOW, sql_has, sql_hits, sql_r6, t
from glosa.plans.views import COMMENTS, with_
from glosa.vocab import words as vocab

NAMES = culture.NAMES

# ------------------------------------------------------------------ SQL pieces


def _pattern_hits(patterns) -> str:
    return "(" + " + ".join(
        f"CAST(regexp_matches({_LOW}, {sql_text(p.replace(chr(92) + 'w', f'[{WORD}]'))}) AS INTEGER)" for p in patterns
    ) + ")"


def _steps() -> str:
    raw, base, final = [], [], []
    for category in vocab.CATEGORIES:
        c = short(category)
        raw.append(f"list_filter({sql_array(vocab.CULTURAL_DIRECT[category])}, lambda k: contains({_LOW}, k)) AS {c}_words")
        indicators = vocab.CULTURAL_INDICATORS[category]
        raw.append(f"{sql_hits(indicators) if indicators else 0} AS {c}_ind")
        raw.append(f"{_pattern_hits(vocab.CULTURAL_PATTERNS[category])} AS {c}_pat")
        raw.append(f"{sql_hits(vocab.CONTEXT_BOOSTERS[category])} AS {c}_boost")
        base.append(
            f"CASE WHEN len({c}_words) > 0 THEN least(1.0::DOUBLE, len({c}_words) * 0.8::DOUBLE + {c}_ind * 0.2::DOUBLE)"
            f" ELSE 0.0::DOUBLE END AS {c}_kw"
        )
        base.append(f"CASE WHEN {c}_pat > 0 THEN 0.6::DOUBLE + {c}_pat * 0.1::DOUBLE ELSE 0.0::DOUBLE END AS {c}_pc")
        wins = f"{c}_pc > {c}_kw"
        start = f"(CASE WHEN {wins} THEN least(1.0::DOUBLE, {c}_pc) ELSE {c}_kw END)"
        detected = f"(len({c}_words) > 0 OR {c}_pat > 0)"
        boosted = f"({detected} AND {c}_boost > 0)"
        final += [
            f"{detected} AS {c}_detected",
            f"CASE WHEN {boosted} THEN least(1.0::DOUBLE, {start} + {c}_boost * 0.1::DOUBLE) ELSE {start} END AS {c}_confidence",
            f"(CASE WHEN {wins} THEN 'pattern' WHEN len({c}_words) > 0 THEN 'keyword' ELSE '' END)"
            f" || (CASE WHEN {boosted} THEN '+context' ELSE '' END) AS {c}_method",
            f"CASE WHEN {wins} THEN 'patterns: ' || {c}_pat ELSE array_to_string({c}_words, '; ') END AS {c}_matches",
        ]
    n = " + ".join(f"CAST({c}_detected AS INTEGER)" for c in NAMES)
    total = " + ".join(f"{c}_confidence" for c in NAMES)
    return f"""s1 AS MATERIALIZED (SELECT *, {', '.join(raw)} FROM comments),
s2 AS (SELECT *, {', '.join(base)} FROM s1),
s3 AS (SELECT comment_id, video, published_at, {', '.join(final)} FROM s2),
scored AS MATERIALIZED (SELECT *, {n} AS n_categories, CASE WHEN ({n}) > 0 THEN least(1.0::DOUBLE,
  ({total}) / ({n}) + least(0.2::DOUBLE, (({n}) - 1) * 0.1::DOUBLE)) ELSE 0.0::DOUBLE END AS overall_score FROM s3),
detected AS MATERIALIZED (SELECT * FROM scored WHERE n_categories > 0)"""


SCORED = _steps()
LONG = "long AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT comment_id, video, published_at, '{c}' AS category, {c}_confidence AS confidence, {c}_method AS method,"
    f" {c}_matches AS matches FROM detected WHERE {c}_detected"
    for c in NAMES
) + ")"
LABELLED = (
    "firsts AS (SELECT *, " + ", ".join(f"{SQL_FIRST[c]} AS {short(c)}" for c in vocab.CATEGORIES) + " FROM comments), "
    "labelled AS MATERIALIZED (SELECT * FROM firsts WHERE coalesce(" + ", ".join(NAMES) + ") IS NOT NULL)"
)
YEARLY = (
    "yearly AS MATERIALIZED (SELECT video, CAST(year(published_at) AS INTEGER) AS year, count(*) AS total, "
    + ", ".join(f"count({c}) AS {c}" for c in NAMES) + ", "
    + ", ".join(f"{sql_r6(f'count({c}) * 100.0 / count(*)')} AS {c}_pct" for c in NAMES)
    + " FROM labelled GROUP BY 1, 2)"
)
TOTALS = (
    "unrolled AS (" + " UNION ALL ".join(f"SELECT video, '{c}' AS category, {c} AS n, {c}_pct AS pct FROM yearly" for c in NAMES)
    + f"), totals AS MATERIALIZED (SELECT video, category, CAST(sum(n) AS BIGINT) AS total, CAST(round(avg(pct), 1) AS DOUBLE) AS mean_yearly_pct, "
    f"{sql_r6('sum(n) * 100.0 / sum(sum(n)) OVER (PARTITION BY video)')} AS share_pct FROM unrolled GROUP BY 1, 2)"
)


def scored(spark, sf):
    return culture.signals(views.comments(spark, sf, labelled=False))


def labelled(spark, sf):
    return culture.labelled(views.comments(spark, sf, labelled=False))


# ------------------------------------------------------------------- signals


def step_query(name, column):
    select = ", ".join(
        f"{sql_r6(f'{c}_{column}') if column == 'confidence' else f'{c}_{column}'} AS {c}" for c in NAMES
    )

    @query(name, with_(COMMENTS, SCORED) + f"SELECT comment_id, {select} FROM scored")
    def plan(spark, sf):
        every = signals_of.with_signals(views.comments(spark, sf, labelled=False))
        rounded = [
            (F.round(f"{c}_{column}", 6) if column == "confidence" else F.col(f"{c}_{column}")).alias(c) for c in NAMES
        ]
        return every.select("comment_id", *rounded)


step_query("F28_category_matches", "matches")
step_query("F29_category_method", "method")
step_query("F30_category_confidence", "confidence")


@query(
    "F31_overall_score",
    with_(COMMENTS, SCORED) + f"SELECT comment_id, n_categories, {sql_r6('overall_score')} AS overall_score FROM detected",
)
def overall_score(spark, sf):
    return scored(spark, sf).select("comment_id", "n_categories", F.round("overall_score", 6).alias("overall_score"))


# ------------------------------------------------------------------ summaries


@query(
    "A09_category_summary",
    with_(COMMENTS, SCORED, LONG)
    + f"""SELECT category, count(*) AS detected, {sql_r6('avg(confidence)')} AS mean_confidence,
  count(*) FILTER (confidence > 0.8) AS high_confidence FROM long GROUP BY 1""",
)
def category_summary(spark, sf):
    return culture.category_summary(scored(spark, sf))


@query(
    "A09_category_methods",
    with_(COMMENTS, SCORED, LONG) + "SELECT category, method, count(*) AS n FROM long GROUP BY 1, 2",
)
def category_methods(spark, sf):
    return culture.category_methods(scored(spark, sf))


@query(
    "A09_top_matches",
    with_(COMMENTS, SCORED, LONG)
    + """SELECT category, term, n, CAST(row_number() OVER (PARTITION BY category ORDER BY n DESC, term) AS INTEGER) AS place
FROM (SELECT category, trim(term) AS term, count(*) AS n FROM (
  SELECT category, unnest(string_split(matches, ';')) AS term FROM long) GROUP BY 1, 2) QUALIFY place <= 5""",
)
def top_matches(spark, sf):
    return culture.top_matches(scored(spark, sf))


@query("A10_yearly_categories", with_(COMMENTS, LABELLED, YEARLY) + "SELECT * FROM yearly")
def yearly_categories(spark, sf):
    return culture.yearly_categories(labelled(spark, sf))


@query(
    "A11_category_totals",
    with_(COMMENTS, LABELLED, YEARLY, TOTALS) + "SELECT video, category, total, share_pct FROM totals",
)
def category_totals(spark, sf):
    totals = culture.category_totals(culture.yearly_categories(labelled(spark, sf)))
    return totals.select("video", "category", "total", "share_pct")


@query(
    "W04_dominant_category",
    with_(COMMENTS, LABELLED, YEARLY, TOTALS)
    + f"""SELECT video, category, total, mean_yearly_pct FROM totals QUALIFY row_number() OVER (PARTITION BY video
  ORDER BY total DESC, list_position({sql_array(NAMES)}, category)) = 1""",
)
def dominant_category(spark, sf):
    return culture.dominant_category(culture.category_totals(culture.yearly_categories(labelled(spark, sf))))


@query(
    "A12_mean_yearly_share",
    with_(COMMENTS, LABELLED, YEARLY, TOTALS) + "SELECT video, category, total, mean_yearly_pct FROM totals",
)
def mean_yearly_share(spark, sf):
    totals = culture.category_totals(culture.yearly_categories(labelled(spark, sf)))
    return totals.select("video", "category", "total", "mean_yearly_pct")


@query(
    "A13_category_by_year",
    with_(COMMENTS, SCORED, LONG)
    + f"""SELECT category, CAST(year(published_at) AS INTEGER) AS year, count(*) AS n,
  {sql_r6('avg(confidence)')} AS mean_confidence FROM long GROUP BY 1, 2""",
)
def category_by_year(spark, sf):
    return culture.yearly_confidence(scored(spark, sf))


@query(
    "A13_category_trend",
    with_(
        COMMENTS, SCORED, LONG,
        "y AS (SELECT category, year(published_at) AS period, count(*) AS n FROM long GROUP BY 1, 2)",
        "tr AS (" + sql_trend("y", "category") + ")",
    )
    + """SELECT tr.*, peak_year FROM tr JOIN (SELECT category, CAST(arg_max(period, (n, -period)) AS INTEGER) AS peak_year
  FROM y GROUP BY 1) p ON tr.category = p.category""",
)
def category_trend(spark, sf):
    return culture.yearly_trend(culture.yearly_confidence(scored(spark, sf)))


@query(
    "A14_detection_quality",
    with_(COMMENTS, SCORED)
    + f"""SELECT count(*) AS total, {sql_r6('avg(overall_score)')} AS mean_score,
  count(*) FILTER (overall_score > 0.8) AS high_confidence, count(*) FILTER (n_categories > 1) AS multi_category FROM detected""",
)
def detection_quality(spark, sf):
    return culture.detection_quality(scored(spark, sf))


@query(
    "A14_method_distribution",
    with_(COMMENTS, SCORED, LONG) + "SELECT method, count(*) AS n FROM long GROUP BY 1",
)
def method_distribution(spark, sf):
    return culture.by_category(scored(spark, sf)).groupBy("method").agg(F.count("*").alias("n"))


_PAIRS = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[i + 1:]]


@query(
    "A15_category_intersections",
    with_(COMMENTS, SCORED)
    + " UNION ALL ".join(
        f"SELECT '{a} + {b}' AS pair, count(*) FILTER ({a}_detected AND {b}_detected) AS n FROM detected" for a, b in _PAIRS
    ),
)
def category_intersections(spark, sf):
    return culture.intersections(scored(spark, sf))


@query(
    "A16_diversity",
    with_(COMMENTS, SCORED, LONG)
    + f"""SELECT count(*) AS categories, CASE WHEN count(*) > 1 THEN {sql_r6('sum(-p * log2(p)) / log2(count(*))')} ELSE 0.0 END AS diversity
FROM (SELECT category, count(*) * 1.0::DOUBLE / sum(count(*)) OVER () AS p FROM long GROUP BY 1)""",
)
def diversity(spark, sf):
    return culture.diversity(scored(spark, sf))


@query(
    "A17_dataset_comparison",
    with_(COMMENTS, SCORED)
    + f"""SELECT video, count(*) AS total, count(*) FILTER (n_categories > 0) AS detected,
  {sql_r6('count(*) FILTER (n_categories > 0) * 100.0 / count(*)')} AS pct FROM scored GROUP BY 1""",
)
def dataset_comparison(spark, sf):
    return culture.dataset_comparison(signals_of.with_signals(views.comments(spark, sf, labelled=False)))


def _occurrence_sql(by: str) -> str:
    parts = []
    for category in vocab.CATEGORIES[:2]:
        for word in vocab.CULTURAL_BASIC[category]:
            count = f"(length({_LOW}) - length(replace({_LOW}, '{word}', ''))) // {len(word)}"
            parts.append(
                f"SELECT {by}, '{short(category)}' AS category, '{word}' AS keyword, CAST(sum(CASE WHEN {short(category)}"
                f" IS NOT NULL THEN {count} ELSE 0 END) AS BIGINT) AS n FROM labelled GROUP BY ALL"
            )
    return " UNION ALL ".join(parts)


@query("A18_keyword_occurrences", with_(COMMENTS, LABELLED) + _occurrence_sql("video"))
def keyword_occurrences(spark, sf):
    return culture.keyword_occurrences(labelled(spark, sf), ["video"])


@query(
    "A18_keyword_ranking",
    with_(COMMENTS, LABELLED, "occ AS (" + _occurrence_sql("video") + ")")
    + "SELECT category, keyword, CAST(sum(n) AS BIGINT) AS n FROM occ GROUP BY 1, 2",
)
def keyword_ranking(spark, sf):
    return culture.keyword_occurrences(labelled(spark, sf), []).orderBy(F.desc("n"), "category", "keyword")


@query(
    "A19_keyword_occurrences_by_year",
    with_(COMMENTS, LABELLED) + _occurrence_sql("video, CAST(year(published_at) AS INTEGER) AS year"),
)
def keyword_occurrences_by_year(spark, sf):
    rows = labelled(spark, sf).withColumn("year", F.year("published_at"))
    return culture.keyword_occurrences(rows, ["video", "year"])


@query(
    "A33_keyword_documents",
    with_(COMMENTS)
    + " UNION ALL ".join(
        f"SELECT '{short(c)}' AS category, '{w}' AS keyword, count(*) FILTER (contains({_LOW}, '{w}')) AS n FROM comments"
        for c, ws in vocab.CULTURAL_CONFIG.items()
        for w in ws
    ),
)
def keyword_documents(spark, sf):
    return culture.keyword_documents(views.comments(spark, sf, labelled=False), vocab.CULTURAL_CONFIG)


_CAT_HITS = {c: sql_has(t, ws) for c, ws in vocab.CULTURAL_CONFIG.items()}


@query(
    "A33_category_coverage",
    with_(COMMENTS)
    + "SELECT count(*) AS total, "
    + ", ".join(f"count(*) FILTER ({e}) AS {short(c)}_rows" for c, e in _CAT_HITS.items())
    + f", count(*) FILTER ({' OR '.join(_CAT_HITS.values())}) AS distinct_rows FROM comments",
)
def category_coverage(spark, sf):
    """Rows per category, and the rows with any category (their sum would count some rows twice)."""
    c = views.comments(spark, sf, labelled=False)
    marked = c.select(*[contains_any(F.col(t), ws).alias(short(k)) for k, ws in vocab.CULTURAL_CONFIG.items()])
    any_hit = F.col(NAMES[0]) | F.col(NAMES[1]) | F.col(NAMES[2])
    return marked.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col(n)).alias(f"{n}_rows") for n in NAMES],
        F.count_if(any_hit).alias("distinct_rows"),
    )
