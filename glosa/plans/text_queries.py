"""Filters and scalar functions over the comments."""

from __future__ import annotations

from pyspark.sql import functions as F

from glosa.functions import culture, emoji, geo, language, spam
from glosa.functions import text as T
from glosa.functions.patterns import SPACE, WORD, contains_any, contains_word, escape
from glosa.operators import filters, languages, linguistics
from glosa.plans import views
from glosa.plans.registry import query, sql_array, sql_list, sql_rows, sql_text
from glosa.plans.views import COMMENTS, RAW, with_
from glosa.session import compute_once
from glosa.vocab import words as vocab
from glosa.vocab.emoji import SKIN_TONES, emoji_names

t = "original_comment"


def comment():
    return F.col(t)


# ------------------------------------------------------------------ SQL pieces


def re_any(words) -> str:
    return sql_text("|".join(escape(w) for w in words))


def sql_has(text: str, words) -> str:
    return f"coalesce(regexp_matches({text}, {re_any(words)}, 'i'), false)"


def sql_has_word(text: str, words, raw=()) -> str:
    body = "|".join([escape(w) for w in words] + list(raw))
    return f"coalesce(regexp_matches({text}, {sql_text(f'(^|[^{WORD}])({body})($|[^{WORD}])')}, 'i'), false)"


def sub(text: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({text}, {sql_text(pattern)}, {sql_text(by)}, 'g')"


def sql_strip(text: str) -> str:
    return sub(text, f"^[{SPACE}]+|[{SPACE}]+$")


def sql_spaces(text: str) -> str:
    return f"trim({sub(text, f'[{SPACE}]+', ' ')})"


def sql_clean(text: str, by: str = "", url: str = T.URL) -> str:
    return sql_spaces(f"lower({sub(sub(text, url), f'[^{WORD}{SPACE}]', by)})")


def sql_words(text: str, least: int = 1) -> str:
    edge = f"^[^{WORD}{SPACE}]+|[^{WORD}{SPACE}]+$"
    return (
        f"list_filter(list_transform(string_split_regex(lower({text}), '[{SPACE}]+'), "
        f"lambda w: {sub('w', edge)}), lambda w: length(w) >= {least})"
    )


def sql_runs(text: str, n: int) -> str:
    """Number of runs of n or more equal characters (no back-references in this dialect)."""
    chars = f"string_split({text}, '')"
    shifts = ", ".join(f"{chars}[{k}:]" for k in range(2, n + 1))
    equal = " AND ".join(f"z[{k}] = z[{k + 1}]" for k in range(2, n + 1))
    return (
        f"len(list_filter(list_zip(list_concat([NULL], {chars}), {chars}, {shifts}), "
        f"lambda z: {equal} AND z[2] <> chr(10) AND z[1] IS DISTINCT FROM z[2]))"
    )


EMOJI = emoji.EMOJI
NOT_EMOJI = "[^" + EMOJI[1:]


def register(name, plan, sql, *ctes):
    """Row-level query over the comments."""
    query(name, with_(COMMENTS, *ctes) + sql)(lambda spark, sf: plan(views.comments(spark, sf, labelled=False)))


# ---------------------------------------------------------------- P: filters


@query(
    "P01_drop_nulls",
    with_(COMMENTS, RAW)
    + "SELECT comment_id, published_at FROM raw WHERE original_comment IS NOT NULL AND published_at IS NOT NULL",
)
def drop_nulls(spark, sf):
    raw = views.raw_comments(spark, sf)
    return raw.na.drop(subset=[t, "published_at"]).select("comment_id", "published_at")


register(
    "P02_length_band",
    lambda c: c.filter(filters.length_between(comment())).select("comment_id", F.length(comment()).alias("n_chars")),
    f"SELECT comment_id, CAST(length({t}) AS INTEGER) AS n_chars FROM comments WHERE length({t}) BETWEEN 3 AND 10000",
)
register(
    "P02_length_min_10",
    lambda c: c.filter((F.col("detected_language") == "es") & (F.length(comment()) >= 10)).select("comment_id"),
    f"SELECT comment_id FROM comments WHERE detected_language = 'es' AND length({t}) >= 10",
)


@query(
    "P03_parse_dates",
    with_(COMMENTS, RAW)
    + """SELECT comment_id, strftime(try_cast(published_at AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS ts
FROM raw WHERE try_cast(published_at AS TIMESTAMP) IS NOT NULL""",
)
def parse_dates(spark, sf):
    raw = views.raw_comments(spark, sf, labelled=False, text=False).withColumn("ts", filters.parsed("published_at"))
    return raw.filter("ts IS NOT NULL").select(
        "comment_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts")
    )


@query(
    "P04_year_range",
    with_(COMMENTS, RAW)
    + """SELECT comment_id, CAST(year(try_cast(published_at AS TIMESTAMP)) AS INTEGER) AS year
FROM raw WHERE year(try_cast(published_at AS TIMESTAMP)) BETWEEN 2005 AND 2025""",
)
def year_range(spark, sf):
    raw = views.raw_comments(spark, sf, labelled=False, text=False).withColumn("ts", filters.parsed("published_at"))
    return raw.filter(filters.year_between(F.col("ts"))).select("comment_id", F.year("ts").alias("year"))


for _name, _words in {
    "P05_keyword_filter_basic": vocab.GEO_KEYWORDS_BASIC,
    "P05_keyword_filter_enhanced": vocab.GEO_KEYWORDS,
    "P05_spanish_keywords": vocab.ES_KEYWORDS,
    "P05_spanish_identity": vocab.ES_IDENTITY,
    "P05_spanish_religious": vocab.ES_RELIGIOUS,
}.items():
    register(
        _name,
        lambda c, w=_words: c.filter(contains_any(comment(), w)).select("comment_id"),
        f"SELECT comment_id FROM comments WHERE {sql_has(t, _words)}",
    )

register(
    "P06_keyword_filter_bounded",
    lambda c: c.filter(culture.mentions_any(comment())).select("comment_id"),
    f"SELECT comment_id FROM comments WHERE {sql_has_word(t, culture.ALL_BASIC)}",
)
for _name, _words, _raw in [
    ("P07_location_filter_basic", vocab.LOCATIONS_BASIC, [vocab.CITY_SUFFIX_PATTERN]),
    ("P07_location_filter_enhanced", vocab.LOCATIONS_ENHANCED, []),
    ("P07_location_filter_spanish", vocab.ES_LOCATIONS, []),
]:
    register(
        _name,
        lambda c, w=_words, r=_raw: c.filter(contains_word(comment(), w, r)).select("comment_id"),
        f"SELECT comment_id FROM comments WHERE {sql_has_word(t, _words, _raw)}",
    )
register(
    "P08_flag_filter",
    lambda c: c.filter(geo.has_flag(comment())).select("comment_id"),
    f"SELECT comment_id FROM comments WHERE regexp_matches({t}, '{emoji.FLAG}')",
)

_SPAM_BY_YEAR_SQL = " OR ".join(
    f"(year(published_at) = {y} AND {sql_has(t, w)})" for y, w in vocab.SPAM_BY_YEAR.items()
)
_TOKENS = f"regexp_extract_all(lower({t}), '[{WORD}]+|[{SPACE}]+|[^{WORD}{SPACE}]')"
register(
    "P09_spam_rule_flags",
    lambda c: c.select(
        "comment_id",
        spam.spam_word(comment(), F.year("published_at")).alias("spam_word"),
        spam.letter_run(comment()).alias("letter_run"),
        spam.repeated_word(comment()).alias("repeated_word"),
    ),
    f"""SELECT comment_id, ({sql_has(t, vocab.SPAM_COMMON)} OR {_SPAM_BY_YEAR_SQL}) AS spam_word,
  {sql_runs(f'lower({t})', 4)} > 0 AS letter_run,
  len(list_filter(list_zip({_TOKENS}, {_TOKENS}[2:], {_TOKENS}[3:]), lambda z: z[1] = z[3]
    AND regexp_matches(z[1], '^[{WORD}]') AND regexp_matches(z[2], '^[{SPACE}]'))) > 0 AS repeated_word
FROM comments""",
)


_NEXT = """len(list_filter(range(1, len(p) - 1), lambda j: len(b[j + 1]) < len(p[j + 1])
  AND CASE WHEN b[j + 1] <> '' THEN b[j + 1] WHEN len(p[j + 1]) > 1 THEN right(p[j + 1], 1) ELSE '' END <> ''
  AND NOT contains(CASE WHEN b[j + 1] <> '' THEN b[j + 1] ELSE right(p[j + 1], 1) END, chr(10))
  AND suffix(p[j], CASE WHEN b[j + 1] <> '' THEN b[j + 1] ELSE right(p[j + 1], 1) END))) > 0"""
_RUNS = """len(list_distinct(p)) < len(p) AND len(list_filter(range(2, (len(p) - 1) // 2 + 1), lambda m:
  len(list_filter(range(1, len(p) - 2 * m + 1), lambda a: len(b[a + m]) < len(p[a + m]) AND NOT contains(b[a + m], chr(10))
    AND suffix(p[a], b[a + m]) AND p[a + 1 : a + m - 1] = p[a + m + 1 : a + 2 * m - 1]
    AND NOT contains(array_to_string(p[a + 1 : a + m - 1], '.'), chr(10)))) > 0)) > 0"""
SENTENCES = f"""pieces AS MATERIALIZED (SELECT *, list_transform(p, lambda x: {sub('x', f'^[{SPACE}]+')}) AS b
  FROM (SELECT *, string_split(lower({t}), '.') AS p FROM comments)),
sentences AS MATERIALIZED (SELECT *, ({_NEXT}) OR ({_RUNS}) AS repeated_sentence FROM pieces)"""


@query(
    "P09_rule_spam_filter",
    with_(COMMENTS, SENTENCES)
    + f"""SELECT comment_id, lower({t}) AS cleaned FROM sentences WHERE NOT repeated_sentence
  AND length({sub(t, f'^[{SPACE}]+|[{SPACE}]+$')}) >= 3 AND NOT ({sql_has(t, vocab.SPAM_COMMON)} OR {_SPAM_BY_YEAR_SQL})
  AND {sql_runs(f'lower({t})', 4)} = 0 AND len(list_filter(list_zip({_TOKENS}, {_TOKENS}[2:], {_TOKENS}[3:]),
    lambda z: z[1] = z[3] AND regexp_matches(z[1], '^[{WORD}]') AND regexp_matches(z[2], '^[{SPACE}]'))) = 0""",
)
def rule_spam_filter(spark, sf):
    kept = spam.rule_filter(views.comments(spark, sf, labelled=False), year=F.year("published_at"))
    return kept.select("comment_id", "cleaned")


@query("P09_repeated_sentence", with_(COMMENTS, SENTENCES) + "SELECT comment_id, repeated_sentence FROM sentences")
def repeated_sentence(spark, sf):
    c = views.comments(spark, sf, labelled=False)
    return c.select("comment_id", spam.repeated_sentence(F.lower(t)).alias("repeated_sentence"))


register(
    "P10_one_line",
    lambda c: c.select("comment_id", T.one_line(comment()).alias("line")),
    f"SELECT comment_id, {sub(t, chr(92) + 'r|' + chr(92) + 'n', ' ')} AS line FROM comments",
)


def sql_language(text: str) -> str:
    """Subquery giving comment_id, language, language_score for ``comments``."""
    langs = sorted(vocab.LANGUAGE_WORDS)
    n = ", ".join(
        f"len(list_filter(toks, lambda w: list_contains({sql_array(vocab.LANGUAGE_WORDS[g])}, w))) AS v_{g}"
        for g in langs
    )
    top = "greatest(" + ", ".join(f"v_{g}" for g in langs) + ")"
    pick = " ".join(f"WHEN v_{g} = {top} THEN '{g}'" for g in langs)
    total = " + ".join(f"v_{g}" for g in langs)
    known = f"n_chars >= 10 AND {top} > 0"
    bare = sql_spaces(sub(text, T.URL))
    return f"""bare AS (SELECT *, {bare} AS b FROM comments),
toks AS (SELECT * EXCLUDE (b), length(b) AS n_chars, regexp_extract_all(lower(b), '[{WORD}]+') AS toks FROM bare),
counted AS (SELECT * EXCLUDE (toks), {n} FROM toks),
lang AS (SELECT *, CASE WHEN {known} THEN CASE {pick} END ELSE 'und' END AS language,
  CASE WHEN {known} THEN ({top}) * 1.0::DOUBLE / ({total}) ELSE 0.0 END AS language_score FROM counted)"""


LANGUAGE = sql_language(t)

#: The trigram model learns from four fifths of the comments; the others show how well it does.
HELD_OUT = "comment_id % 5 = 0"
TRIGRAMS = f"""bare AS (SELECT comment_id, detected_language, {sub(t, T.URL)} AS b FROM comments),
plain AS MATERIALIZED (SELECT comment_id, detected_language, length({sql_spaces('b')}) AS n_chars,
  trim(regexp_replace(lower(b), '[^\\p{{L}}]+', ' ', 'g')) AS n FROM bare),
doc_words AS MATERIALIZED (SELECT comment_id, detected_language, w, count(*) AS c FROM (
  SELECT comment_id, detected_language, unnest(string_split(n, ' ')) AS w FROM plain) WHERE w <> '' GROUP BY ALL),
grams AS MATERIALIZED (SELECT w, unnest(list_transform(range(1, length(w) + 1),
  lambda i: (unicode(p[i]) * {languages.FACTORS[0]} + unicode(p[i + 1]) * {languages.FACTORS[1]} + unicode(p[i + 2])) % {languages.BUCKETS})) AS g
  FROM (SELECT w, string_split(' ' || w || ' ', '') AS p FROM (SELECT DISTINCT w FROM doc_words))),
fitted AS (SELECT detected_language AS l, g, sum(c) AS n FROM (
  SELECT detected_language, w, sum(c) AS c FROM doc_words WHERE NOT {HELD_OUT} AND detected_language IS NOT NULL GROUP BY ALL) JOIN grams USING (w) GROUP BY ALL),
weights AS MATERIALIZED (SELECT a.l, b.g, ln((coalesce(n, 0) + 1) * 1.0::DOUBLE / (a.total + {languages.BUCKETS})) AS x
  FROM (SELECT l, sum(n) AS total FROM fitted GROUP BY l) a CROSS JOIN (SELECT unnest(range(0, {languages.BUCKETS})) AS g) b
  LEFT JOIN fitted f ON f.l = a.l AND f.g = b.g),
word_scores AS MATERIALIZED (SELECT w, l, sum(x) AS x FROM grams JOIN weights USING (g) GROUP BY ALL),
doc_scores AS (SELECT comment_id, l, sum(c * x) AS x FROM doc_words JOIN word_scores USING (w) GROUP BY ALL),
best AS (SELECT comment_id, min_by(l, (-x, l)) AS l, max(x) AS top FROM doc_scores GROUP BY 1),
shares AS (SELECT comment_id, 1 / sum(exp(x - top)) AS share FROM doc_scores JOIN best USING (comment_id) GROUP BY 1),
lang AS (SELECT p.comment_id, p.detected_language, CASE WHEN n_chars >= 10 AND n <> '' THEN l ELSE 'und' END AS language,
  CASE WHEN n_chars >= 10 AND n <> '' THEN share ELSE 0.0 END AS language_score
  FROM plain p LEFT JOIN best USING (comment_id) LEFT JOIN shares USING (comment_id))"""


def identified(spark, sf):
    c = views.comments(spark, sf, labelled=False)
    return languages.identify(c, languages.fit(c.filter(f"NOT {HELD_OUT}"), t, "detected_language"))


@query(
    "P11_language_filter",
    with_(COMMENTS, TRIGRAMS)
    + """SELECT comment_id, CAST(round(language_score, 6) AS DOUBLE) AS language_score
FROM lang WHERE language = 'en' AND language_score >= 0.8""",
)
def language_filter(spark, sf):
    return language.speaks(identified(spark, sf)).select("comment_id", F.round("language_score", 6).alias("language_score"))


@query(
    "P12_english_spam_removal",
    with_(COMMENTS)
    + """SELECT comment_id, detected_language FROM comments
WHERE coalesce(detected_language, 'unknown') <> 'en' OR (CASE WHEN spam_label = 'spam' THEN 1 ELSE 0 END) = 0""",
)
def english_spam_removal(spark, sf):
    c = views.comments(spark, sf, text=False)
    c = c.withColumn("pred", F.when(F.col("spam_label") == "spam", 1).otherwise(0))
    return filters.english_ham_or_foreign(c, "pred").select("comment_id", "detected_language")


_FLAG_SPELLINGS = ["spam", "True", "0", "YES", "no", "not_spam", "t", "1"]


@query(
    "P13_spam_flag",
    f"""WITH f AS (SELECT doc_id AS comment_id, CASE WHEN doc_id % 9 < 8
  THEN {sql_array(_FLAG_SPELLINGS)}[1 + doc_id % 9] END AS flag FROM documents)
SELECT comment_id, coalesce(lower(flag) IN {sql_list(vocab.TRUE_STRINGS)}, false) AS is_spam FROM f""",
)
def spam_flag(spark, sf):
    docs = views.table(spark, sf, "documents").select(F.col("doc_id").alias("comment_id"))
    spelled = views._pick(_FLAG_SPELLINGS, (F.col("comment_id") % 9).cast("int"))
    return docs.select("comment_id", spam.is_true(spelled).alias("is_spam"))


_EMOTION_CODES = dict(enumerate(vocab.EMOTIONS))


@query(
    "P14_code_labels",
    f"""SELECT vec_id, coalesce({sql_array(vocab.EMOTIONS)}[1 + label], 'unknown') AS emotion,
  CASE WHEN label = 1 THEN 'spam' ELSE 'not_spam' END AS spam_label FROM embeddings""",
)
def code_labels(spark, sf):
    e = views.table(spark, sf, "embeddings")
    return e.select(
        "vec_id",
        filters.mapped(F.col("label"), _EMOTION_CODES, "unknown").alias("emotion"),
        filters.mapped(F.col("label"), {1: "spam"}, "not_spam").alias("spam_label"),
    )


register(
    "P16_removal_report",
    lambda c: filters.removal_report(c, ~(spam.spam_word(comment()) | spam.letter_run(comment()))),
    f"""SELECT count(*) AS total, count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS removed,
  CAST(round(count(*) FILTER (NOT keep) * 100.0::DOUBLE / count(*), 6) AS DOUBLE) AS removed_pct
FROM (SELECT NOT ({sql_has(t, vocab.SPAM_COMMON)} OR {sql_runs(f'lower({t})', 4)} > 0) AS keep FROM comments)""",
)


@query(
    "P17_scoring_input",
    with_(COMMENTS, RAW)
    + """SELECT comment_id, CAST(length(original_comment) AS INTEGER) AS n_chars FROM raw
WHERE coalesce(spam_label, '') <> 'spam' AND original_comment IS NOT NULL AND trim(original_comment) <> ''""",
)
def scoring_input(spark, sf):
    raw = views.raw_comments(spark, sf)
    pred = F.when(F.col("spam_label") == "spam", 1).otherwise(0)
    kept = raw.withColumn("pred", pred).filter((F.col("pred") == 0) & (F.trim(t) != ""))
    return kept.select("comment_id", F.length(t).alias("n_chars"))


# ------------------------------------------------------- F: scalar functions


def function(name, columns, sql: dict, where: str | None = None):
    """Row-level function query; doubles are rounded to six places on both sides."""

    def plan(c):
        c = c.filter(where) if where else c
        return c.select("comment_id", *[e.alias(n) for n, e in columns().items()])

    select = ", ".join(f"{e} AS {n}" for n, e in sql.items())
    register(name, plan, f"SELECT comment_id, {select} FROM comments" + (f" WHERE {where}" if where else ""))


def r6(column):
    return F.round(column.cast("double"), 6)


def sql_r6(expression: str) -> str:
    return f"CAST(round(CAST({expression} AS DOUBLE), 6) AS DOUBLE)"


function("F01_extract_emojis", lambda: {"emojis": emoji.extract(comment())}, {"emojis": sub(t, NOT_EMOJI)})
function("F02_remove_emojis", lambda: {"no_emojis": emoji.remove(comment())}, {"no_emojis": sub(t, EMOJI)})

_NAMES = emoji_names()
_TONE = " OR ".join(f"ch = chr({cp})" for cp in SKIN_TONES)
_NAME_SQL = f"""names(ch, name) AS (VALUES {sql_rows(_NAMES.items())}),
ch AS (SELECT comment_id, unnest(string_split(e, '')) AS ch, generate_subscripts(string_split(e, ''), 1) AS i
  FROM (SELECT comment_id, {sub(t, NOT_EMOJI)} AS e FROM comments) WHERE e <> ''),
tone AS (SELECT *, ({_TONE}) AS is_tone, lag({_TONE}) OVER (PARTITION BY comment_id ORDER BY i) AS after_tone FROM ch),
part AS (SELECT comment_id, i, is_tone AND coalesce(NOT after_tone, false) AS joins,
  coalesce(name, tone.ch) AS name FROM tone LEFT JOIN names ON tone.ch = names.ch),
word AS (SELECT comment_id, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY comment_id ORDER BY i) AS w, i, name
  FROM part),
spelled AS (SELECT comment_id, w, string_agg(name, '_' ORDER BY i) AS name FROM word GROUP BY 1, 2)"""


_TRAVEL = f"""bare AS (SELECT comment_id, string_split({sub(t, T.URL)}, '') AS chars FROM comments WHERE detected_language = 'en'),
letter AS (SELECT comment_id, ch, i, name, ch IN ({', '.join(sql_text(chr(c)) for c in SKIN_TONES)}) AS is_tone,
    regexp_matches(ch, '^{EMOJI}$') AS is_emoji
  FROM (SELECT comment_id, unnest(chars) AS ch, generate_subscripts(chars, 1) AS i FROM bare) LEFT JOIN names USING (ch)),
joined AS (SELECT *, coalesce(is_tone AND lag(is_emoji AND NOT is_tone) OVER places, false) AS joins
  FROM letter WINDOW places AS (PARTITION BY comment_id ORDER BY i)),
spelled_text AS (SELECT comment_id, string_agg(piece, '' ORDER BY i) AS spelled FROM (
  SELECT comment_id, i, CASE WHEN NOT is_emoji THEN ch ELSE CASE WHEN joins THEN '_' ELSE '' END || coalesce(name, ch)
    || CASE WHEN coalesce(lead(joins) OVER (PARTITION BY comment_id ORDER BY i), false) THEN '' ELSE ' ' END END AS piece
  FROM joined) GROUP BY 1)"""
register(
    "P15_travel_filter",
    lambda c: T.travel_texts(
        c.filter(F.col("detected_language") == "en").select("comment_id", t), comment(), "cleaned"
    ).select("comment_id", "cleaned"),
    f"""SELECT comment_id, cleaned FROM (SELECT comment_id, {sql_clean('spelled')} AS cleaned FROM spelled_text)
  WHERE {sql_has_word('cleaned', vocab.TRAVEL)}""",
    f"names(ch, name) AS (VALUES {sql_rows(_NAMES.items())})",
    _TRAVEL,
)


@query(
    "F03_emoji_names",
    with_(COMMENTS, _NAME_SQL)
    + """SELECT comment_id, string_agg(':' || name || ':', '' ORDER BY w) AS colons,
  string_agg(name || ' ', '' ORDER BY w) AS plain FROM spelled GROUP BY 1""",
)
def emoji_name_text(spark, sf):
    c = views.comments(spark, sf, labelled=False).select("comment_id", emoji.extract(comment()).alias("e"))
    return c.filter("e <> ''").select(
        "comment_id", emoji.name_text(F.col("e")).alias("colons"),
        emoji.name_text(F.col("e"), "", " ").alias("plain"),
    )


function(
    "F04_remove_urls",
    lambda: {
        "any_url": T.remove_urls(comment()),
        "dotted": T.remove_urls(comment(), T.URL_DOTTED),
        "http_only": T.remove_urls(comment(), T.URL_HTTP),
    },
    {"any_url": sub(t, T.URL), "dotted": sub(t, T.URL_DOTTED), "http_only": sub(t, T.URL_HTTP)},
)
function(
    "F05_clean_text",
    lambda: {"cleaned": T.clean(comment()), "spaced": T.clean(comment(), " ", T.URL_HTTP)},
    {"cleaned": sql_clean(t), "spaced": sql_clean(t, " ", T.URL_HTTP)},
)
_BARE = sub(sub(t, T.URL), f"@[{WORD}]+")
function(
    "F06_emotion_input",
    lambda: {"prepared": T.emotion_input(comment())},
    {"prepared": sql_strip(f"lower({sub(_BARE, f'[^a-zA-Z0-9{SPACE}]')})")},
)
function("F07_collapse_spaces", lambda: {"line": T.collapse_spaces(comment())}, {"line": sql_spaces(t)})
function(
    "F08_letters_only",
    lambda: {"letters": T.letters_only(comment()), "ascii": T.letters_only(comment(), ascii_only=True)},
    {
        "letters": sub(f"lower({t})", rf"[^\p{{L}}{SPACE}]"),
        "ascii": sub(f"lower({t})", f"[^a-zA-Z{SPACE}]"),
    },
)


def w1():
    return T.words(comment())


def w2():
    return T.words(comment(), 2)


function(
    "F09_words",
    lambda: {"words": F.array_join(w1(), " "), "long_words": F.array_join(w2(), " "), "n_words": F.size(w1())},
    {
        "words": f"array_to_string({sql_words(t)}, ' ')",
        "long_words": f"array_to_string({sql_words(t, 2)}, ' ')",
        "n_words": f"CAST(len({sql_words(t)}) AS INTEGER)",
    },
)


def sql_avg_len(words: str) -> str:
    return f"CASE WHEN len({words}) > 0 THEN length(array_to_string({words}, '')) * 1.0::DOUBLE / len({words}) ELSE 0 END"


def sql_diversity(words: str) -> str:
    return f"CASE WHEN len({words}) > 0 THEN len(list_distinct({words})) * 1.0::DOUBLE / len({words}) ELSE 0 END"


_UPPER = f"CASE WHEN length({t}) > 0 THEN len(regexp_extract_all({t}, '\\p{{Lu}}')) * 1.0::DOUBLE / length({t}) ELSE 0 END"
_RUNS = sql_runs(t, 3)


def feature(name, column, sql):
    """One column of the linguistic features, rounded; the statement sees the word lists w and w2."""
    source = f"(SELECT *, {sql_words(t)} AS w, {sql_words(t, 2)} AS w2 FROM comments)"
    register(
        name,
        lambda c: linguistics.with_features(
            c.withColumn("errors", F.col("comment_id") % 4), grammar_errors="errors"
        ).select("comment_id", r6(F.col(column)).alias("value")),
        f"SELECT comment_id, {sql_r6(sql)} AS value FROM {source}",
    )


feature("F10_average_word_length", "avg_word_length", sql_avg_len("w"))
feature("F11_lexical_diversity", "lexical_diversity", sql_diversity("w"))
function("F12_uppercase_share", lambda: {"upper": r6(T.uppercase_share(comment()))}, {"upper": sql_r6(_UPPER)})
function("F13_repeated_runs", lambda: {"runs": T.repeated_runs(comment())}, {"runs": f"CAST({_RUNS} AS INTEGER)"})
feature(
    "F14_rough_score",
    "rough_language_score",
    f"({sql_avg_len('w')}) * 0.2::DOUBLE + ({sql_diversity('w')}) * 0.4::DOUBLE"
    f" - ({_UPPER}) * 0.2::DOUBLE - ln(1 + {_RUNS}) * 0.2::DOUBLE",
)
register(
    "F15_text_metrics",
    lambda c: linguistics.text_metrics(c).select(
        "comment_id", "word_count", *[r6(F.col(n)).alias(n) for n in ("avg_len", "diversity", "upper")], "runs"
    ),
    f"""SELECT comment_id, CAST(len(w2) AS INTEGER) AS word_count, {sql_r6(sql_avg_len('w2'))} AS avg_len,
  {sql_r6(sql_diversity('w2'))} AS diversity, {sql_r6(f'CASE WHEN len(w2) > 0 THEN {_UPPER} ELSE 0 END')} AS upper,
  CAST(CASE WHEN len(w2) > 0 THEN {_RUNS} ELSE 0 END AS INTEGER) AS runs
FROM (SELECT *, {sql_words(t, 2)} AS w2 FROM comments)""",
)
_NW = f"len(regexp_extract_all({t}, '[{WORD}]+'))"
_FLESCH = (
    f"CASE WHEN {_NW} > 0 THEN 206.835::DOUBLE - {_NW} * 1.0::DOUBLE / greatest(len(regexp_extract_all({t}, '[.!?]+')), 1)"
    f" * 1.015::DOUBLE - len(regexp_extract_all(lower({t}), '[aeiouy]+')) * 1.0::DOUBLE / {_NW} * 84.6::DOUBLE ELSE 0 END"
)
function("F16_flesch", lambda: {"flesch": r6(T.flesch_reading_ease(comment()))}, {"flesch": sql_r6(_FLESCH)})
feature(
    "F17_enhanced_score",
    "enhanced_language_score",
    f"(({_FLESCH}) - 50) / 50 * 0.4::DOUBLE - ln(1 + comment_id % 4) * 0.3::DOUBLE"
    f" + ({sql_diversity('w')}) * 0.15::DOUBLE + (({sql_avg_len('w')}) - 4) / 4 * 0.05::DOUBLE"
    f" - ({_UPPER}) * 0.05::DOUBLE - ln(1 + {_RUNS}) * 0.05::DOUBLE",
)

_FLAGS = f"regexp_extract_all({t}, '{emoji.FLAG}')"
_HAS_FLAG = f"{t} RLIKE '{emoji.FLAG}'"


@query(
    "F18_flags",
    with_(COMMENTS) + f"SELECT comment_id, array_to_string({_FLAGS}, ' ') AS flags FROM comments WHERE len({_FLAGS}) > 0",
)
def flag_list(spark, sf):
    c = views.comments(spark, sf, labelled=False).filter(geo.has_flag(comment()))
    return c.select("comment_id", F.array_join(emoji.flags(comment()), " ").alias("flags"))


_FLAG_CASE = " ".join(f"WHEN {sql_text(f)} THEN {sql_text(n)}" for f, n in vocab.FLAG_NAMES.items())


@query(
    "F19_flag_countries",
    with_(COMMENTS)
    + f"""SELECT comment_id, array_to_string(list_transform({_FLAGS},
  lambda f: CASE f {_FLAG_CASE} ELSE 'Unknown_' || f END), ';') AS countries FROM comments WHERE len({_FLAGS}) > 0""",
)
def flag_countries(spark, sf):
    c = views.comments(spark, sf, labelled=False).filter(geo.has_flag(comment()))
    return c.select("comment_id", F.array_join(emoji.flag_names(emoji.flags(comment())), ";").alias("countries"))


_LOW = f"lower({t})"


def sql_hits(words, text: str = _LOW) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {sql_text(w)}) AS INTEGER)" for w in words) + ")"


_KEYWORD_CONF = (
    f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + {sql_hits(vocab.GEO_KEYWORDS)} * 0.1::DOUBLE"
    f" + CASE WHEN contains({_LOW}, 'from') THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN length({t}) < 10 THEN 0.2::DOUBLE ELSE 0 END))"
)
function(
    "F23_matched_keywords",
    lambda: {"keywords": geo.matched_keywords(comment())},
    {"keywords": f"array_to_string(list_filter({sql_array(vocab.GEO_KEYWORDS)}, lambda k: contains({_LOW}, k)), ';')"},
)
function("F24_keyword_confidence", lambda: {"confidence": r6(geo.keyword_confidence(comment()))}, {"confidence": sql_r6(_KEYWORD_CONF)})


@query(
    "F25_flag_confidence",
    with_(COMMENTS)
    + f"SELECT comment_id, 0.9::DOUBLE AS confidence FROM comments WHERE regexp_matches({t}, '{emoji.FLAG}')",
)
def flag_confidence(spark, sf):
    c = views.comments(spark, sf, labelled=False).filter(geo.has_flag(comment()))
    return c.select("comment_id", F.lit(0.9).alias("confidence"))


# Separators are doubled so that neighbouring names do not share one.
_DOUBLED = f"regexp_replace({t}, '([^{WORD}])', '\\1\\1', 'g')"
_PLACES_RE = "|".join(escape(p.replace(" ", "  ")) for p in vocab.LOCATIONS_ENHANCED)
SQL_LOCATIONS = (
    f"list_transform(regexp_extract_all({_DOUBLED}, '(?i)(^|[^{WORD}])({_PLACES_RE})($|[^{WORD}])', 2), "
    "lambda p: replace(p, '  ', ' '))"
)
SQL_LOCATION_CONF = (
    "CASE WHEN len(places) = 0 THEN 0.0 ELSE least(1.0, 0.6 + CASE WHEN len(places) > 1 THEN 0.1 ELSE 0 END"
    f" + CASE WHEN list_has_any(places, {sql_array(vocab.MAJOR_LOCATIONS)}) THEN 0.2 ELSE 0 END) END"
)


@query(
    "F26_locations",
    with_(COMMENTS)
    + f"""SELECT comment_id, array_to_string(places, ';') AS locations, {sql_r6(SQL_LOCATION_CONF)} AS confidence
FROM (SELECT comment_id, {SQL_LOCATIONS} AS places FROM comments)""",
)
def location_list(spark, sf):
    found = views.comments(spark, sf, labelled=False).select("comment_id", geo.locations(comment()).alias("places"))
    return found.select(
        "comment_id", F.array_join("places", ";").alias("locations"),
        r6(geo.location_confidence(F.col("places"))).alias("confidence"),
    )


SQL_FIRST = {
    cat: "CASE " + " ".join(f"WHEN {sql_has_word(_LOW, [k])} THEN {sql_text(k)}" for k in words) + " END"
    for cat, words in vocab.CULTURAL_BASIC.items()
}
function(
    "F27_first_keyword",
    lambda: {culture.short(c): culture.first_keyword(comment(), w) for c, w in vocab.CULTURAL_BASIC.items()},
    {culture.short(c): SQL_FIRST[c] for c in vocab.CULTURAL_BASIC},
)
function(
    "F33_date_parts",
    lambda: {
        "unix_seconds": F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col("published_at")),
        "year": F.year("published_at"),
        "month": F.month("published_at"),
        "year_month": F.date_format("published_at", "yyyy-MM"),
    },
    {
        "unix_seconds": "CAST(epoch(published_at) AS BIGINT)",
        "year": "CAST(year(published_at) AS INTEGER)",
        "month": "CAST(month(published_at) AS INTEGER)",
        "year_month": "strftime(published_at, '%Y-%m')",
    },
)
function(
    "F34_truncate",
    lambda: {"shown": T.truncate(comment()), "model_view": T.truncate(comment(), 512, "")},
    {
        "shown": f"CASE WHEN length({t}) > 500 THEN {t}[1:500] || '...' ELSE coalesce({t}, '') END",
        "model_view": f"{t}[1:512]",
    },
)


@query(
    "F35_model_input",
    with_(COMMENTS, RAW, _NAME_SQL)
    + f"""SELECT raw.comment_id, emotion_label, coalesce({sub(t, EMOJI)}, '') || ' ' || coalesce(names, '') AS model_text
FROM raw LEFT JOIN (SELECT comment_id, string_agg(':' || name || ':', '' ORDER BY w) AS names FROM spelled GROUP BY 1) n
  ON raw.comment_id = n.comment_id AND raw.original_comment IS NOT NULL
WHERE emotion_label IS NOT NULL AND emotion_label <> '' AND
  trim(coalesce({sub(t, EMOJI)}, '') || ' ' || coalesce(names, '')) <> ''""",
)
def model_input(spark, sf):
    raw = views.raw_comments(spark, sf).filter("emotion_label IS NOT NULL AND emotion_label <> ''")
    split = raw.withColumns({"bare": emoji.remove(comment()), "emojis": emoji.extract(comment())})
    named = split.withColumn("emoji_text", emoji.name_text(F.col("emojis")))
    joined = compute_once(named, {"model_text": T.model_input(F.col("bare"), F.col("emoji_text"))})
    return joined.select("comment_id", "emotion_label", "model_text").filter(F.trim("model_text") != "")


function(
    "F36_strip_skin_tones",
    lambda: {"emojis": emoji.strip_tones(emoji.extract(comment()))},
    {"emojis": sub(sub(t, NOT_EMOJI), emoji.TONES)},
)
function(
    "F37_topic_flag",
    lambda: {
        "tourism": T.topic_flag(comment()),
        "review": T.topic_flag(comment(), tuple(vocab.TOURISM), miss=-1),
    },
    {
        "tourism": f"CASE WHEN {sql_has(t, vocab.TOURISM_EXTENDED)} THEN 1 ELSE 0 END",
        "review": f"CASE WHEN {sql_has(t, vocab.TOURISM)} THEN 1 ELSE -1 END",
    },
)
SQL_NON_ALPHA = f"CASE WHEN length({t}) > 0 THEN length({sub(t, f'[a-zA-Z{SPACE}]')}) * 1.0::DOUBLE / length({t}) ELSE 0 END"
function(
    "F38_non_alphabetic_share",
    lambda: {"share": r6(T.non_alphabetic_share(comment())), "mostly": T.non_alphabetic_share(comment()) > 0.7},
    {"share": sql_r6(SQL_NON_ALPHA), "mostly": f"({SQL_NON_ALPHA}) > 0.7"},
)


@query(
    "M11_language_identification",
    with_(COMMENTS, TRIGRAMS)
    + "SELECT comment_id, language, CAST(round(language_score, 6) AS DOUBLE) AS language_score FROM lang",
)
def language_identification(spark, sf):
    return identified(spark, sf).select("comment_id", "language", F.round("language_score", 6).alias("language_score"))


@query(
    "M11_language_accuracy",
    with_(COMMENTS, TRIGRAMS)
    + f"""SELECT {HELD_OUT} AS held_out, detected_language, language, count(*) AS n FROM lang GROUP BY 1, 2, 3""",
)
def language_accuracy(spark, sf):
    """Known against found languages, for comments that the model has learnt from and for those held out."""
    held = F.expr(HELD_OUT).alias("held_out")
    return identified(spark, sf).groupBy(held, "detected_language", "language").agg(F.count("*").alias("n"))


@query(
    "M11_language_by_common_words",
    with_(COMMENTS, LANGUAGE)
    + "SELECT comment_id, language, CAST(round(language_score, 6) AS DOUBLE) AS language_score FROM lang",
)
def language_by_common_words(spark, sf):
    found = language.detect(views.comments(spark, sf, labelled=False))
    return found.select("comment_id", "language", F.round("language_score", 6).alias("language_score"))
