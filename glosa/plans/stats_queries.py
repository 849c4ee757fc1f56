"""Label statistics, frequencies, samples, sets, quality."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glosa.functions import text as T
from glosa.functions.emoji import TONES
from glosa.operators import evaluation, filters, joins, quality, sampling, statistics
from glosa.plans import views
from glosa.plans.registry import query, sql_list, sql_rows
from glosa.plans.text_queries import (
    NOT_EMOJI, SQL_NON_ALPHA, SPACE, sql_clean, sql_has, sql_r6, sql_runs, sub, t,
)
from glosa.plans.views import ANNOTATIONS, COMMENTS, RAW, SCORES, with_
from glosa.session import written
from glosa.vocab import words as vocab

EMOTIONS = vocab.EMOTIONS
EMOTION_SCORES = {e: f"emotion_{e}" for e in EMOTIONS}


def plain(spark, sf):
    """Comments without text and spam label, with their year."""
    c = views.comments(spark, sf, labelled=False, text=False)
    return c.withColumn("year", F.year("published_at"))


DATED = "dated AS (SELECT *, CAST(year(published_at) AS INTEGER) AS year FROM comments)"
_GRID = f"grid(emotion_label) AS (VALUES {sql_rows((e,) for e in EMOTIONS)})"

# -------------------------------------------------------------- label statistics

_TOP_SCORE = "greatest(" + ", ".join(EMOTION_SCORES.values()) + ")"
SQL_ARGMAX = "CASE " + " ".join(f"WHEN {c} = {_TOP_SCORE} THEN '{e}'" for e, c in EMOTION_SCORES.items()) + " END"


@query(
    "A03_label_distribution",
    with_(SCORES, _GRID, f"s AS (SELECT video, coalesce(label_mb, label_eden, {SQL_ARGMAX}) AS emotion_label FROM scores)")
    + f"""SELECT v.video, g.emotion_label, count(s.video) AS n,
  {sql_r6('count(s.video) * 100.0 / sum(count(s.video)) OVER (PARTITION BY v.video)')} AS pct
FROM (SELECT DISTINCT video FROM s) v CROSS JOIN grid g LEFT JOIN s ON s.video = v.video AND s.emotion_label = g.emotion_label
GROUP BY 1, 2""",
)
def label_distribution(spark, sf):
    s = views.scores(spark, sf)
    label = F.coalesce("label_mb", "label_eden", evaluation.argmax_label(EMOTION_SCORES))
    return statistics.label_distribution(s.select("video", label.alias("emotion_label")), "video", "emotion_label", EMOTIONS)


@query("J06_label_preference", with_(SCORES) + "SELECT comment_id, coalesce(label_mb, label_eden) AS label FROM scores")
def label_preference(spark, sf):
    return views.scores(spark, sf).select("comment_id", F.coalesce("label_mb", "label_eden").alias("label"))


@query("F32_argmax_label", with_(SCORES) + f"SELECT comment_id, {SQL_ARGMAX} AS label FROM scores")
def argmax_label(spark, sf):
    return views.scores(spark, sf).select("comment_id", evaluation.argmax_label(EMOTION_SCORES).alias("label"))


@query(
    "A23_emotion_by_year",
    with_(COMMENTS, DATED)
    + "SELECT year, "
    + ", ".join(f"{sql_r6(f'''count(*) FILTER (emotion_label = '{e}') * 100.0 / count(emotion_label)''')} AS {e}" for e in EMOTIONS)
    + " FROM dated GROUP BY 1",
)
def emotion_by_year(spark, sf):
    return statistics.emotion_by_year(plain(spark, sf), EMOTIONS)


_TREND = ["joy", "sadness", "surprise"]


@query(
    "A24_emotion_share_trend",
    with_(COMMENTS, DATED)
    + " UNION ALL ".join(
        f"SELECT video, year, count(*) AS total, '{e}' AS emotion, count(*) FILTER (emotion_label = '{e}') AS n, "
        f"{sql_r6(f'''count(*) FILTER (emotion_label = '{e}') * 100.0 / count(*)''')} AS pct FROM dated GROUP BY 1, 2"
        for e in _TREND
    ),
)
def emotion_share_trend(spark, sf):
    return statistics.share_trend(plain(spark, sf), "video", _TREND)


@query(
    "A25_volume_by_year",
    with_(COMMENTS, DATED)
    + "SELECT year, count(*) FILTER (video = 'video_a') AS video_a, count(*) FILTER (video = 'video_b') AS video_b FROM dated GROUP BY 1",
)
def volume_by_year(spark, sf):
    return statistics.volume_by_year(plain(spark, sf), "video", ["video_a", "video_b"])


@query(
    "A26_negative_rate_by_spam",
    with_(COMMENTS)
    + f"""SELECT video, spam_label, count(*) AS total, count(*) FILTER (emotion_label = 'fear') AS fear,
  count(*) FILTER (emotion_label = 'disgust') AS disgust,
  {sql_r6("count(*) FILTER (emotion_label = 'fear') * 100.0 / count(*)")} AS fear_pct,
  {sql_r6("count(*) FILTER (emotion_label = 'disgust') * 100.0 / count(*)")} AS disgust_pct
FROM comments WHERE spam_label IS NOT NULL GROUP BY 1, 2""",
)
def negative_rate_by_spam(spark, sf):
    c = views.comments(spark, sf, text=False).filter("spam_label IS NOT NULL")
    counts = c.groupBy("video", "spam_label").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("emotion_label") == e).alias(e) for e in ("fear", "disgust")]
    )
    return counts.select("*", *[statistics.share(F.col(e), F.col("total")).alias(f"{e}_pct") for e in ("fear", "disgust")])


@query(
    "A27_emoji_frequency",
    with_(COMMENTS, DATED)
    + f"""SELECT year, emoji, count(*) AS n FROM (SELECT year,
  unnest(string_split({sub(sub(t, NOT_EMOJI), TONES)}, '')) AS emoji FROM dated) WHERE emoji <> '' GROUP BY 1, 2""",
)
def emoji_frequency(spark, sf):
    c = views.comments(spark, sf, labelled=False).withColumn("year", F.year("published_at"))
    return statistics.emoji_counts(c, t, ["year"])


@query(
    "L01_top_emojis",
    with_(COMMENTS)
    + f"""SELECT emoji, count(*) AS n FROM (SELECT unnest(string_split({sub(sub(t, NOT_EMOJI), TONES)}, '')) AS emoji FROM comments)
WHERE emoji <> '' GROUP BY 1 ORDER BY n DESC, emoji LIMIT 15""",
)
def top_emojis(spark, sf):
    counts = statistics.emoji_counts(views.comments(spark, sf, labelled=False), t)
    return statistics.top(counts, 15, "emoji")


_ASCII = sub(f"lower({t})", f"[^a-zA-Z{SPACE}]")


@query(
    "A28_label_word_frequency",
    with_(COMMENTS)
    + f"""SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex({_ASCII}, '[{SPACE}]+')) AS word FROM comments
  WHERE emotion_label = 'fear') WHERE length(word) > 2 AND word NOT IN {sql_list(vocab.STOP_EN)}
GROUP BY 1 ORDER BY n DESC, word LIMIT 10""",
)
def label_word_frequency(spark, sf):
    fear = views.comments(spark, sf, labelled=False).filter("emotion_label = 'fear'")
    counts = statistics.word_counts(fear, T.letters_only(F.col(t), ascii_only=True), vocab.STOP_EN, 3)
    return statistics.top(counts, 10, "word")


@query(
    "A28_topic_word_frequency",
    with_(COMMENTS)
    + f"""SELECT word, count(*) AS n FROM (SELECT unnest(string_split({sql_clean(t, ' ', T.URL_HTTP)}, ' ')) AS word FROM comments
  WHERE {sql_has(t, vocab.TOURISM_EXTENDED)}) WHERE length(word) >= 3 AND word NOT IN {sql_list(vocab.STOP_MIXED)}
GROUP BY 1 ORDER BY n DESC, word LIMIT 15""",
)
def topic_word_frequency(spark, sf):
    topic = views.comments(spark, sf, labelled=False).filter(T.topic_flag(F.col(t)) == 1)
    counts = statistics.word_counts(topic, T.clean(F.col(t), " ", T.URL_HTTP), vocab.STOP_MIXED, 3)
    return statistics.top(counts, 15, "word")


@query(
    "A29_topic_share_by_year",
    with_(COMMENTS, DATED)
    + f"""SELECT year, count(*) FILTER ({sql_has(t, vocab.TOURISM_EXTENDED)}) AS topic_rows, count(*) AS total,
  {sql_r6(f'count(*) FILTER ({sql_has(t, vocab.TOURISM_EXTENDED)}) * 100.0 / count(*)')} AS pct FROM dated GROUP BY 1""",
)
def topic_share_by_year(spark, sf):
    c = views.comments(spark, sf, labelled=False)
    flagged = c.select(F.year("published_at").alias("year"), T.topic_flag(F.col(t)).cast("long").alias("hit"))
    counts = flagged.groupBy("year").agg(F.sum("hit").alias("topic_rows"), F.count("*").alias("total"))
    return counts.withColumn("pct", statistics.share(F.col("topic_rows"), F.col("total")))


@query(
    "A31_mean_length",
    with_(COMMENTS)
    + f"SELECT video, count(*) AS n, CAST(sum(length({t})) AS BIGINT) AS chars, {sql_r6(f'avg(length({t}))')} AS mean_chars FROM comments GROUP BY 1",
)
def mean_length(spark, sf):
    c = views.comments(spark, sf, labelled=False)
    return c.groupBy("video").agg(
        F.count("*").alias("n"), F.sum(F.length(t)).alias("chars"), F.round(F.avg(F.length(t)), 6).alias("mean_chars")
    )


@query(
    "A32_class_balance",
    f"SELECT toxic, count(*) AS n, {sql_r6('count(*) * 1.0 / sum(count(*)) OVER ()')} AS share FROM labels GROUP BY 1",
)
def class_balance(spark, sf):
    counts = statistics.value_counts(views.table(spark, sf, "labels"), "toxic")
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))), 6))


@query(
    "W05_share_within_group",
    with_(COMMENTS)
    + f"""SELECT video, detected_language, count(*) AS n,
  {sql_r6('count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY video)')} AS pct FROM comments GROUP BY 1, 2""",
)
def share_within_group(spark, sf):
    counts = statistics.value_counts(views.comments(spark, sf, labelled=False, text=False), "video", "detected_language")
    return counts.withColumn("pct", statistics.share(F.col("n"), F.sum("n").over(W.partitionBy("video"))))


# -------------------------------------------------------------- agreement, evaluation

_PAIRS = """pairs AS MATERIALIZED (SELECT a.label AS truth, b.label AS predicted, count(*) AS n
  FROM ann_a a JOIN ann_b b ON a.comment_id = b.comment_id WHERE a.label <> '' AND b.label <> '' GROUP BY 1, 2)"""


def annotator_pairs(spark, sf):
    return joins.aligned_annotations(views.annotations(spark, sf, "a"), views.annotations(spark, sf, "b"))


@query(
    "J01_annotator_alignment",
    with_(ANNOTATIONS)
    + """SELECT a.comment_id, a.label AS label_a, b.label AS label_b FROM ann_a a JOIN ann_b b ON a.comment_id = b.comment_id
WHERE a.label <> '' AND b.label <> ''""",
)
def annotator_alignment(spark, sf):
    return annotator_pairs(spark, sf)


@query(
    "M16_cohen_kappa",
    with_(ANNOTATIONS, _PAIRS)
    + f"""SELECT CAST(total AS BIGINT) AS pairs, {sql_r6('po')} AS agreement, {sql_r6('pe')} AS chance,
  {sql_r6('(po - pe) / (1 - pe)')} AS kappa FROM (
  SELECT (SELECT sum(n) FROM pairs) AS total, (SELECT sum(n) FILTER (truth = predicted) * 1.0::DOUBLE / sum(n) FROM pairs) AS po,
    (SELECT sum(x.n * y.n) * 1.0::DOUBLE FROM (SELECT truth, sum(n) AS n FROM pairs GROUP BY 1) x
      JOIN (SELECT predicted, sum(n) AS n FROM pairs GROUP BY 1) y ON truth = predicted)
    / ((SELECT sum(n) FROM pairs) * (SELECT sum(n) FROM pairs)) AS pe)""",
)
def cohen_kappa(spark, sf):
    return evaluation.cohen_kappa(evaluation.pair_counts(annotator_pairs(spark, sf), "label_a", "label_b"))


_MODEL_PAIRS = f"""judged AS MATERIALIZED (SELECT *, coalesce(label_mb, label_eden) AS truth, {SQL_ARGMAX} AS predicted FROM scores),
pairs AS MATERIALIZED (SELECT truth, predicted, count(*) AS n FROM judged
  WHERE truth IS NOT NULL AND predicted IS NOT NULL GROUP BY 1, 2)"""


def model_pairs(spark, sf):
    s = views.scores(spark, sf)
    judged = s.select(
        F.coalesce("label_mb", "label_eden").alias("label"), evaluation.argmax_label(EMOTION_SCORES).alias("guess")
    )
    return evaluation.pair_counts(judged, "label", "guess")


_CLASSES = f"classes(label) AS (VALUES {sql_rows((e,) for e in EMOTIONS)})"


@query(
    "M13_confusion_matrix",
    with_(SCORES, _MODEL_PAIRS, _CLASSES)
    + f"""SELECT a.label AS truth, b.label AS predicted, coalesce(n, 0) AS n,
  CASE WHEN sum(coalesce(n, 0)) OVER (PARTITION BY a.label) > 0 THEN
    {sql_r6('coalesce(n, 0) * 1.0 / sum(coalesce(n, 0)) OVER (PARTITION BY a.label)')} END AS share
FROM classes a CROSS JOIN classes b LEFT JOIN pairs ON truth = a.label AND predicted = b.label""",
)
def confusion_matrix(spark, sf):
    return evaluation.confusion_matrix(model_pairs(spark, sf), EMOTIONS)


def sql_report(pairs: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    return f"""counts AS (SELECT {g}label, sum(tp) AS tp, sum(support) AS support, sum(chosen) AS chosen FROM (
    SELECT {g}truth AS label, CASE WHEN truth = predicted THEN n ELSE 0 END AS tp, n AS support, 0 AS chosen FROM {pairs}
    UNION ALL SELECT {g}predicted, 0, 0, n FROM {pairs}) WHERE label IN {sql_list(EMOTIONS)} GROUP BY ALL),
report AS (SELECT {g}label, CASE WHEN chosen > 0 THEN {sql_r6('tp * 1.0 / chosen')} ELSE 0.0 END AS precision,
  CASE WHEN support > 0 THEN {sql_r6('tp * 1.0 / support')} ELSE 0.0 END AS recall,
  CASE WHEN chosen + support > 0 THEN {sql_r6('tp * 2.0 / (chosen + support)')} ELSE 0.0 END AS f1,
  CAST(support AS BIGINT) AS support FROM counts)"""


@query("M14_classification_report", with_(SCORES, _MODEL_PAIRS, sql_report("pairs")) + "SELECT * FROM report")
def classification_report(spark, sf):
    return evaluation.class_report(model_pairs(spark, sf), EMOTIONS)


@query(
    "M14_accuracy",
    with_(SCORES, _MODEL_PAIRS, sql_report("pairs"))
    + f"""SELECT CAST(sum(n) AS BIGINT) AS rows, {sql_r6('sum(n) FILTER (truth = predicted) * 1.0 / sum(n)')} AS accuracy,
  (SELECT {sql_r6('sum(f1) / 7')} FROM report) AS macro_f1, (SELECT {sql_r6('sum(f1 * support) / sum(support)')} FROM report) AS weighted_f1
FROM pairs""",
)
def accuracy(spark, sf):
    return evaluation.accuracy_report(model_pairs(spark, sf), EMOTIONS)


_PR = ["fear", "disgust", "anger"]


@query(
    "M15_precision_recall",
    with_(
        SCORES, _MODEL_PAIRS,
        "pts AS (" + " UNION ALL ".join(
            f"SELECT '{e}' AS label, emotion_{e} AS threshold, sum(CASE WHEN truth = '{e}' THEN 1 ELSE 0 END) AS hits, count(*) AS n"
            f" FROM judged WHERE truth IS NOT NULL AND emotion_{e} IS NOT NULL GROUP BY 2" for e in _PR
        ) + ")",
        """run AS (SELECT label, threshold, sum(hits) OVER w AS tp, sum(n) OVER w AS chosen,
  sum(hits) OVER (PARTITION BY label) AS positives FROM pts WINDOW w AS (PARTITION BY label ORDER BY threshold DESC))""",
    )
    + f"""SELECT label, {sql_r6('threshold')} AS threshold, {sql_r6('tp * 1.0 / chosen')} AS precision,
  {sql_r6('tp * 1.0 / positives')} AS recall FROM run""",
)
def precision_recall(spark, sf):
    s = views.scores(spark, sf).withColumn("truth", F.coalesce("label_mb", "label_eden"))
    return evaluation.precision_recall(s, "truth", EMOTION_SCORES, _PR)


_MODELS = f"""models AS MATERIALIZED (SELECT 'second_annotator' AS model, truth, label_eden AS predicted, count(*) AS n FROM judged GROUP BY ALL
  UNION ALL SELECT 'scores', truth, predicted, count(*) FROM judged GROUP BY ALL
  UNION ALL SELECT 'constant', truth, 'joy', count(*) FROM judged GROUP BY ALL),
known AS MATERIALIZED (SELECT * FROM models WHERE truth IS NOT NULL AND predicted IN {sql_list(EMOTIONS)})"""


@query(
    "M17_model_comparison",
    with_(SCORES, _MODEL_PAIRS, _MODELS, sql_report("known", "model"))
    + f"""SELECT k.model, CAST(sum(n) AS BIGINT) AS rows, {sql_r6('coalesce(sum(n) FILTER (truth = predicted), 0) * 1.0 / sum(n)')} AS accuracy,
  any_value(macro_f1) AS macro_f1, any_value(weighted_f1) AS weighted_f1 FROM known k JOIN (
  SELECT model, {sql_r6('sum(f1) / 7')} AS macro_f1, {sql_r6('sum(f1 * support) / sum(support)')} AS weighted_f1 FROM report GROUP BY 1) r
  ON k.model = r.model GROUP BY 1""",
)
def model_comparison(spark, sf):
    s = views.scores(spark, sf)
    judged = s.select(
        F.coalesce("label_mb", "label_eden").alias("truth"),
        F.col("label_eden").alias("second_annotator"),
        evaluation.argmax_label(EMOTION_SCORES).alias("scores"),
        F.lit("joy").alias("constant"),
    )
    return evaluation.compare_models(judged, "truth", ["second_annotator", "scores", "constant"], EMOTIONS)


@query(
    "M18_predictions_by_class",
    with_(SCORES, _MODEL_PAIRS)
    + f"SELECT predicted AS predicted_label, truth AS original_label, comment_id, {sql_r6(_TOP_SCORE)} AS confidence FROM judged WHERE predicted IS NOT NULL",
)
def predictions_by_class(spark, sf):
    """One folder per predicted class, read back."""
    s = views.scores(spark, sf)
    judged = s.select(
        "comment_id",
        F.coalesce("label_mb", "label_eden").alias("original_label"),
        evaluation.argmax_label(EMOTION_SCORES).alias("predicted_label"),
        F.round(F.greatest(*EMOTION_SCORES.values()), 6).alias("confidence"),
    )
    return written(judged.filter("predicted_label IS NOT NULL"), "predictions", ["predicted_label"])


# ---------------------------------------------------------------- top-k, samples, sets


@query(
    "L02_top_years",
    with_(COMMENTS, DATED) + "SELECT year, count(*) AS n FROM dated GROUP BY 1 ORDER BY n DESC, year LIMIT 3",
)
def top_years(spark, sf):
    return statistics.top(statistics.value_counts(plain(spark, sf), "year"), 3, "year")


@query(
    "L03_seeded_sample",
    with_(COMMENTS) + "SELECT comment_id, video FROM comments ORDER BY md5(CAST(comment_id AS VARCHAR)), comment_id LIMIT 500",
)
def seeded_sample(spark, sf):
    return sampling.sample(plain(spark, sf), "comment_id", 500).select("comment_id", "video")


@query(
    "L04_balanced_sample",
    with_(COMMENTS)
    + """SELECT comment_id, spam_label FROM comments WHERE spam_label IS NOT NULL QUALIFY row_number() OVER (
  PARTITION BY spam_label ORDER BY md5(CAST(comment_id AS VARCHAR)), comment_id) <= 100""",
)
def balanced_sample(spark, sf):
    c = views.comments(spark, sf, text=False).filter("spam_label IS NOT NULL").select("comment_id", "spam_label")
    return sampling.balanced_sample(c, "spam_label", "comment_id", 100)


for _share in (0.2, 0.15, 0.1):

    @query(
        f"L05_stratified_split_{int(_share * 100)}",
        with_(COMMENTS)
        + f"""SELECT comment_id, emotion_label, CASE WHEN r <= round(c * {_share}::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM (
  SELECT *, row_number() OVER (PARTITION BY emotion_label ORDER BY md5(CAST(comment_id AS VARCHAR))) AS r,
    count(*) OVER (PARTITION BY emotion_label) AS c FROM comments WHERE emotion_label IS NOT NULL)""",
    )
    def stratified_split(spark, sf, share=_share):
        c = plain(spark, sf).filter("emotion_label IS NOT NULL").select("comment_id", "emotion_label")
        return sampling.stratified_split(c, "emotion_label", "comment_id", share)


@query(
    "L06_label_ids",
    with_(COMMENTS)
    + """SELECT emotion_label, CAST(row_number() OVER (ORDER BY emotion_label) - 1 AS INTEGER) AS label_id
FROM (SELECT DISTINCT emotion_label FROM comments WHERE emotion_label IS NOT NULL)""",
)
def label_ids(spark, sf):
    return sampling.label_ids(plain(spark, sf), "emotion_label")


@query(
    "S16_row_range",
    with_(COMMENTS) + "SELECT comment_id, video FROM comments ORDER BY comment_id LIMIT 300 OFFSET 150",
)
def row_range(spark, sf):
    c = plain(spark, sf).select("comment_id", "video")
    return sampling.row_range(c, "comment_id", 150, 450)


@query("S16_prefix_scan", with_(COMMENTS) + "SELECT comment_id, video FROM comments ORDER BY comment_id LIMIT 100")
def prefix_scan(spark, sf):
    return plain(spark, sf).orderBy("comment_id").limit(100).select("comment_id", "video")


@query(
    "U01_union_by_name",
    with_(ANNOTATIONS)
    + """SELECT comment_id, label, 'a' AS source, CAST(NULL AS BIGINT) AS weight FROM ann_a
UNION ALL SELECT comment_id, label, 'b', comment_id % 3 FROM ann_b""",
)
def union_by_name(spark, sf):
    a = views.annotations(spark, sf, "a").withColumn("source", F.lit("a"))
    b = views.annotations(spark, sf, "b").select(F.lit("b").alias("source"), (F.col("comment_id") % 3).alias("weight"), "label", "comment_id")
    return a.unionByName(b, allowMissingColumns=True)


@query(
    "J02_unused_rows",
    """SELECT doc_id AS comment_id FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels)
ORDER BY doc_id LIMIT 200""",
)
def unused_rows(spark, sf):
    c = plain(spark, sf).select("comment_id", "detected_language")
    used = views.table(spark, sf, "labels").select(F.col("doc_id").alias("comment_id"))
    return joins.unused(c, used, "comment_id").select("comment_id").orderBy("comment_id").limit(200)


@query(
    "U03_except",
    "SELECT doc_id AS comment_id, lang AS detected_language FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def except_rows(spark, sf):
    c = plain(spark, sf).select("comment_id", "detected_language")
    used = views.table(spark, sf, "labels").select(F.col("doc_id").alias("comment_id"))
    return joins.unused(c, used, "comment_id", language=None)


# ---------------------------------------------------------------- quality


@query(
    "Q01_validated_comments",
    with_(COMMENTS, RAW)
    + f"""SELECT comment_id, CAST(year(try_cast(published_at AS TIMESTAMP)) AS INTEGER) AS year,
  coalesce(spam_label, 'unknown') AS spam_label, coalesce(emotion_label, 'unknown') AS emotion_label
FROM raw WHERE length({t}) BETWEEN 3 AND 10000 AND year(try_cast(published_at AS TIMESTAMP)) BETWEEN 2005 AND 2025""",
)
def validated_comments(spark, sf):
    kept = filters.validated(views.raw_comments(spark, sf))
    return kept.select("comment_id", F.year("published_at").alias("year"), "spam_label", "emotion_label")


@query(
    "Q01_removed_count",
    with_(COMMENTS, RAW)
    + f"""SELECT count(*) AS total, count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS removed,
  {sql_r6('count(*) FILTER (NOT keep) * 100.0 / count(*)')} AS removed_pct FROM (SELECT coalesce(length({t}) BETWEEN 3 AND 10000
  AND year(try_cast(published_at AS TIMESTAMP)) BETWEEN 2005 AND 2025, false) AS keep FROM raw)""",
)
def removed_count(spark, sf):
    raw = views.raw_comments(spark, sf)
    keep = filters.length_between(F.col(t)) & filters.year_between(filters.parsed("published_at"))
    return filters.removal_report(raw, keep)


NOW = "2024-06-01 00:00:00"
_RAW_COLUMNS = ["comment_id", t, "published_at", "detected_language", "spam_label", "emotion_label", "like_count"]
_EMPTY = " + ".join(f"CASE WHEN count({c}) = 0 THEN 1 ELSE 0 END" for c in _RAW_COLUMNS)
METRICS = f"""r AS MATERIALIZED (SELECT *, try_cast(published_at AS TIMESTAMP) AS ts FROM raw),
metrics AS MATERIALIZED (SELECT count(*) AS total, {_EMPTY} AS empty_columns, count(*) FILTER ({t} IS NULL) AS missing,
  count(*) FILTER (length({t}) < 3) AS short, count(*) FILTER (length({t}) > 1000) AS long,
  count(*) FILTER ({sql_runs(t, 6)} > 0) AS repeats, count(*) FILTER (({SQL_NON_ALPHA}) > 0.7) AS non_alphabetic,
  count(*) FILTER (published_at IS NOT NULL AND ts IS NULL) AS unparseable,
  count(*) FILTER (ts > TIMESTAMP '{NOW}') AS future, count(*) FILTER (ts < TIMESTAMP '2005-01-01') AS too_old,
  CAST(floor(epoch(max(ts) - min(ts)) / 86400) AS BIGINT) AS span_days,
  count(*) FILTER (spam_label = 'unknown') * 1.0::DOUBLE / count(*) AS spam_label_unknown,
  count(*) FILTER (emotion_label = 'unknown') * 1.0::DOUBLE / count(*) AS emotion_label_unknown,
  min(detected_language) = max(detected_language) AS one_language,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(_RAW_COLUMNS)} FROM raw)) AS duplicates FROM r),
quality AS MATERIALIZED (SELECT *, greatest(0.0::DOUBLE, 100.0::DOUBLE
  - 10 * ((total = 0)::INT + (duplicates > 0)::INT + (empty_columns > 0)::INT) - 15 * (missing > 0)::INT
  - 10 * (unparseable > 0)::INT - 3 * ((short > 0)::INT + (long > 0)::INT + (repeats > 0)::INT + (non_alphabetic > 0)::INT)
  - 2 * ((future > 0)::INT + (too_old > 0)::INT + (span_days < 30)::INT)
  - 2 * ((spam_label_unknown > 0.8)::INT + (emotion_label_unknown > 0.8)::INT + one_language::INT)) AS quality_score FROM metrics)"""


def quality_row(spark, sf):
    measured = quality.metrics(views.raw_comments(spark, sf), F.expr(f"TIMESTAMP_NTZ '{NOW}'"))
    return quality.scored(measured)


@query("Q02_quality_metrics", with_(COMMENTS, RAW, METRICS) + "SELECT * FROM quality")
def quality_metrics(spark, sf):
    return quality_row(spark, sf)


@query(
    "Q03_recommendations",
    with_(COMMENTS, RAW, METRICS)
    + """SELECT 'Dataset ''raw'' needs quality improvements' AS recommendation FROM quality WHERE quality_score < 80
UNION ALL SELECT 'Remove duplicate rows from ''raw''' FROM quality WHERE duplicates > 0
UNION ALL SELECT 'Handle missing comments in ''raw''' FROM quality WHERE missing > 0
UNION ALL SELECT 'Fix timestamp parsing errors in ''raw''' FROM quality WHERE unparseable > 0""",
)
def recommendations(spark, sf):
    return quality.recommendations(quality_row(spark, sf), "raw")


@query(
    "Q04_completeness_profile",
    with_(COMMENTS, RAW)
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values FROM raw"
        for c in _RAW_COLUMNS
    ),
)
def completeness_profile(spark, sf):
    return quality.profile(views.raw_comments(spark, sf))


_PROFILED = ["detected_language", "spam_label", "emotion_label", "like_count"]


@query(
    "S12_top_values",
    with_(COMMENTS, RAW, "vals AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM raw WHERE {c} IS NOT NULL GROUP BY 2" for c in _PROFILED
    ) + ")")
    + """SELECT "column", value, n, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS place FROM vals
WHERE "column" IN (SELECT "column" FROM vals GROUP BY 1 HAVING count(*) BETWEEN 2 AND 19) QUALIFY place <= 5""",
)
def top_values(spark, sf):
    return quality.top_values(views.raw_comments(spark, sf, text=False), _PROFILED)
