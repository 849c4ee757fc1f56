"""Classifiers, sentiment, topics, synthetic rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from glosa.functions import text as T
from glosa.functions.patterns import WORD
from glosa.operators import (
    density, evaluation, joins, learning, sampling, sentiment, statistics, synthetic, topic_space, topics,
)
from glosa.plans import views
from glosa.plans.registry import query, sql_array, sql_list, sql_text
from glosa.plans.text_queries import SPACE, sql_clean, sql_r6, sub, t
from glosa.plans.views import COMMENTS, with_
from glosa.session import work_dir, written
from glosa.streaming import ingest
from glosa.vocab import words as vocab

EMOTIONS = vocab.EMOTIONS


def spam_rows(spark, sf):
    """Labelled comments as (comment_id, text, label, part), split by class; written anew in every call."""
    c = views.comments(spark, sf).filter("spam_label IS NOT NULL")
    label = F.when(F.col("spam_label") == "spam", 1.0).otherwise(0.0)
    rows = c.select("comment_id", F.col(t).alias("text"), label.alias("label"))
    return written(sampling.stratified_split(rows, "label", "comment_id", 0.2), "spam-rows")


def trained(spark, sf, bigrams=False):
    rows = spam_rows(spark, sf)
    return learning.fit(learning.spam_pipeline("logistic", bigrams), rows.filter("part = 'train'")), rows


def spam_report(model, held, name):
    scored = model.transform(held)
    truth, guess = F.col("label").cast("int").cast("string"), F.col("prediction").cast("int").cast("string")
    pairs = evaluation.pair_counts(scored.select(truth.alias("t"), guess.alias("p")), "t", "p")
    return evaluation.accuracy_report(pairs, ["0", "1"]).withColumn("model", F.lit(name))


@query("M01_spam_classifier")
def spam_classifier(spark, sf):
    model, rows = trained(spark, sf, bigrams=True)
    return spam_report(model, rows.filter("part = 'test'"), "logistic")


@query("M02_naive_bayes_comparison")
def naive_bayes_comparison(spark, sf):
    rows = spam_rows(spark, sf)
    train, held = learning.featurized(rows.filter("part = 'train'"), rows.filter("part = 'test'"))
    logistic, bayes = (spam_report(learning.classifier(k).fit(train), held, k) for k in ("logistic", "bayes"))
    return logistic.unionByName(bayes)


@query("M03_spam_scoring")
def spam_scoring(spark, sf):
    """The fitted model is saved, loaded again and applied to every comment."""
    from pyspark.ml import PipelineModel

    model, _ = trained(spark, sf)
    path = work_dir(spark, "model")
    model.write().overwrite().save(path)
    scored = learning.predict_spam(PipelineModel.load(path), views.comments(spark, sf, labelled=False))
    return scored.select("comment_id", "is_spam_prediction", "spam_score")


def emotion_model(spark, sf):
    c = views.comments(spark, sf, labelled=False).filter("emotion_label IS NOT NULL")
    return learning.fit(learning.emotion_pipeline(EMOTIONS), c.select(F.col(t).alias("text"), "emotion_label"))


@query("M04_two_stage_labelling")
def two_stage_labelling(spark, sf):
    model, _ = trained(spark, sf)
    c = views.comments(spark, sf, labelled=False)
    spam = learning.predict_spam(model, c)
    both = learning.score_emotions(emotion_model(spark, sf), spam)
    return both.select(
        "comment_id", F.when(F.col("is_spam_prediction") == 1, "spam").otherwise("not_spam").alias("spam_label"),
        F.col("emotion").alias("emotion_label"),
    )


@query("M05_learning_curve")
def learning_curve(spark, sf):
    return learning.learning_curve(spam_rows(spark, sf).filter("part = 'train'").drop("part"))


@query("M06_grid_search")
def grid_search(spark, sf):
    return learning.grid_search(spam_rows(spark, sf).filter("part = 'train'").drop("part"))[1]


@query("M07_emotion_scores")
def emotion_scores(spark, sf):
    """Seven scores for every comment that is not labelled spam."""
    c = views.comments(spark, sf)
    ham = c.filter(F.coalesce(F.col("spam_label") != "spam", F.lit(True))).filter(F.trim(t) != "")
    scored = learning.score_emotions(emotion_model(spark, sf), ham)
    return scored.select("comment_id", *[f"emotion_{e}" for e in EMOTIONS], "emotion")


@query("ST03_stream_scoring")
def stream_scoring(spark, sf):
    """Comments land in a folder; every batch is scored by the spam model and appended."""
    from pyspark.ml import PipelineModel

    root = work_dir(spark, "scoring")
    landed = views.comments(spark, sf, labelled=False).select("comment_id", F.col(t).alias("text"))
    landed.write.parquet(f"{root}/landing")
    model, _ = trained(spark, sf)
    stream = spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/landing")
    ingest.score_batches(stream, model, ["comment_id", "prediction"], f"{root}/sink", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/sink").select("comment_id", F.col("prediction").cast("int"))


# -------------------------------------------------------------------- sentiment

_PRIOR, _ODDS = sentiment.weights()
_ODDS_SQL = "MAP {" + ", ".join(f"{sql_text(w)}: {v!r}::DOUBLE" for w, v in _ODDS.items()) + "}"
_LETTERS = sub(f"lower({t})", rf"[^\p{{L}}{SPACE}]")


@query(
    "M08_sentiment",
    with_(
        COMMENTS,
        f"""odds AS (SELECT comment_id, {_PRIOR!r}::DOUBLE + coalesce(list_sum(list_transform(
  list_filter(string_split_regex({_LETTERS}, '[{SPACE}]+'), lambda w: list_contains({sql_array(_ODDS)}, w)),
  lambda w: {_ODDS_SQL}[w])), 0) AS x FROM comments)""",
    )
    + f"""SELECT comment_id, CASE WHEN x > 0 THEN 'positive' ELSE 'negative' END AS sentiment,
  {sql_r6('1 / (1 + exp(-greatest(-700, least(700, x))))')} AS p_positive,
  {sql_r6('1 - 1 / (1 + exp(-greatest(-700, least(700, x))))')} AS p_negative FROM odds""",
)
def sentiment_scores(spark, sf):
    scored = sentiment.scored(views.comments(spark, sf, labelled=False))
    return scored.select("comment_id", "sentiment", "p_positive", "p_negative")


# ----------------------------------------------------------------------- topics

TOPIC = "emotion_label"
_STOP = sorted(set(vocab.STOP_MIXED) | set(vocab.STOP_ES))
WEIGHTS = f"""tokens AS (SELECT {TOPIC}, unnest(string_split({sql_clean(t, ' ')}, ' ')) AS word FROM comments WHERE {TOPIC} IS NOT NULL),
counts AS MATERIALIZED (SELECT {TOPIC}, word, count(*) AS tf FROM tokens WHERE length(word) >= 2 AND word NOT IN {sql_list(_STOP)} GROUP BY 1, 2),
weights AS MATERIALIZED (SELECT {TOPIC}, word, tf, tf * 1.0::DOUBLE / sum(tf) OVER (PARTITION BY {TOPIC})
  * ln(1 + (SELECT avg(n) FROM (SELECT sum(tf) AS n FROM counts GROUP BY {TOPIC})) / sum(tf) OVER (PARTITION BY word)) AS weight FROM counts),
words AS MATERIALIZED (SELECT * FROM weights QUALIFY row_number() OVER (PARTITION BY {TOPIC} ORDER BY round(weight, 9) DESC, word) <= 10)"""


def label_topic_words(spark, sf):
    c = views.comments(spark, sf, labelled=False).filter(f"{TOPIC} IS NOT NULL")
    weights = topics.class_tfidf(c, TOPIC, T.clean(F.col(t), " "), _STOP)
    return topics.topic_words(weights, TOPIC)


@query(
    "M09_topic_words",
    with_(COMMENTS, WEIGHTS) + f"SELECT {TOPIC}, word, {sql_r6('weight')} AS weight FROM words",
)
def topic_words(spark, sf):
    return label_topic_words(spark, sf).withColumn("weight", F.round("weight", 6))


@query(
    "M09_topic_names",
    with_(COMMENTS, WEIGHTS)
    + f"""SELECT {TOPIC}, {TOPIC} || '_' || string_agg(word, '_' ORDER BY round(weight, 9) DESC, word) AS topic_name FROM (
  SELECT *, row_number() OVER (PARTITION BY {TOPIC} ORDER BY round(weight, 9) DESC, word) AS r FROM words) WHERE r <= 4 GROUP BY {TOPIC}""",
)
def topic_names(spark, sf):
    return topics.topic_names(label_topic_words(spark, sf), TOPIC)


_SPACE_STOP = sorted(set(_STOP) | set(vocab.STOP_EN))
SPACE_TERMS = f"""texts AS (SELECT comment_id, emotion_label, list_filter(string_split_regex(lower({t}), '[^{WORD}]+'),
  lambda w: length(w) >= 2 AND NOT list_contains({sql_array(_SPACE_STOP)}, w)) AS ws FROM comments WHERE length({t}) >= 10),
raw_terms AS (SELECT comment_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM texts),
term_counts AS MATERIALIZED (SELECT comment_id, term, count(*) AS tf FROM raw_terms GROUP BY ALL),
sized AS (SELECT count(DISTINCT comment_id) AS n FROM term_counts),
terms AS MATERIALIZED (SELECT term, df, ln((n + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) AS idf FROM (
  SELECT term, count(*) AS df FROM term_counts GROUP BY 1), sized WHERE df >= 2 AND df <= 0.95::DOUBLE * n)"""
CENTRES = """weighted AS (SELECT comment_id, term, tf * idf AS w FROM term_counts JOIN terms USING (term)),
lengths AS (SELECT comment_id, sqrt(sum(w * w)) AS len FROM weighted GROUP BY 1 HAVING len > 0),
entries AS MATERIALIZED (SELECT comment_id, term, w / len AS x FROM weighted JOIN lengths USING (comment_id)),
members AS (SELECT comment_id, emotion_label FROM texts WHERE emotion_label IS NOT NULL AND comment_id IN (SELECT comment_id FROM lengths)),
sizes AS (SELECT emotion_label, count(*) AS n FROM members GROUP BY 1),
centres AS MATERIALIZED (SELECT emotion_label, term, sum(x) / n AS c FROM entries JOIN members USING (comment_id) JOIN sizes USING (emotion_label) GROUP BY emotion_label, term, n),
dots AS (SELECT comment_id, emotion_label, sum(x * c) AS dot FROM entries JOIN centres USING (term) GROUP BY ALL),
squares AS (SELECT comment_id, emotion_label, round(1 + norm - 2 * coalesce(dot, 0), 9) AS d
  FROM lengths CROSS JOIN (SELECT emotion_label, sum(c * c) AS norm FROM centres GROUP BY 1) LEFT JOIN dots USING (comment_id, emotion_label))"""


def spaced(spark, sf):
    """Comments of ten characters or more with their entries."""
    c = views.comments(spark, sf, labelled=False).filter(F.length(t) >= 10)
    return c, topic_space.text_space(c.select("comment_id", t), "comment_id", t, _SPACE_STOP)


@query(
    "M09_term_dictionary",
    with_(COMMENTS, SPACE_TERMS)
    + f"SELECT term, row_number() OVER (ORDER BY term) - 1 AS number, df, {sql_r6('idf')} AS idf FROM terms",
)
def term_dictionary(spark, sf):
    c = views.comments(spark, sf, labelled=False).filter(F.length(t) >= 10)
    terms, _ = topic_space.term_space(c.select("comment_id", t), "comment_id", t, _SPACE_STOP)
    return terms.select("term", "number", "df", F.round("idf", 6).alias("idf"))


@query(
    "M09_nearest_centre",
    with_(COMMENTS, SPACE_TERMS, CENTRES)
    + f"""SELECT comment_id, min_by(emotion_label, (d, emotion_label)) AS emotion_label, {sql_r6('sqrt(greatest(min(d), 0))')} AS distance
FROM squares GROUP BY 1""",
)
def nearest_centre(spark, sf):
    """The label whose comments have the nearest mean: one step of sparse k-means from given members."""
    c, entries = spaced(spark, sf)
    members = c.filter("emotion_label IS NOT NULL").select("comment_id", "emotion_label")
    centre = topic_space.centres(entries, members, "comment_id", "emotion_label")
    found = topic_space.nearest(entries, centre, "comment_id", "emotion_label")
    return found.select("comment_id", "emotion_label", F.round("distance", 6).alias("distance"))


def clustered(spark, sf):
    """comment_id, text, topic, topic_probability: density clusters in five dimensions; -1 is noise."""
    c, entries = spaced(spark, sf)
    reduced = topic_space.reduce(entries, "comment_id")
    names = [x for x in reduced.columns if x != "comment_id"]
    found = written(density.clusters(reduced, "comment_id", names), "topics", None, True)
    joined = c.select("comment_id", t).join(found, "comment_id", "left")
    return joined.fillna({"topic": -1, "topic_probability": 0.0})


@query("M09_topic_assignment")
def topic_assignment(spark, sf):
    assigned = written(clustered(spark, sf), "topic-texts", None, True)
    words = topics.topic_words(topics.class_tfidf(assigned, "topic", T.clean(F.col(t), " "), _STOP), "topic")
    named = assigned.join(topics.topic_names(words, "topic"), "topic", "left")
    return named.select("comment_id", "topic", "topic_probability", "topic_name")


@query("M09_topic_summary")
def topic_summary(spark, sf):
    return clustered(spark, sf).groupBy("topic").agg(
        F.count("*").alias("n"), F.count_if(F.col("topic_probability") > 0.5).alias("confident")
    )


_SIM = f"""sizes AS (SELECT {TOPIC}, count(*) AS n, sqrt(sum(weight * weight)) AS norm FROM words GROUP BY 1),
shared AS (SELECT a.{TOPIC} AS ta, b.{TOPIC} AS tb, count(*) AS shared, sum(a.weight * b.weight) AS dot
  FROM words a JOIN words b ON a.word = b.word AND a.{TOPIC} <> b.{TOPIC} GROUP BY 1, 2),
pairs AS MATERIALIZED (SELECT a.{TOPIC} AS topic_a, b.{TOPIC} AS topic_b,
  {sql_r6('coalesce(shared, 0) * 1.0 / (a.n + b.n - coalesce(shared, 0))')} AS jaccard, {sql_r6('coalesce(dot, 0) / (a.norm * b.norm)')} AS cosine
  FROM sizes a JOIN sizes b ON a.{TOPIC} <> b.{TOPIC} LEFT JOIN shared ON ta = a.{TOPIC} AND tb = b.{TOPIC})"""


@query("M10_topic_similarity", with_(COMMENTS, WEIGHTS, _SIM) + "SELECT * FROM pairs")
def topic_similarity(spark, sf):
    return topics.similarity(written(label_topic_words(spark, sf), "words"), TOPIC, EMOTIONS)


@query(
    "J05_best_topic_match",
    with_(COMMENTS, WEIGHTS, _SIM)
    + "SELECT topic_a, topic_b, jaccard FROM pairs QUALIFY row_number() OVER (PARTITION BY topic_a ORDER BY jaccard DESC, topic_b) = 1",
)
def best_topic_match(spark, sf):
    return topics.best_match(topics.similarity(written(label_topic_words(spark, sf), "words"), TOPIC, EMOTIONS))


@query(
    "U04_set_sizes",
    f"""WITH sets AS (SELECT conv_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS words, turn FROM conversations)
SELECT a.conv_id, a.turn, CAST(len(list_intersect(a.words, b.words)) AS INTEGER) AS shared,
  CAST(len(list_distinct(list_concat(a.words, b.words))) AS INTEGER) AS either
FROM sets a JOIN sets b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
)
def set_sizes(spark, sf):
    """Words shared by each turn and the next of a conversation."""
    turns = views.table(spark, sf, "conversations")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    sets = turns.select("conv_id", "turn", words.alias("words"))
    following = sets.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("words").alias("next"))
    shared, either = topics.set_sizes(F.col("words"), F.col("next"))
    return sets.join(following, ["conv_id", "turn"]).select("conv_id", "turn", shared.alias("shared"), either.alias("either"))


# -------------------------------------------------------------- synthetic rows

RARE = ["anger", "disgust", "fear"]


def _sentence_sql(seed: str) -> str:
    def pick(values, index):
        return f"{sql_array(values)}[1 + ({index}) % {len(values)}]"

    cases = []
    for label in RARE:
        text = pick(vocab.SYNTHETIC_TEMPLATES[label], seed)
        text = f"replace({text}, '{{topic}}', {pick(vocab.SYNTHETIC_TOPICS, f'{seed} // 3')})"
        text = f"replace({text}, '{{word}}', {pick(vocab.SYNTHETIC_WORDS[label], f'{seed} // 2')})"
        cases.append(f"WHEN '{label}' THEN upper({text}[1:1]) || lower({text}[2:])")
    return "CASE emotion_label " + " ".join(cases) + " END"


@query(
    "F39_placeholder_fill",
    "WITH every AS ("
    + " UNION ALL ".join(f"SELECT doc_id AS comment_id, '{e}' AS emotion_label FROM documents" for e in RARE)
    + f") SELECT comment_id, emotion_label, {_sentence_sql('comment_id')} AS sentence FROM every",
)
def placeholder_fill(spark, sf):
    ids = views.table(spark, sf, "documents").select(F.col("doc_id").alias("comment_id"))
    rows = statistics.label_grid(ids, "emotion_label", RARE)
    filled = F.coalesce(
        *[F.when(F.col("emotion_label") == x, synthetic.sentence(x, F.col("comment_id"))) for x in RARE]
    )
    return rows.select("comment_id", "emotion_label", filled.alias("sentence"))


@query(
    "M12_synthetic_comments",
    f"""WITH taken AS (SELECT doc_id AS comment_id, doc_id % 97 AS like_count FROM documents
  WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 150),
numbered AS (SELECT *, {sql_array(RARE)}[1 + (row_number() OVER (ORDER BY md5(CAST(comment_id AS VARCHAR)), comment_id) - 1) % 3]
  AS emotion_label FROM taken)
SELECT comment_id, like_count, emotion_label, {_sentence_sql('comment_id')} AS original_comment, """
    + ", ".join(f"CASE WHEN emotion_label = '{e}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS emotion_{e}" for e in EMOTIONS)
    + " FROM numbered",
)
def synthetic_comments(spark, sf):
    c = views.comments(spark, sf, labelled=False, text=False).select("comment_id", "detected_language", "like_count")
    used = views.table(spark, sf, "labels").select(F.col("doc_id").alias("comment_id"))
    unused = joins.unused(c, used, "comment_id").drop("detected_language")
    return synthetic.comments(unused, RARE, 50, EMOTIONS)
