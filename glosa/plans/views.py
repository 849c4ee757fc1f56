"""The shared inputs of the queries, derived from the driver tables, in both dialects.

``comments`` reads every document with its whole text and appends one phrase
chosen by ``doc_id % 26``, so that each word list has hits, misses and overlaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosa.plans.registry import sql_array, sql_text
from glosa.session import spread
from glosa.vocab.words import EMOTIONS

PHRASES = [
    " Love from India",
    " Hi from Turkey 🇹🇷",
    " proud latino and christian",
    " my country Brazil 🇧🇷🇮🇳",
    " soooo good good",
    " check my channel, subscribe http://x.io/a",
    " saludos desde México, soy mexicano",
    " visit puerto rico beach",
    " WATCHING FROM the USA",
    " half asian, our tradition, proud",
    " ❤️👍🏽",
    " Greetings from Mexico City and London 🇲🇽",
    " I pray, God bless my muslim family",
    " back home in our homeland, remember the history",
    " that was nice. that was nice.",
    " 😂😂 @friend WOW!!!!!!",
    " sending love from Germany 🇩🇪 to England",
    " love from Puerto Rico and Hong Kong",
    " hi from Taiwan 🇹🇼",
    " visit 🇵🇷 now",
    " soy una cristiana y musulmana",
    " city food 🔥👍🏽 yum",
    " Love from Hong Kong",
]
#: Every so many documents the phrases start again; the last numbers have none.
CYCLE = 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index):
    """values[index] for a zero-based index column, null beyond the end."""
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def spam_label(toxic):
    return F.when(toxic == 1, "spam").when(toxic == 0, "not_spam")


def comments(spark: SparkSession, sf_dir: str, labelled: bool = True, text: bool = True) -> DataFrame:
    """comment_id, video, original_comment, published_at, detected_language, spam_label,
    emotion_label, like_count.  ``labelled=False`` leaves the label join out and
    ``text=False`` the text column, for plans that need neither."""
    docs = table(spark, sf_dir, "documents").select("doc_id", *(["text"] if text else []), "lang")
    docs = spread(docs, "doc_id", "text") if text else docs
    if labelled:
        labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
        docs = docs.join(labels, "doc_id", "left")
    i = F.col("doc_id")
    phrase = F.coalesce(_pick(PHRASES, (i % CYCLE).cast("int")), F.lit(""))
    hours = (i * 79 % 87600).cast("int")
    columns = {
        "comment_id": i,
        "video": F.when(i % 3 == 0, "video_b").otherwise("video_a"),
        "original_comment": F.concat("text", phrase) if text else None,
        "published_at": F.timestamp_add("HOUR", hours, F.expr("TIMESTAMP_NTZ '2016-01-01 00:00:00'")),
        "detected_language": F.col("lang"),
        "spam_label": spam_label(F.col("toxic")) if labelled else None,
        "emotion_label": F.when(i % 11 != 0, _pick(EMOTIONS, (i % 7).cast("int"))),
        "like_count": i % 97,
    }
    return docs.select(*[c.alias(n) for n, c in columns.items() if c is not None])


_PHRASE_CASE = " ".join(f"WHEN {n} THEN {sql_text(p)}" for n, p in enumerate(PHRASES))

COMMENTS = f"""comments AS MATERIALIZED (
  SELECT d.doc_id AS comment_id,
    CASE WHEN d.doc_id % 3 = 0 THEN 'video_b' ELSE 'video_a' END AS video,
    d.text || CASE d.doc_id % {CYCLE} {_PHRASE_CASE} ELSE '' END AS original_comment,
    TIMESTAMP '2016-01-01 00:00:00' + to_hours(CAST(d.doc_id * 79 % 87600 AS INTEGER)) AS published_at,
    d.lang AS detected_language,
    CASE l.toxic WHEN 1 THEN 'spam' WHEN 0 THEN 'not_spam' END AS spam_label,
    CASE WHEN d.doc_id % 11 <> 0 THEN {sql_array(EMOTIONS)}[1 + d.doc_id % 7] END AS emotion_label,
    d.doc_id % 97 AS like_count
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def raw_comments(spark: SparkSession, sf_dir: str, labelled: bool = True, text: bool = True) -> DataFrame:
    """The comments as a fetcher would leave them: text dates, gaps, repeated rows."""
    c = comments(spark, sf_dir, labelled, text)
    i = F.col("comment_id")
    raw = c.select(
        "comment_id",
        *([F.when(i % 23 != 0, F.col("original_comment")).alias("original_comment")] if text else []),
        F.when(i % 29 == 0, F.lit("not a date"))
        .when(i % 31 == 0, F.lit(None))
        .when(i % 37 == 0, F.lit("1999-05-01T00:00:00Z"))
        .otherwise(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .alias("published_at"),
        "detected_language",
        *(["spam_label"] if labelled else []),
        "emotion_label",
        "like_count",
    )
    copies = F.when(i % 50 == 7, 2).otherwise(1)
    return raw.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop("copy")


RAW = """raw AS MATERIALIZED (
  SELECT comment_id,
    CASE WHEN comment_id % 23 <> 0 THEN original_comment END AS original_comment,
    CASE WHEN comment_id % 29 = 0 THEN 'not a date' WHEN comment_id % 31 = 0 THEN NULL
         WHEN comment_id % 37 = 0 THEN '1999-05-01T00:00:00Z'
         ELSE strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') END AS published_at,
    detected_language, spam_label, emotion_label, like_count
  FROM (SELECT *, unnest(range(CASE WHEN comment_id % 50 = 7 THEN 2 ELSE 1 END)) FROM comments))"""


def _judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """comment_id, label and seven numbers of each labelled vector: ``embeddings`` as a table of judged comments."""
    rows = table(spark, sf_dir, "embeddings")
    parts = [F.get("embedding", F.lit(k)).cast("double").alias(f"e{k}") for k in range(len(EMOTIONS))]
    return rows.select(F.col("vec_id").alias("comment_id"), "label", *parts)


# Labels from seven on have no emotion.  The second annotator moves on by one label where the first number is large, and
# leaves a gap where the second one is small.
_FIRST = "label"
_SECOND = "(label + CASE WHEN e0 > 0.15 THEN 1 ELSE 0 END)"
_GAP = "e1 < -0.2"


def _first_label():
    return _pick(EMOTIONS, F.expr(_FIRST))


def _second_label():
    return F.when(~F.expr(_GAP), _pick(EMOTIONS, F.expr(f"CAST({_SECOND} AS INT)")))


def annotations(spark: SparkSession, sf_dir: str, annotator: str) -> DataFrame:
    """One annotator's labels: they differ on some comments and miss different ones."""
    label = _first_label() if annotator == "a" else _second_label()
    return _judgements(spark, sf_dir).select("comment_id", label.alias("label"))


_NUMBERS = ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS e{k}" for k in range(len(EMOTIONS)))
_JUDGED = f"vectors AS MATERIALIZED (SELECT vec_id AS comment_id, label, {_NUMBERS} FROM embeddings)"
_SECOND_SQL = f"CASE WHEN NOT {_GAP} THEN {sql_array(EMOTIONS)}[1 + {_SECOND}] END"
ANNOTATIONS = f"""{_JUDGED},
ann_a AS (SELECT comment_id, {sql_array(EMOTIONS)}[1 + {_FIRST}] AS label FROM vectors),
ann_b AS (SELECT comment_id, {_SECOND_SQL} AS label FROM vectors)"""


def _score(k: int) -> str:
    """A score in hundredths from one number, with ties and gaps; the label's own score is raised."""
    return f"CASE WHEN e{k} >= -0.25 THEN least(100, floor(abs(e{k}) * 200) + CASE WHEN label = {k} THEN 30 ELSE 0 END) / 100.0 END"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """comment_id, two manual labels and seven emotion scores (with ties and gaps)."""
    rows = _judgements(spark, sf_dir)
    emotion_scores = [F.expr(_score(k)).cast("double").alias(f"emotion_{e}") for k, e in enumerate(EMOTIONS)]
    video = F.when(F.col("comment_id") % 3 == 0, "video_b").otherwise("video_a")
    return rows.select(
        "comment_id", video.alias("video"), _first_label().alias("label_mb"), _second_label().alias("label_eden"),
        *emotion_scores,
    )


SCORES = (
    ANNOTATIONS
    + f""",
scores AS MATERIALIZED (
  SELECT comment_id, CASE WHEN comment_id % 3 = 0 THEN 'video_b' ELSE 'video_a' END AS video,
    {sql_array(EMOTIONS)}[1 + {_FIRST}] AS label_mb, {_SECOND_SQL} AS label_eden, """
    + ", ".join(f"CAST({_score(k)} AS DOUBLE) AS emotion_{e}" for k, e in enumerate(EMOTIONS))
    + """
  FROM vectors)"""
)


def with_(*ctes: str) -> str:
    """WITH clause from the given CTE texts."""
    return "WITH " + ",\n".join(ctes) + "\n"
