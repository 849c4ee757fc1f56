"""Sources, sinks and streams: each query writes derived files to the work folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from glosa.plans import views
from glosa.plans.registry import query
from glosa.plans.text_queries import sql_r6, sub, t
from glosa.plans.views import COMMENTS, RAW, with_
from glosa.session import work_dir
from glosa.sources import conversion, readers, writers
from glosa.streaming import ingest

LINE = sub(t, "\\r|\\n", " ")


def raw_csv(spark, sf, *drop, **options):
    path = work_dir(spark, "csv")
    writers.write_csv(views.raw_comments(spark, sf).drop(*drop), path, **options)
    return path


@query(
    "S01_csv_scan",
    with_(COMMENTS, RAW)
    + f"""SELECT comment_id, CAST(length({t}) AS INTEGER) AS n_chars, published_at, coalesce(spam_label, 'unknown') AS spam_label, 'unknown' AS emotion_label
FROM raw WHERE {t} IS NOT NULL AND published_at IS NOT NULL""",
)
def csv_scan(spark, sf):
    """A file whose spam column is called is_spam and which has no emotion column."""
    path = work_dir(spark, "csv")
    raw = views.raw_comments(spark, sf).drop("emotion_label").withColumnRenamed("spam_label", "is_spam")
    writers.write_csv(raw, path)
    c = readers.read_comments(spark, path)
    return c.select(F.col("comment_id").cast("long"), F.length(t).alias("n_chars"), "published_at", "spam_label", "emotion_label")


@query(
    "S02_validated_scan",
    with_(COMMENTS, RAW)
    + f"""SELECT comment_id, md5({t}) AS digest, strftime(try_cast(published_at AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS ts,
  coalesce(spam_label, 'unknown') AS spam_label, coalesce(emotion_label, 'unknown') AS emotion_label
FROM raw WHERE length({t}) BETWEEN 3 AND 10000 AND year(try_cast(published_at AS TIMESTAMP)) BETWEEN 2005 AND 2025""",
)
def validated_scan(spark, sf):
    c = readers.read_validated(spark, raw_csv(spark, sf))
    return c.select(
        F.col("comment_id").cast("long"), F.md5(t).alias("digest"),
        F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("ts"), "spam_label", "emotion_label",
    )


@query(
    "S03_language_scan",
    with_(COMMENTS, RAW)
    + f"SELECT comment_id, md5({t}) AS digest FROM raw WHERE detected_language = 'es' AND {t} IS NOT NULL AND published_at IS NOT NULL",
)
def language_scan(spark, sf):
    c = readers.read_comments(spark, raw_csv(spark, sf), language="es")
    return c.select(F.col("comment_id").cast("long"), F.md5(t).alias("digest"))


@query("S04_headerless_scan", with_(COMMENTS, RAW) + f"SELECT md5(coalesce({t}, '')) AS digest FROM raw")
def headerless_scan(spark, sf):
    path = raw_csv(spark, sf, header=False)
    return readers.read_headerless(spark, path, 1).select(F.md5("text").alias("digest"))


@query(
    "S05_tab_separated_scan",
    with_(COMMENTS) + f"SELECT comment_id, md5({t}) AS digest, detected_language FROM comments",
)
def tab_separated_scan(spark, sf):
    path = work_dir(spark, "tsv")
    c = views.comments(spark, sf, labelled=False).select("comment_id", t, "detected_language")
    writers.write_csv(c, path, sep="\t")
    back = readers.read_tsv(spark, path)
    return back.select(F.col("comment_id").cast("long"), F.md5(t).alias("digest"), "detected_language")


@query(
    "S06_training_files",
    with_(COMMENTS) + f"SELECT md5({t}) AS digest, 1 AS label FROM comments WHERE spam_label = 'spam' AND video IN ('video_a', 'video_b')",
)
def training_files(spark, sf):
    """Two files with the right columns, in different order, and one without."""
    c = views.comments(spark, sf)
    known = c.filter("spam_label IS NOT NULL").select(
        F.col("video"), F.col(t).alias("CONTENT"), F.when(F.col("spam_label") == "spam", 1).otherwise(0).alias("CLASS")
    )
    root = work_dir(spark, "training")
    writers.write_csv(known.filter("video = 'video_a'").select("CONTENT", "CLASS"), f"{root}/a.csv")
    writers.write_csv(known.filter("video = 'video_b'").select("CLASS", "CONTENT"), f"{root}/b.csv")
    writers.write_csv(c.select(F.col(t).alias("BODY"), F.lit(1).alias("CLASS")), f"{root}/c.csv")
    rows = readers.read_spam_training(spark, [f"{root}/{n}.csv" for n in "abc"])
    return rows.select(F.md5("text").alias("digest"), "label")


def landed_pages(spark, sf, twice: bool = False):
    """API pages of twenty comments each, as JSON lines; some items lack a text or a date."""
    raw = views.raw_comments(spark, sf).dropDuplicates(["comment_id"])
    top = F.struct(
        F.col("comment_id").cast("string").alias("id"),
        F.struct(
            F.col(t).alias("textDisplay"), F.col("published_at").alias("publishedAt"),
            F.concat(F.lit("user"), F.col("like_count")).alias("authorDisplayName"), F.col("like_count").alias("likeCount"),
        ).alias("snippet"),
    )
    item = F.struct(F.struct(top.alias("topLevelComment"), F.lit(0).alias("totalReplyCount")).alias("snippet"))
    page = F.floor(F.col("comment_id") / 20)  # at most twenty items per page
    pages = raw.groupBy(page.alias("p")).agg(F.collect_list(item).alias("items"))
    path = work_dir(spark, "pages")
    pages.select("items", F.concat(F.lit("t"), "p").alias("nextPageToken")).write.json(path)
    return path


_PAGE_SQL = f"""SELECT DISTINCT CAST(comment_id AS VARCHAR) AS comment_id, md5({t}) AS digest, published_at,
  'user' || like_count AS author_name, CAST(epoch(try_cast(published_at AS TIMESTAMP)) AS BIGINT) AS published_at_unix, like_count
FROM raw WHERE {t} <> '' AND published_at <> ''"""


def _page_columns(df):
    return df.select("comment_id", F.md5(t).alias("digest"), "published_at", "author_name", "published_at_unix", "like_count")


@query("S07_api_pages", with_(COMMENTS, RAW) + _PAGE_SQL)
def api_pages(spark, sf):
    return _page_columns(readers.read_pages(spark, landed_pages(spark, sf)))


@query(
    "S08_json_dump",
    """SELECT doc_id AS id, lang, CASE WHEN doc_id % 2 = 0 THEN source END AS origin,
  CASE WHEN doc_id % 2 = 1 THEN n_chars END AS size FROM documents""",
)
def json_dump(spark, sf):
    """Two kinds of records with different keys in one array per file."""
    docs = views.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    i = F.col("doc_id")
    path = work_dir(spark, "dump")
    # null fields are left out of the JSON text, so keys vary by record
    record = F.struct(
        i.alias("id"), "lang", F.when(i % 2 == 0, F.col("source")).alias("origin"), F.when(i % 2 == 1, F.col("n_chars")).alias("size")
    )
    docs.groupBy(F.floor(i / 100).alias("f")).agg(F.collect_list(record).alias("comments")).select("comments").write.json(path)
    return readers.read_dump(spark, path, multi_line=False).select("id", "lang", "origin", "size")


@query(
    "S09_csv_to_parquet",
    with_(COMMENTS, RAW)
    + f"""SELECT comment_id, md5({t}) AS digest, like_count FROM raw""",
)
def csv_to_parquet(spark, sf):
    root = work_dir(spark, "tree")
    raw = views.raw_comments(spark, sf)
    writers.write_csv(raw.filter("like_count < 50"), f"{root}/in/low")
    writers.write_csv(raw.filter("like_count >= 50"), f"{root}/in/deep/high")
    out = conversion.convert_tree(spark, f"{root}/in", f"{root}/out", compression="zstd")
    back = spark.read.parquet(*out)
    return back.select(F.col("comment_id").cast("long"), F.md5(readers.filled(F.col(t))).alias("digest"), "like_count")


_MIXED = ["yes", "F", "1", "maybe"]


@query(
    "S10_type_coercion",
    """SELECT comment_id, CASE WHEN lower(is_reply) IN ('true', 'yes', '1', 't', 'y') THEN true
  WHEN lower(is_reply) IN ('false', 'no', '0', 'f', 'n') THEN false END AS is_reply,
  coalesce(try_cast(like_count AS BIGINT), 0) AS like_count, coalesce(try_cast(published_at_unix AS DOUBLE), 0.0::DOUBLE) AS published_at_unix
FROM (SELECT 'c' || doc_id AS comment_id, ['yes', 'F', '1', 'maybe'][1 + doc_id % 4] AS is_reply,
  CASE WHEN doc_id % 5 = 0 THEN 'n/a' ELSE CAST(n_chars AS VARCHAR) END AS like_count,
  CASE WHEN doc_id % 7 = 0 THEN 'Unknown' ELSE CAST(doc_id * 1000 AS VARCHAR) END AS published_at_unix FROM documents)""",
)
def type_coercion(spark, sf):
    i = F.col("doc_id")
    mixed = views.table(spark, sf, "documents").select(
        F.concat(F.lit("c"), i).alias("comment_id"),
        views._pick(_MIXED, (i % 4).cast("int")).alias("is_reply"),
        F.when(i % 5 == 0, "n/a").otherwise(F.col("n_chars").cast("string")).alias("like_count"),
        F.when(i % 7 == 0, "Unknown").otherwise((i * 1000).cast("string")).alias("published_at_unix"),
    )
    return conversion.coerce_types(mixed)


_CONVERTED = "converted AS (SELECT comment_id, like_count + CASE WHEN like_count = 40 THEN 1 ELSE 0 END AS like_count, detected_language FROM comments WHERE like_count < 96)"


def converted_pair(spark, sf):
    c = views.comments(spark, sf, labelled=False, text=False).select("comment_id", "like_count", "detected_language")
    likes = F.col("like_count")
    changed = c.filter(likes < 96).withColumn("like_count", likes + F.when(likes == 40, 1).otherwise(0))
    path = work_dir(spark, "converted")
    changed.write.parquet(path)
    return c, spark.read.schema(changed.schema).parquet(path)


@query(
    "S11_conversion_cells",
    with_(COMMENTS, _CONVERTED)
    + """SELECT 'like_count' AS "column", count(v.comment_id) AS compared, count(*) FILTER (v.comment_id IS NULL OR v.like_count <> c.like_count) AS differing
FROM comments c LEFT JOIN converted v ON c.comment_id = v.comment_id
UNION ALL SELECT 'detected_language', count(v.comment_id), count(*) FILTER (v.comment_id IS NULL) FROM comments c LEFT JOIN converted v ON c.comment_id = v.comment_id""",
)
def conversion_cells(spark, sf):
    return conversion.compare_tables(*converted_pair(spark, sf), "comment_id")


@query(
    "S11_types",
    """SELECT * FROM (
SELECT 'doc_id' AS "column", 'bigint' AS left_type, 'bigint' AS right_type, true AS equal, count(doc_id) AS filled FROM documents
UNION ALL SELECT 'text', 'string', NULL, false, count(text) FROM documents
UNION ALL SELECT 'lang', 'string', 'string', true, count(lang) FROM documents
UNION ALL SELECT 'source', 'string', NULL, false, count(source) FROM documents
UNION ALL SELECT 'n_chars', 'bigint', 'string', false, count(n_chars) FROM documents
UNION ALL SELECT 'digest', NULL, 'string', false, NULL FROM (SELECT 1))""",
)
def column_types(spark, sf):
    """Types of documents against those of a conversion of them, with the filled cells of the source's columns."""
    docs = views.table(spark, sf, "documents")
    path = work_dir(spark, "typed")
    docs.select("doc_id", "lang", F.col("n_chars").cast("string").alias("n_chars"), F.md5("text").alias("digest")).write.parquet(path)
    types = conversion.compare_types(docs, spark.read.parquet(path))
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in docs.columns]))
    filled = docs.agg(*[F.count(c).alias(c) for c in docs.columns]).select(cells)  # a row per column
    return types.join(filled, "column", "left")


@query(
    "S11_tree_status",
    with_(COMMENTS, RAW)
    + """SELECT CASE WHEN like_count < 30 THEN 'low' WHEN like_count < 60 THEN 'deep' ELSE 'late' END AS folder,
  CASE WHEN like_count < 60 THEN 'ok' ELSE 'missing' END AS status, count(*) AS source_rows,
  CASE WHEN max(like_count) < 60 THEN count(*) END AS converted_rows FROM raw GROUP BY 1, 2""",
)
def tree_status(spark, sf):
    """Two folders of CSV files are converted, a third lands afterwards: status of all files, summed by folder."""
    root = work_dir(spark, "status")
    raw = views.raw_comments(spark, sf, labelled=False)
    likes = F.col("like_count")
    writers.write_csv(raw.filter(likes < 30), f"{root}/in/low")
    writers.write_csv(raw.filter((likes >= 30) & (likes < 60)), f"{root}/in/deep/down")
    conversion.convert_tree(spark, f"{root}/in", f"{root}/out")
    writers.write_csv(raw.filter(likes >= 60), f"{root}/in/late")
    status = conversion.tree_status(spark, f"{root}/in", f"{root}/out").filter("source_rows > 0")
    folder = F.split_part("file", F.lit("/"), F.lit(1)).alias("folder")
    return status.groupBy(folder, "status").agg(
        F.sum("source_rows").alias("source_rows"), F.sum("converted_rows").alias("converted_rows")
    )


@query(
    "S11_conversion_status",
    with_(COMMENTS, _CONVERTED)
    + f"""SELECT n AS source_rows, m AS converted_rows, {sql_r6('(n - m) * 100.0 / n')} AS lost_pct, true AS columns_equal,
  '' AS unmatched_columns, CASE WHEN m <= n AND (n - m) * 100.0 / n < 5 THEN 'ok' ELSE 'failed' END AS status
FROM (SELECT (SELECT count(*) FROM comments) AS n, (SELECT count(*) FROM converted) AS m)""",
)
def conversion_status(spark, sf):
    return conversion.conversion_status(*converted_pair(spark, sf))


@query(
    "S13_yearly_split",
    with_(COMMENTS, RAW)
    + """SELECT CAST(year(try_cast(published_at AS TIMESTAMP)) AS INTEGER) AS year, count(*) AS n, CAST(sum(comment_id) AS BIGINT) AS ids
FROM raw WHERE try_cast(published_at AS TIMESTAMP) IS NOT NULL GROUP BY 1""",
)
def yearly_split(spark, sf):
    path = work_dir(spark, "yearly")
    raw = views.raw_comments(spark, sf)
    writers.write_by_year(raw.withColumn("published_at", F.col("published_at").try_cast("timestamp_ntz")), path)
    back = spark.read.parquet(path)
    return back.groupBy("year").agg(F.count("*").alias("n"), F.sum("comment_id").alias("ids"))


@query("S14_quoted_csv", with_(COMMENTS) + f"SELECT comment_id, md5({LINE}) AS digest, detected_language FROM comments")
def quoted_csv(spark, sf):
    path = work_dir(spark, "quoted")
    c = views.comments(spark, sf, labelled=False).select("comment_id", t, "detected_language")
    writers.write_quoted_csv(c, path)
    back = readers.read_csv(spark, path, multi_line=False)
    return back.select(F.col("comment_id").cast("long"), F.md5(t).alias("digest"), "detected_language")


@query(
    "S15_insights",
    with_(COMMENTS)
    + """SELECT 'volume.n' AS metric, video AS key, CAST(count(*) AS VARCHAR) AS value FROM comments GROUP BY video
UNION ALL SELECT 'volume.likes', video, CAST(sum(like_count) AS VARCHAR) FROM comments GROUP BY video""",
)
def insights(spark, sf):
    c = views.comments(spark, sf, labelled=False, text=False)
    summary = c.groupBy("video").agg(F.count("*").alias("n"), F.sum("like_count").alias("likes"))
    path = work_dir(spark, "insights")
    writers.write_insights(writers.insight_rows(summary, "volume", "video"), path)
    return spark.read.schema("metric string, key string, value string").json(path)


@query(
    "S17_text_column",
    """SELECT 'text' AS "column", count(*) AS n FROM documents
UNION ALL SELECT 'url', count(*) FROM pages""",
)
def text_column(spark, sf):
    """Documents have a column of that name; for pages the first long string column is found."""
    docs, pages = views.table(spark, sf, "documents"), views.table(spark, sf, "pages")
    found = [(f, readers.text_column(f)) for f in (docs, pages)]
    rows = [f.agg(F.count("*").alias("n")).select(F.lit(name).alias("column"), "n") for f, name in found]
    return rows[0].unionByName(rows[1])


# -------------------------------------------------------------------- streams


@query("ST01_page_ingest", with_(COMMENTS, RAW) + _PAGE_SQL)
def page_ingest(spark, sf):
    root = work_dir(spark, "ingest")
    landing = landed_pages(spark, sf)
    # a second run finds nothing new: the checkpoint remembers the pages
    for _ in range(2):
        ingest.ingest_pages(spark, landing, f"{root}/sink", f"{root}/checkpoint", files_per_batch=3)
    return _page_columns(spark.read.parquet(f"{root}/sink"))


def events_stream(spark, sf, path=None, files_per_batch=1000):
    schema = views.table(spark, sf, "events").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path or f"{sf}/events*.parquet")


@query("ST02_stream_dedupe", "SELECT event_id, user_id, event_type FROM events")
def stream_dedupe(spark, sf):
    """Three parts land out of time order, the stream runs after each; every twentieth event lands in two of them."""
    root = work_dir(spark, "dedupe")
    events = views.table(spark, sf, "events")
    bounds = events.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("m")).agg(F.min("m"), F.max("m")).first()
    third = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - bounds[0]) * 3 / (bounds[1] - bounds[0] + 1))
    own = F.array(2 - third)  # the last third of the time first
    both = F.when(F.col("event_id") % 20 == 0, F.array(2 - third, (3 - third) % 3)).otherwise(own)
    landed = events.withColumn("_part", F.explode(both))
    for part in range(3):
        rows = landed.filter(F.col("_part") == part).drop("_part")
        rows.write.mode("append").parquet(f"{root}/landing")
        stream = events_stream(spark, sf, f"{root}/landing")
        ingest.append_new(stream, "event_id", "ts", f"{root}/sink", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/sink").select("event_id", "user_id", "event_type")


@query(
    "ST04_daily_counts",
    f"""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, {sql_r6('sum(value)')} AS total FROM events GROUP BY 1, 2""",
)
def daily_counts(spark, sf):
    root = work_dir(spark, "daily")
    counts = ingest.daily_counts(events_stream(spark, sf), "ts", ["event_type"])
    ingest.keep_latest(counts, f"{root}/sink", f"{root}/checkpoint")
    every = spark.read.parquet(f"{root}/sink")
    last = every.agg(F.max("batch").alias("batch"))
    current = every.join(F.broadcast(last), "batch")  # a single row
    return current.select(
        F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 6).alias("total")
    )
