"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

All queries run once, then once more; the second, warm sweep counts.  Results are computed in full and handed to
the ``noop`` sink.  ``comments_1m`` times the stages of the geographic analysis one by one over at least a million
short comments, cut from the documents and read from CSV, so that rows per second can be held against one-line
comments.
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "E1_geographic_analysis",  # load, validate, extract, one row per text, monthly counts
    "Q02_quality_metrics",
    "P05_keyword_filter_enhanced",
    "P06_keyword_filter_bounded",
    "P07_location_filter_enhanced",
    "P09_rule_spam_filter",
    "A01_monthly_counts",
    "A09_category_summary",
    "A14_detection_quality",
    "A18_keyword_occurrences",
    "A21_selection_cube",
    "A27_emoji_frequency",
    "A28_topic_word_frequency",
    "F05_clean_text",
    "F17_enhanced_score",
    "J04_dictionary_match",
    "L05_stratified_split_20",
    "M01_spam_classifier",
    "M04_two_stage_labelling",
    "M08_sentiment",
    "M09_topic_words",
    "M09_topic_assignment",
    "M11_language_identification",
    "M14_classification_report",
    "M16_cohen_kappa",
    "S01_csv_scan",
    "S09_csv_to_parquet",
    "S14_quoted_csv",
    "ST02_stream_dedupe",
    "W01_top5_countries_per_year",
    "W02_best_hit_per_text",
]
COMMENTS = 1_000_000


def noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def short_comments(spark, sf_dir: str, path: str) -> int:
    """A CSV folder of at least ``COMMENTS`` comments: sentences of the documents, every 30th with a phrase."""
    from pyspark.sql import functions as F

    from glosa.plans.views import PHRASES
    from glosa.sources import writers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = docs.select("doc_id", F.posexplode(F.split("text", r"[.\n]+")).alias("pos", "piece")).filter("length(piece) > 20")
    copies = -(-COMMENTS // max(1, pieces.count()))
    rows = pieces.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    number = F.xxhash64("doc_id", "pos", "copy")
    phrase = F.get(F.array(*[F.lit(p) for p in PHRASES]), F.pmod(number, F.lit(30 * len(PHRASES))).cast("int"))
    hours = F.pmod(number, F.lit(87_600)).cast("int")
    rows = rows.select(
        number.alias("comment_id"), F.concat(F.substring("piece", 1, 120), F.lit(" "), "copy", F.coalesce(phrase, F.lit(""))).alias("original_comment"),
        F.date_format(F.timestamp_add("HOUR", hours, F.expr("TIMESTAMP_NTZ '2016-01-01 00:00:00'")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"),
    )
    writers.write_quoted_csv(rows, path)
    return copies


def stages(spark, path: str, work: str, turn: int) -> dict:
    """Seconds of each stage of the geographic analysis over the CSV folder."""
    from pyspark.sql import functions as F

    from glosa.functions import geo
    from glosa.operators import geography, quality, statistics
    from glosa.sources import readers

    text, out, clock = F.col("original_comment"), {}, time.perf_counter

    def timed(name, work_once):
        start = clock()
        result = work_once()
        out[name] = round(clock() - start, 3)
        return result

    valid_path, best_path = f"{work}/valid-{turn}", f"{work}/best-{turn}"
    timed("load_validate", lambda: readers.read_validated(spark, path, multi_line=False).write.parquet(valid_path))
    valid = spark.read.parquet(valid_path)
    now = F.expr("TIMESTAMP_NTZ '2024-06-01 00:00:00'")
    timed("quality_score", lambda: noop(quality.scored(quality.metrics(valid, now))))
    timed("keyword_filter", lambda: noop(valid.filter(geo.has_keyword(text)).select("comment_id")))
    narrow = valid.select("comment_id", "published_at", "original_comment")

    def extract():
        geography.best_hits(narrow, keep_text=True).write.parquet(best_path)
        noop(statistics.period_counts(spark.read.parquet(best_path)))

    timed("extract_combine_count", extract)
    timed("sinks", lambda: spark.read.parquet(best_path).write.option("header", True).csv(f"{best_path}-csv"))
    return out


def main() -> None:
    from glosa.plans import catalog
    from glosa.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    n = int(cores) if cores.isdigit() else 8
    work = tempfile.mkdtemp(prefix="glosa-bench-")
    # three tasks per core even out texts of very different length
    spark = build_session("bench", cores, n, work=work, spread=3 * n)
    spark.sparkContext.setLogLevel("ERROR")
    plans = catalog.queries()
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").count()

    def run(name: str) -> float:
        start = time.perf_counter()
        noop(plans[name](spark, sf_dir))
        return time.perf_counter() - start

    for name in HEADLINE:
        run(name)
    times = {name: round(run(name), 3) for name in HEADLINE}
    csv = f"{work}/comments"
    short_comments(spark, sf_dir, csv)
    comments = spark.read.option("header", True).csv(csv).count()
    stages(spark, csv, work, 0)
    warm = stages(spark, csv, work, 1)
    total = round(sum(warm.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "rows": rows,
                "e1_rows_per_sec": round(rows / times["E1_geographic_analysis"]),
                "comments_1m": {"rows": comments, "stages": warm, "total": total, "rows_per_sec": round(comments / total)},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
