"""Operators against brute force on small tables, with hot keys and ties."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from glosa.operators import culture, evaluation, filters, geography, joins, quality, sampling, statistics
from glosa.vocab.words import EMOTIONS


def test_best_hit_takes_any_number_of_copies(spark):
    rows = [(i, "video_a", "Love from India 🇮🇳" if i % 3 == 0 else f"Hi from London {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "comment_id long, video string, original_comment string")
    best = {r.original_comment: r for r in geography.best_hits(df, keep_text=True).collect()}
    assert len(best) == 2001
    hot = best["Love from India 🇮🇳"]
    assert (hot.comment_id, hot.method, hot.confidence) == (0, "flag_emoji", 0.9)
    assert best["Hi from London 1"].method == "keyword"  # 0.8 twice: keyword before place


def test_cube_margins_are_sums_of_cells(spark):
    random.seed(1)
    rows = [
        ("v", 2016 + i % 3, random.choice(["India", "Brazil"]), random.random() < 0.3, random.choice(["joy", "fear", "unknown"]))
        for i in range(500)
    ]
    unified = spark.createDataFrame(rows, "video string, year int, country string, is_spam boolean, emotion string")
    cube = {(r.year, r.country, r.spam_mode, r.emotion_mode): r.n for r in geography.selection_cube(unified).collect()}
    for year in (2016, 2017, 2018):
        for country in ("India", "Brazil"):
            cells = [r for r in rows if r[1] == year and r[2] == country]
            assert cube[year, country, "All", "All"] == len(cells)
            assert cube[year, country, "Spam", "joy"] == sum(r[3] and r[4] == "joy" for r in cells)
    assert not any(k[3] == "unknown" for k in cube)


def test_cut_of_a_hot_class_is_exact(spark):
    import hashlib

    df = spark.range(3000).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)))
    df = df.unionByName(spark.range(5000, 5010).withColumn("g", F.lit(None).cast("string")))
    groups = defaultdict(list)
    for r in sampling.stratified_split(df, "g", "id", 0.3).collect():
        groups[r.g].append((hashlib.md5(str(r.id).encode()).hexdigest(), r.part))
    for members in groups.values():
        wanted = int(0.3 * len(members) + 0.5)
        assert [p for _, p in sorted(members)] == ["test"] * wanted + ["train"] * (len(members) - wanted)


def test_split_is_stratified(spark):
    df = spark.range(1000).withColumn("label", F.when(F.col("id") < 900, "a").otherwise("b"))
    counts = Counter((r.label, r.part) for r in sampling.stratified_split(df, "label", "id", 0.2).collect())
    assert counts == {("a", "test"): 180, ("a", "train"): 720, ("b", "test"): 20, ("b", "train"): 80}


def test_balanced_sample_is_whole_for_small_classes(spark):
    df = spark.range(1000).withColumn("label", F.when(F.col("id") < 990, "a").otherwise("b"))
    counts = Counter(r.label for r in sampling.balanced_sample(df, "label", "id", 50).collect())
    assert counts == {"a": 50, "b": 10}


@pytest.mark.parametrize("start,end", [(0, 5), (10, 400), (990, 2000), (5, 5)])
def test_row_range(spark, start, end):
    ids = sorted(random.Random(3).sample(range(10**9), 1000))
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(4)
    got = sorted(r.id for r in sampling.row_range(df, "id", start, end).collect())
    assert got == ids[start:end]


def test_row_range_with_outliers_and_missing_keys(spark):
    ids = [*range(500), 10**15, None, None, None]
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(4)
    for start, end in ((0, 2), (498, 502), (500, 600), (503, 504)):
        got = [r.id for r in sampling.row_range(df, "id", start, end).collect()]
        assert sorted(got, key=lambda i: (i is None, i or 0)) == ids[start:end]
    empty = spark.createDataFrame([(None,)] * 5, "id long")
    assert sampling.row_range(empty, "id", 0, 2).count() == 2 and sampling.row_range(empty, "id", 3, 9).count() == 2


def test_territories_are_countries(spark):
    texts = ["visit 🇵🇷 now", "love from Puerto Rico", "hi from Taiwan 🇹🇼", "Love from Hong Kong"]
    rows = [(i, "v", x, "joy", "not_spam") for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "comment_id long, video string, original_comment string, emotion_label string, spam_label string")
    df = df.withColumn("published_at", F.expr("TIMESTAMP_NTZ '2020-01-01 00:00:00'"))
    got = {r.comment_id: (r.country, r.source, r.emotion) for r in geography.unified_countries(df).collect()}
    assert got == {0: ("Puerto Rico", "flag", "joy"), 1: ("Puerto Rico", "text", "joy"),
                   2: ("Taiwan, Province of China", "flag", "joy"), 3: ("Hong Kong", "text", "joy")}
    own = geography.unified_countries(df, countries=[("PR", "PRI", "Boriken")]).collect()
    assert {r.comment_id: r.country for r in own} == {0: "Boriken"}


def test_trend_edges(spark):
    rows = [("up", f"20{y}", n) for y, n in zip(range(10, 20), range(10))]
    rows += [("flat", f"20{y}", 5) for y in range(10, 15)] + [("one", "2010", 3)] + [("down", "2010", 9), ("down", "2011", 1)]
    found = statistics.trend(spark.createDataFrame(rows, "k string, period string, n long"), ["k"]).collect()
    assert {r.k: r.trend for r in found} == {"up": "increasing", "flat": "stable", "one": "insufficient_data", "down": "decreasing"}


def test_shares_sum_to_100(spark):
    rows = [("v", e) for e in EMOTIONS[:3] for _ in range(3)] + [("v", None)] * 5
    dist = statistics.label_distribution(spark.createDataFrame(rows, "video string, label string"), "video", "label", EMOTIONS).collect()
    assert len(dist) == 7
    assert abs(sum(r.pct for r in dist) - 100) < 1e-4


def test_kappa(spark):
    rows = [("a", "a")] * 20 + [("a", "b")] * 5 + [("b", "a")] * 10 + [("b", "b")] * 15
    pairs = evaluation.pair_counts(spark.createDataFrame(rows, "x string, y string"), "x", "y")
    row = evaluation.cohen_kappa(pairs).first()
    assert (row.pairs, row.agreement, row.chance, row.kappa) == (50, 0.7, 0.5, 0.4)
    same = evaluation.pair_counts(spark.createDataFrame([("a", "a")] * 3, "x string, y string"), "x", "y")
    assert evaluation.cohen_kappa(same).first().kappa is None


def test_argmax_takes_the_first_of_equal_scores(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 0.2), (None, None)], "p double, q double")
    assert [r[0] for r in df.select(evaluation.argmax_label({"a": "p", "b": "q"})).collect()] == ["a", "b", None]


def test_precision_recall_equals_brute_force(spark):
    random.seed(5)
    rows = [(random.choice("ab"), round(random.random(), 2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "truth string, s double")
    got = {r.threshold: (r.precision, r.recall) for r in evaluation.precision_recall(df, "truth", {"a": "s"}, ["a"]).collect()}
    positives = sum(x == "a" for x, _ in rows)
    for threshold in {s for _, s in rows}:
        above = [x for x, s in rows if s >= threshold]
        tp = above.count("a")
        assert got[threshold] == pytest.approx((tp / len(above), tp / positives), abs=1e-6)


def test_confusion_keeps_empty_rows(spark):
    pairs = evaluation.pair_counts(spark.createDataFrame([("a", "b"), ("a", "a")], "x string, y string"), "x", "y")
    rows = {(r.truth, r.predicted): (r.n, r.share) for r in evaluation.confusion_matrix(pairs, ["a", "b"]).collect()}
    assert rows == {("a", "a"): (1, 0.5), ("a", "b"): (1, 0.5), ("b", "a"): (0, None), ("b", "b"): (0, None)}


def test_dictionary_match(spark):
    df = spark.createDataFrame([(1, "New York, new york! and (Paris)"), (2, "newyork"), (3, "a New-York")], "i long, t string")
    names = spark.createDataFrame([("New York",), ("Paris",), ("York",)], "entry string")
    got = {(r.i, r.entry) for r in joins.dictionary_match(df, "t", names, "entry").collect()}
    assert got == {(1, "New York"), (1, "Paris"), (1, "York"), (3, "York")}


def test_unused_rows(spark):
    df = spark.createDataFrame([(1, "en"), (2, "en"), (3, "fr"), (4, None)], "id long, detected_language string")
    used = spark.createDataFrame([(1,)], "id long")
    assert [r.id for r in joins.unused(df, used, "id").collect()] == [2]


def quality_score(spark, rows):
    df = spark.createDataFrame(rows, "original_comment string, published_at string, spam_label string, emotion_label string")
    return quality.scored(quality.metrics(df, F.expr("TIMESTAMP_NTZ '2026-01-01 00:00:00'"))).first()


def test_quality_scores_of_the_known_runs(spark):
    good = [(f"a fine comment {i}", f"20{10 + i % 10}-03-01T00:00:00Z", "spam", "joy") for i in range(40)]
    warn = [("x", "2015-01-01T00:00:00Z", "spam", "joy"), ("y " * 600, "2015-01-02T00:00:00Z", "spam", "joy"),
            ("wooooooow yes", "2015-01-03T00:00:00Z", "spam", "joy")]
    assert quality_score(spark, good).quality_score == 100.0
    nonalpha = [("12345678 !", "2015-01-04T00:00:00Z", "spam", "joy")]
    assert quality_score(spark, good + warn + nonalpha).quality_score == 88.0
    assert quality_score(spark, good + warn + good[:3]).quality_score == 81.0
    row = quality_score(spark, good + good[:3])
    assert (row.duplicates, row.quality_score) == (3, 90.0)


def test_kept_and_removed_add_up(spark):
    df = spark.createDataFrame([("a",), (None,), ("abc",)], "t string")
    row = filters.removal_report(df, F.length("t") >= 3).first()
    assert (row.total, row.kept, row.removed) == (3, 1, 2)


def test_culture_steps(spark):
    rows = [
        (1, "proud latino"), (2, "half asian, our tradition, proud"), (3, "God bless my muslim family"),
        (4, "i pray in the temple near the mosque"), (5, "nothing here"),
    ]
    df = spark.createDataFrame(rows, "comment_id long, original_comment string")
    got = {r.comment_id: r for r in culture.signals(df).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert (got[1].ethnic_method, round(got[1].ethnic_confidence, 6), got[1].ethnic_matches) == ("keyword+context", 0.9, "latino")
    assert (got[2].ethnic_method, got[2].collective_method) == ("keyword+context", "pattern")
    assert got[2].n_categories == 2
    assert (got[4].religious_method, got[4].religious_matches) == ("pattern+context", "patterns: 3")
    assert round(got[4].religious_confidence, 6) == 1.0


def test_top_values_and_profile(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "c string, n long")
    rows = {r.column: (r.rows, r.nulls, r.distinct_values) for r in quality.profile(df).collect()}
    assert rows == {"c": (4, 1, 2), "n": (4, 0, 4)}
    assert [(r.value, r.n) for r in quality.top_values(df, ["c"]).orderBy("place").collect()] == [("a", 2), ("b", 1)]
