"""Scalar functions on literal rows: null, empty, accents, emoji, ties."""

import random
import re

from pyspark.sql import functions as F

from glosa.functions import emoji, geo, language, spam
from glosa.functions import text as T
from glosa.functions.patterns import contains_any, contains_word, occurrences
from glosa.vocab import words as vocab


def values(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def test_clean_text(spark):
    rows = ["See http://x.io/a NOW!!  Café  ñ", "", None, "www.foo.com only"]
    assert values(spark, rows, T.clean) == ["see now café ñ", "", None, "only"]


def test_emotion_input(spark):
    assert values(spark, ["Hey @bob, WOW 100% ✨"], T.emotion_input) == ["hey  wow 100"]


def test_words_strip_edge_punctuation_only(spark):
    rows = ["'Hello,' it's --- Él! (a.b)", "", "..."]
    assert values(spark, rows, T.words) == [["hello", "it's", "él", "a.b"], [], []]
    assert values(spark, ["I am é ok"], lambda c: T.words(c, 2)) == [["am", "ok"]]


def test_metrics(spark):
    rows = ["aaa bb aaa", "", "SOOOO"]
    assert values(spark, rows, lambda c: T.average_word_length(T.words(c)))[:2] == [8 / 3, 0.0]
    assert values(spark, rows, lambda c: T.lexical_diversity(T.words(c)))[:2] == [2 / 3, 0.0]
    assert values(spark, rows, T.uppercase_share) == [0.0, 0.0, 1.0]
    assert values(spark, ["aaabbbb\n\n\n\ncc", "çççç"], T.repeated_runs) == [2, 1]


def test_case_folding_and_edges(spark):
    rows = ["VIVA ESPAÑA", "perú!", "perúx", None]
    assert values(spark, rows, lambda c: contains_word(c, ["España", "Perú"])) == [True, True, False, False]
    assert values(spark, ["caucasian", None], lambda c: contains_any(c, ["Asian"])) == [True, False]
    assert values(spark, ["aaaa", "christ christian"], lambda c: occurrences(c, "aa")) == [2, 0]


def test_emoji(spark):
    rows = ["hi ❤️👍🏽 ok", "none", "🇹🇷x"]
    assert values(spark, rows, emoji.extract) == ["❤👍🏽", "", ""]
    assert values(spark, rows[:2], emoji.remove) == ["hi ️ ok", "none"]
    assert values(spark, ["❤👍🏽", ""], emoji.name_text) == [":red_heart::thumbs_up_medium_skin_tone:", ""]
    assert values(spark, ["a🇹🇷🇮🇳 🇧🇷"], lambda c: emoji.flag_names(emoji.flags(c))) == [["Turkey", "India", "Brazil"]]
    assert values(spark, ["🇲🇽"], lambda c: emoji.flag_names(emoji.flags(c))) == [["Unknown_🇲🇽"]]


def test_geographic_confidence(spark):
    rows = ["Hi from Turkey", "sending love from me", "hi", "love from"]
    assert [round(v, 6) for v in values(spark, rows, geo.keyword_confidence)] == [0.8, 0.9, 0.3, 0.6]
    rows = ["in London, PARIS", "usa", "nowhere"]
    assert values(spark, rows, geo.locations) == [["London", "PARIS"], ["usa"], []]
    scores = values(spark, rows, lambda c: geo.location_confidence(geo.locations(c)))
    assert [round(v, 6) for v in scores] == [0.9, 0.6, 0.0]


def test_country_of_text(spark):
    rows = ["from England to Japan", "U.S.A and Kenya", "the U.S. army", "guinea-bissau", "Niger", "Nigeria", "x"]
    assert values(spark, rows, geo.country_of_text) == [
        "United Kingdom", "United States", None, "Guinea", "Niger", "Nigeria", None,
    ]


def test_topic_and_truncate(spark):
    assert values(spark, ["San JUAN!", "x", None], lambda c: T.topic_flag(c, miss=-1)) == [1, -1, -1]
    assert values(spark, ["abcdef", "abc", None], lambda c: T.truncate(c, 3)) == ["abc...", "abc", ""]


def test_language(spark):
    df = spark.createDataFrame([(1, "the cat and the dog of it"), (2, "que los gatos y las casas"), (3, "zzz")], "i long, t string")
    found = {r.i: r.language for r in language.detect(df, "t").collect()}
    assert found == {1: "en", 2: "es", 3: "und"}


REPEATED = re.compile(r"(.+?)\.\s+\1\.")


def test_repeated_sentence_equals_the_pattern(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice("ab. \n") for _ in range(rng.randint(0, 24))) for _ in range(6000)]
    texts += ["".join(rng.choice("ab. ") for _ in range(60)) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.found for r in rows.select("i", spam.repeated_sentence(F.col("text")).alias("found")).collect()}
    assert [got[i] for i in range(len(texts))] == [bool(REPEATED.search(x)) for x in texts]


def brute_force_keeps(text, year):
    if len(text.strip()) < 3:
        return False
    low = text.lower()
    words = vocab.SPAM_COMMON + [w.lower() for w in vocab.SPAM_BY_YEAR.get(year, [])]
    return not (
        any(w in low for w in words)
        or re.search(r"(.)\1{3,}", low)
        or re.search(r"\b(\w+)\s+\1\b", low)
        or REPEATED.search(low)
    )


def test_rule_filter_equals_brute_force(spark):
    texts = [
        "what a nice tune", "soooo nice", "good good day", "very nice. very nice. ok", "subscribe now", "  a ", "ok",
        "covid days", "Vaccine is here", "éé nice", "one. two. one. two.", "timeless?", "calm\n\n\n\ncalm", "été été",
    ]
    rows = [(i, t, y) for i, (t, y) in enumerate((t, y) for t in texts for y in (2016, 2020, 2021, 2025))]
    df = spark.createDataFrame(rows, "i long, original_comment string, year int")
    kept = {r.i: r.cleaned for r in spam.rule_filter(df, year=F.col("year")).collect()}
    assert kept == {i: t.lower() for i, t, y in rows if brute_force_keeps(t, y)}


def test_rule_filter_on_whole_documents(spark):
    from glosa.plans import views

    c = views.comments(spark, "/root/testdata/sf0.001", labelled=False).withColumn("y", F.year("published_at"))
    rows = c.select("comment_id", "original_comment", "y").collect()
    kept = {r.comment_id for r in spam.rule_filter(c, year=F.col("y")).collect()}
    assert kept == {r.comment_id for r in rows if brute_force_keeps(r.original_comment, r.y)}


def test_long_runs_take_linear_time(spark):
    """Texts that make careless patterns quadratic or recursive."""
    n = 200_000
    texts = ["漢" * n, "!" * n + "a", " " * n + "a b" + " " * n + "c", "a漢" * n, "no. " * 2000 + "x", "." * 3000, "x" * n, "é! " * n]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").repartition(8)
    t = F.col("t")
    sizes = df.select(
        "i", F.length(emoji.extract(t)).alias("e"), F.length(emoji.remove(t)).alias("r"), F.size(T.words(t)).alias("w"),
        F.length(T.strip(t)).alias("s"), F.length(T.clean(t)).alias("c"), T.repeated_runs(t).alias("runs"),
        spam.repeated_word(t).alias("rw"), spam.letter_run(t).alias("lr"), F.size(geo.locations(t)).alias("l"),
        spam.repeated_sentence(t).alias("rs"),
    )
    rows = {r.i: r for r in sizes.collect()}
    assert rows[0].e == 0 and rows[0].r == n and rows[3].w == 1
    assert rows[1].w == 1 and rows[2].w == 3 and rows[2].s == n + 4
    assert rows[4].rs and not rows[5].rs and rows[6].runs == 1


def test_travel_texts_compute_each_step_once(spark):
    df = spark.createDataFrame([(1, "Visit 🏖 now http://x.io"), (2, "nothing"), (3, None), (4, "tra-vel!")], "id long, t string")
    found = T.travel_texts(df, F.col("t"), "cleaned")
    assert {r.id for r in found.collect()} == {1, 4}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(T.URL) == 2  # once before spelling, once in the cleaning
