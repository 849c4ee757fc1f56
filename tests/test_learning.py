"""Classifiers, sentiment and topics on small tables with a known answer."""

import math

import pytest
from pyspark.sql import functions as F

from glosa.operators import learning, sentiment, topics
from glosa.functions import text as T


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, f"subscribe channel free money {i}" if i % 2 else f"lovely melody memory song {i}", float(i % 2)) for i in range(60)]
    return spark.createDataFrame(data, "comment_id long, text string, label double")


@pytest.mark.parametrize("kind", ["logistic", "bayes"])
def test_separable_spam(spark, rows, kind):
    model = learning.fit(learning.spam_pipeline(kind, bigrams=kind == "logistic"), rows)
    df = rows.withColumnRenamed("text", "original_comment")
    assert learning.predict_spam(model, df).filter("is_spam_prediction <> label").count() == 0


def test_emotion_scores_sum_to_one(spark):
    data = [(i, ["so happy joy", "afraid of dark", "what a surprise"][i % 3], ["joy", "fear", "surprise"][i % 3]) for i in range(30)]
    df = spark.createDataFrame(data, "comment_id long, text string, emotion_label string")
    model = learning.fit(learning.emotion_pipeline(["joy", "fear", "surprise"]), df)
    scored = learning.score_emotions(model, spark.createDataFrame([(1, "afraid dark"), (2, " ")], "i long, original_comment string"))
    got = {r.i: r for r in scored.collect()}
    assert got[1].emotion == "fear" and got[2].emotion == "unknown"
    assert abs(got[1].emotion_joy + got[1].emotion_fear + got[1].emotion_surprise - 1) < 1e-3


def test_grid_and_curve(spark, rows):
    _, table = learning.grid_search(rows)
    assert table.count() == 16 and table.filter("f1 > 0.9").count() > 0
    curve = {(r.classifier, r.share): r for r in learning.learning_curve(rows, shares=(0.6, 1.0), folds=2).collect()}
    assert set(curve) == {(k, s) for k in ("logistic", "bayes") for s in (0.6, 1.0)}
    whole = curve["bayes", 1.0]
    assert whole.rows == 30 and whole.train_mean > 0.9 and whole.validation_mean > 0.9


def test_features_see_training_rows_only(spark, rows):
    train, held = learning.featurized(rows.filter("comment_id < 40"), rows.filter("comment_id >= 40"))
    # numbers from 40 on occur in held-out texts alone, so they have no column of their own
    size = train.first().features.size
    assert held.first().features.size == size == 8 + 30


def test_sentiment_equals_hand_computed_bayes(spark):
    prior, odds = sentiment.weights()
    assert abs(prior - math.log(8 / 7)) < 1e-12
    df = spark.createDataFrame([(1, "I LOVE, love it!"), (2, "terrible waste"), (3, "")], "i long, original_comment string")
    got = {r.i: r for r in sentiment.scored(df).collect()}
    x = prior + 2 * odds["love"] + odds["it"]
    assert got[1].p_positive == round(1 / (1 + math.exp(-x)), 6) and got[1].sentiment == "positive"
    assert got[2].sentiment == "negative" and got[3].p_positive == round(8 / 15, 6)


def test_class_tfidf_equals_the_formula(spark):
    df = spark.createDataFrame([("a", "xx xx yy"), ("b", "yy zz zz zz the")], "topic string, t string")
    rows = {(r.topic, r.word): r.weight for r in topics.class_tfidf(df, "topic", T.clean(F.col("t"), " "), ["the"]).collect()}
    assert rows[("a", "xx")] == pytest.approx(2 / 3 * math.log(1 + 3.5 / 2))
    assert rows[("b", "yy")] == pytest.approx(1 / 4 * math.log(1 + 3.5 / 2))


def test_similarity_has_every_ordered_pair(spark):
    words = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 1.0), ("b", "y", 1.0), ("c", "z", 1.0)], "topic string, word string, weight double")
    pairs = {(r.topic_a, r.topic_b): r.jaccard for r in topics.similarity(words, "topic", ["a", "b", "c"]).collect()}
    assert len(pairs) == 6 and pairs["a", "b"] == 0.5 and pairs["a", "c"] == 0.0


def test_spam_rows_are_read_anew(spark, tmp_path):
    from glosa.plans import learn_queries

    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    before = {r.comment_id for r in learn_queries.spam_rows(spark, str(tmp_path)).collect()}
    half = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id % 2 = 0")
    half.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    after = {r.comment_id for r in learn_queries.spam_rows(spark, str(tmp_path)).collect()}
    assert after and after < before


def test_words_are_those_of_the_ml_stages(spark):
    from pyspark.ml.feature import NGram, RegexTokenizer, StopWordsRemover

    texts = ["I'm The cat, a cat SAT", "", "x", "\U0001d400 a \U0001f600 x_y 12 3 İstanbul ΣΑΣ STRASSE don't", "  both  of them ran home "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    cut = RegexTokenizer(inputCol="text", outputCol="_tokens", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=2).transform(df)
    cut = StopWordsRemover(inputCol="_tokens", outputCol="_words").transform(cut)
    plain = {r.text: r for r in NGram(n=2, inputCol="_words", outputCol="_pairs").transform(cut).collect()}
    for bigrams in (False, True):
        got = learning.features(bigrams=bigrams)[0].transform(df).collect()
        assert all(r._terms == plain[r.text]._words + (plain[r.text]._pairs if bigrams else []) for r in got)


def test_texts_are_cut_once_for_training(spark, rows, monkeypatch):
    """However many folds and shares, the texts are read for one table of terms; the rest reads counts."""
    purposes, write = [], learning.written
    monkeypatch.setattr(learning, "written", lambda df, purpose, *a: purposes.append((purpose, df.columns)) or write(df, purpose, *a))
    learning.learning_curve(rows, shares=(0.6, 1.0), folds=2)
    assert [p for p, _ in purposes].count("terms") == 1 and not any("text" in columns for _, columns in purposes)
    purposes.clear()
    learning.fit(learning.spam_pipeline(), rows)
    assert [columns for _, columns in purposes] == [["_terms", "label"], ["_tf", "label"]]
