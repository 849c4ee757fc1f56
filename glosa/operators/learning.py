"""Text classifiers on MLlib: training, scoring, search, learning curve."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import (
    IDF, CountVectorizer, SQLTransformer, StopWordsRemover, StringIndexer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosa.operators.sampling import hash_order, stratified_split
from glosa.session import written

MAX_TERMS = 5000


def words_sql(text: str, bigrams: bool = False) -> str:
    """SQL for the lower-cased words of two UTF-16 units or more without English stop words, then their pairs."""
    stop = [w for w in StopWordsRemover.loadDefaultStopWords("english") if w.isalnum()]
    listed = ", ".join(f"'{w}'" for w in stop)
    kept = "(length(w) >= 2 OR octet_length(w) = 4) AND w NOT IN (" + listed + ")"
    words = rf"filter(split(lower({text}), '[^\\p{{L}}\\p{{N}}_]+'), w -> {kept})"
    if not bigrams:
        return words
    after = "slice(ws, 2, greatest(size(ws) - 1, 0))"
    pairs = f"zip_with(slice(ws, 1, greatest(size(ws) - 1, 0)), {after}, (a, b) -> concat(a, ' ', b))"
    return f"flatten(transform(array({words}), ws -> concat(ws, {pairs})))"


def features(text: str = "text", bigrams: bool = False, max_terms: int = MAX_TERMS) -> list:
    """Words of two or more letters without English stop words, TF-IDF over the most frequent terms."""
    return [
        SQLTransformer(statement=f"SELECT *, {words_sql(text, bigrams)} AS _terms FROM __THIS__"),
        CountVectorizer(inputCol="_terms", outputCol="_tf", vocabSize=max_terms),
        IDF(inputCol="_tf", outputCol="features"),
    ]


def classifier(kind: str, **settings):
    """Logistic regression or multinomial naive Bayes on ``features``."""
    if kind == "logistic":
        return LogisticRegression(**{"maxIter": 100, "regParam": 0.01, **settings})
    return NaiveBayes(modelType="multinomial", smoothing=1.0)


def spam_pipeline(kind: str = "logistic", bigrams: bool = False) -> Pipeline:
    """``label`` 1.0 = spam from ``text``; logistic regression or multinomial naive Bayes."""
    return Pipeline(stages=[*features(bigrams=bigrams), classifier(kind)])


def emotion_pipeline(labels: list[str]) -> Pipeline:
    """``emotion_label`` from ``text``, multinomial logistic regression, label names in the output."""
    index = StringIndexer(inputCol="emotion_label", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip")
    return Pipeline(stages=[index, *features(), LogisticRegression(maxIter=50, regParam=0.01)])


def fit(pipeline: Pipeline, train: DataFrame) -> PipelineModel:
    """Fits stage by stage: texts are cut into terms once and counted once; what later passes read is written.

    IDF and classifier read sparse counts, so the rounds of an optimiser never go back to the texts.
    """
    fitted, rows = [], train
    for stage in pipeline.getStages():
        model = stage.fit(rows) if isinstance(stage, Estimator) else stage
        fitted.append(model)
        rows = model.transform(rows)
        made = {SQLTransformer: "_terms", CountVectorizer: "_tf"}.get(type(stage))
        if made:
            rows = written(rows.select(made, *[c for c in ("label", "emotion_label") if c in rows.columns]), "training")
    return PipelineModel(fitted)


def predict_spam(model: PipelineModel, df: DataFrame, text: str = "original_comment") -> DataFrame:
    """Adds ``is_spam_prediction`` (0/1) and ``spam_score``; a missing text counts as empty."""
    scored = model.transform(df.withColumn("text", F.coalesce(text, F.lit(""))))
    return scored.select(
        *df.columns, F.col("prediction").cast("int").alias("is_spam_prediction"),
        F.round(vector_to_array("probability")[1], 6).alias("spam_score"),
    )


def score_emotions(model: PipelineModel, df: DataFrame, text: str = "original_comment") -> DataFrame:
    """Adds one score per emotion, rounded to four places, and the most probable ``emotion``."""
    labels = model.stages[0].labels
    scorer = PipelineModel(stages=model.stages[1:])
    scored = scorer.transform(df.withColumn("text", F.coalesce(text, F.lit(""))))
    probability = vector_to_array("probability")
    names = F.array(*[F.lit(x) for x in labels])
    empty = F.trim("text") == ""
    return scored.select(
        *df.columns,
        *[F.round(probability[i], 4).alias(f"emotion_{x}") for i, x in enumerate(labels)],
        F.when(empty, "unknown").otherwise(F.get(names, F.col("prediction").cast("int"))).alias("emotion"),
    )


def cut(rows: DataFrame, *keep: str) -> DataFrame:
    """The terms of each text and the columns to keep, written: what features are fitted on, again and again."""
    return written(features()[0].transform(rows).select("_terms", *keep), "terms")


def featurized(train: DataFrame, *others: DataFrame) -> list[DataFrame]:
    """label and TF-IDF features of each table, the feature stages fitted on ``train`` alone; counts are written once.

    Tables with ``_terms`` have been cut into terms before.
    """
    to_terms, counter, idf = features()
    tables = [t if "_terms" in t.columns else to_terms.transform(t) for t in (train, *others)]
    vocabulary = counter.fit(tables[0])
    counted = [written(vocabulary.transform(t).select("label", "_tf"), "term-frequencies") for t in tables]
    weights = idf.fit(counted[0])
    return [weights.transform(t).select("label", "features") for t in counted]


def measured(model, rows: DataFrame, metric: str) -> float:
    return round(float(MulticlassClassificationEvaluator(metricName=metric).evaluate(model.transform(rows))), 6)


def side_by_side(spark, work, items: list, at_once: int = 4) -> list:
    """``work(item)`` for all items, a few Spark jobs at a time."""
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), items))


def grid_search(rows: DataFrame, key: str = "comment_id"):
    """Sixteen settings; the one with the best weighted F1 on a held-out fifth of ``rows`` (text, label).

    The features are fitted on the other four fifths alone.
    """
    split = cut(stratified_split(rows, "label", key, 0.2), "label", "part")
    train, held = featurized(split.filter("part = 'train'"), split.filter("part = 'test'"))
    grid = [
        {"regParam": reg, "elasticNetParam": net, "maxIter": rounds}
        for reg in (0.001, 0.01, 0.1, 1.0) for net in (0.0, 0.5) for rounds in (20, 50)
    ]

    def fit_one(settings: dict):
        model = classifier("logistic", **settings).fit(train)
        return model, measured(model, held, "f1")

    fitted = side_by_side(rows.sparkSession, fit_one, grid)
    best = max(fitted, key=lambda f: f[1])[0]
    table = [(float(g["regParam"]), g["elasticNetParam"], float(g["maxIter"]), f1) for g, (_, f1) in zip(grid, fitted)]
    return best, rows.sparkSession.createDataFrame(table, "reg double, elastic_net double, max_iter double, f1 double")


def learning_curve(
    rows: DataFrame, shares=(0.1, 0.325, 0.55, 0.775, 1.0), folds: int = 5, kinds=("logistic", "bayes"), key: str = "comment_id"
) -> DataFrame:
    """Accuracy on training and validation rows by classifier and share of the training rows.

    Rows (text, label) fall into folds and shares by their hashed key.  Every fold and share fits its features on its own
    training rows alone.
    """
    spark, order = rows.sparkSession, hash_order(key)

    def digits(first: int):
        return F.conv(F.substring(order, first, 8), 16, 10).cast("double") / float(2**32)

    dealt = rows.select("text", "label", F.floor(digits(1) * folds).alias("_fold"), digits(9).alias("_place"))
    dealt = cut(dealt, "label", "_fold", "_place")

    def one(item) -> list[tuple]:
        share, fold = item
        used = dealt.filter((F.col("_fold") != fold) & (F.col("_place") < share))
        train, held = featurized(used, dealt.filter(F.col("_fold") == fold))
        n, out = train.count(), []
        for kind in kinds:
            model = classifier(kind, maxIter=20).fit(train)
            out.append((kind, float(share), fold, n, measured(model, train, "accuracy"), measured(model, held, "accuracy")))
        return out

    found = side_by_side(spark, one, [(s, f) for s in shares for f in range(folds)])
    schema = "classifier string, share double, fold int, rows long, train double, validation double"
    each = spark.createDataFrame([row for part in found for row in part], schema)
    return each.groupBy("classifier", "share").agg(
        F.avg("rows").cast("long").alias("rows"),
        *[F.round(f(c), 6).alias(f"{c}_{n}") for c in ("train", "validation") for n, f in (("mean", F.avg), ("sd", F.stddev_pop))],
    )
