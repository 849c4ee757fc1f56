"""Synthetic comments for rare labels: templates filled with words, on metadata of unused rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glosa.operators.sampling import hash_order
from glosa.vocab.words import SYNTHETIC_TEMPLATES, SYNTHETIC_TOPICS, SYNTHETIC_WORDS


def _choose(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(index, F.lit(len(values))).cast("int"))


def fill(template: Column, slots: dict[str, Column]) -> Column:
    """Replaces every ``{slot}`` and capitalises the sentence."""
    for slot, word in slots.items():
        template = F.replace(template, F.lit("{" + slot + "}"), word)
    return F.concat(F.upper(F.substring(template, 1, 1)), F.lower(F.substr(template, F.lit(2))))


def sentence(label: str, seed: Column) -> Column:
    """One sentence for a label, chosen by an integer."""
    slots = {
        "topic": _choose(SYNTHETIC_TOPICS, F.floor(seed / 3)),
        "word": _choose(SYNTHETIC_WORDS[label], F.floor(seed / 2)),
    }
    return fill(_choose(SYNTHETIC_TEMPLATES[label], seed), slots)


def comments(unused: DataFrame, labels: list[str], per_label: int, emotions: list[str], key: str = "comment_id") -> DataFrame:
    """``per_label`` rows for each label on the first unused rows in hash order, with all label columns set."""
    need = per_label * len(labels)
    taken = unused.orderBy(hash_order(key), key).limit(need)
    # the rank runs over the few rows just taken
    place = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(hash_order(key), key)) - 1
    label = _choose(labels, F.col("_n"))
    numbered = taken.withColumn("_n", place).withColumn("emotion_label", label)
    text = F.coalesce(*[F.when(F.col("emotion_label") == x, sentence(x, F.col(key))) for x in labels])
    scores = {f"emotion_{e}": F.when(F.col("emotion_label") == e, 1.0).otherwise(0.0) for e in emotions}
    return numbered.withColumns({"original_comment": text, **scores}).drop("_n")
