"""The matrix of numbered texts and terms against the entries as rows, and what the topic queries leave on disk."""

import glob
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from glosa import session
from glosa.operators import term_blocks, topic_space
from glosa.plans import learn_queries

STOP = ["the", "und"]


def texts(n=150, seed=5):
    rng = random.Random(seed)
    words = [["goal", "match", "team", "Ball", "x"], ["soup", "salt", "über", "butter"], ["road", "日本", "engine", "brake", "der9"]]
    rows = [(i, " ".join(rng.choice(words[i % 3]) for _ in range(rng.randrange(1, 14))) + f", the rare{i}!") for i in range(n)]
    rows += [(7, "goal soup goal"), (7, "the match"), (None, "road goal"), (None, "brake road"), (900, ""), (901, None), (902, "the x")]
    return rows


def weights(rows):
    return {(r.id, r.number): r.weight for r in rows.collect()}


def as_rows(space):
    """(id, number, weight) of a space, in plain Python."""
    n = space.n_texts
    codes = sorted((c, d) for r in space.dealt.filter("block IS NULL").collect() for c, d in zip(r.codes, r.dfs))
    number = {c: k for k, (c, _) in enumerate(codes)}
    idf = {c: np.log((n + 1) / (d + 1)) for c, d in codes}
    own, keys = {}, {r.block: r["keys"] for r in space.texts.collect()}
    listed = {}
    for r in space.dealt.filter("block IS NULL").collect():
        listed.setdefault(r.part, {})[r.first] = r.codes
    listed = {p: [c for f in sorted(v) for c in v[f]] for p, v in listed.items()}
    for r in space.dealt.filter("block IS NOT NULL").collect():
        place = np.frombuffer(r.places, np.uint8)
        kinds = {1: np.uint8, 2: np.uint16, 4: np.uint32}
        term = np.cumsum(np.frombuffer(r.terms, kinds[len(r.terms) // len(place)]))
        for p, t, w in zip(place, term, np.frombuffer(r.weights, kinds[len(r.weights) // len(place)])):
            c = listed[r.part][t]
            own.setdefault(keys[r.block][p], {})[number[c]] = float(w) * idf[c]
    sizes = {k: np.sqrt(sum(w * w for w in v.values())) for k, v in own.items()}
    return {(k, t): w / sizes[k] for k, v in own.items() for t, w in v.items() if sizes[k] > 0}


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(texts(), "id long, t string").repartition(3)


def test_matrix_has_the_entries_of_the_dictionary(table, monkeypatch):
    """Same numbers and weights as from the terms as rows; repeated and null keys are one text, in one or many parts."""
    _, rows = topic_space.term_space(table, "id", "t", STOP)
    want = weights(rows)
    one = as_rows(topic_space.text_space(table, "id", "t", STOP))
    monkeypatch.setattr(term_blocks, "PART_WORDS", 60)
    monkeypatch.setattr(term_blocks, "BLOCK_TEXTS", 16)
    many = topic_space.text_space(table, "id", "t", STOP)
    assert len(want) > 500 and many.texts.count() > 5 and len(many.sizes) > 5
    for got in (one, as_rows(many)):
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_reduction_and_centres_of_the_matrix(spark, table):
    """The same dimensions and the same nearest means as from the entries as rows."""
    some = table.filter("id IS NOT NULL")
    got = {r.id: list(r)[1:] for r in topic_space.reduce(topic_space.text_space(some, "id", "t", STOP), "id", 3).collect()}
    _, own = topic_space.term_space(some, "id", "t", STOP)
    want = {r.id: list(r)[1:] for r in topic_space.reduce(own, "id", 3).collect()}
    assert len(want) > 100 and got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
    members = some.filter("id % 7 > 1").select("id", F.concat(F.lit("c"), F.col("id") % 4).alias("c"))
    centre = topic_space.centres(own, members, "id", "c")
    want = sorted(map(tuple, topic_space.nearest(own, centre, "id", "c").collect()))
    space = topic_space.text_space(some, "id", "t", STOP)
    got = sorted(map(tuple, topic_space.nearest(space, topic_space.centres(space, members, "id", "c"), "id", "c").collect()))
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-6)


def test_no_texts_and_no_members(spark):
    none = spark.createDataFrame([], "id long, t string")
    assert topic_space.reduce(topic_space.text_space(none, "id", "t", STOP), "id").collect() == []
    df = spark.createDataFrame([(1, "aa bb"), (2, "aa bb"), (3, "cc")], "id long, t string")
    space = topic_space.text_space(df, "id", "t", STOP)
    members = spark.createDataFrame([], "id long, c string")
    assert topic_space.nearest(space, topic_space.centres(space, members, "id", "c"), "id", "c").collect() == []


def test_columns_go_to_a_few_tasks_at_a_time(spark, table, monkeypatch):
    """A product of many tasks is made in turns, and a turn's columns are all that is on its way."""
    turns, write = [], term_blocks.kept
    monkeypatch.setattr(term_blocks, "PART_WORDS", 60)
    space = topic_space.text_space(table, "id", "t", STOP)
    once = {r.block: np.frombuffer(r.y) for r in term_blocks.product(space, 0).collect()}
    monkeypatch.setattr(term_blocks, "SIDE", 2)
    monkeypatch.setattr(term_blocks, "kept", lambda df, purpose, *a: turns.append(purpose) or write(df, purpose, *a))
    turned = {r.block: np.frombuffer(r.y) for r in term_blocks.product(space, 0, held=40).collect()}
    assert len(turns) == -(-len(space.tasks(40)) // 2) > 3
    assert once.keys() == turned.keys() and all(np.allclose(once[k], turned[k]) for k in once)


@pytest.mark.parametrize("query", [learn_queries.topic_summary, learn_queries.topic_assignment, learn_queries.nearest_centre])
def test_a_query_leaves_no_entries_behind(spark, query, monkeypatch, tmp_path):
    """Tables of all entries, all columns or all edges are removed when nothing reads them any more."""
    made = session.work_dir
    monkeypatch.setattr(session, "work_dir", lambda s, purpose: f"{tmp_path}/{os.path.basename(made(s, purpose))}")
    assert query(spark, "/root/testdata/sf0.001").count()
    large = {"term-entries", "cut-texts", "numbered-texts", "dealt-terms", "sums", "sketch", "orthonormal", "label-centres", "neighbours",
             "edges", "level-edges", "dictionary"}
    found = {x.rsplit("-", 1)[0] for x in os.listdir(tmp_path)}
    assert found and not found & large


def test_tidy_write_leaves_no_shuffle_files(spark, tmp_path):
    def files():
        top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {f for d in top for f in glob.glob(f"{d.getPath()}/*/shuffle_*")}

    before = files()
    rows = spark.range(1000).groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n"))
    found = session.written(rows, "tidy", None, True)
    until = time.time() + 10
    while (more := files() - before) and time.time() < until:
        time.sleep(0.2)
    assert not more and found.count() == 100
    session.discard(found)
    assert not os.path.exists(found._written_to)
