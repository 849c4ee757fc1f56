"""Term space, reduction, sparse k-means, density clusters and the dictionary index against plain versions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glosa.functions import membership
from glosa.operators import density, joins, languages, topic_space


def subjects(n=60):
    rng = random.Random(3)
    words = [["goal", "match", "team", "player", "ball"], ["soup", "salt", "oven", "butter", "sugar"], ["road", "wheel", "engine", "brake"]]
    return [(i, " ".join(rng.choice(words[i % 3]) for _ in range(12)) + f" rare{i}") for i in range(n)]


@pytest.fixture(scope="module")
def space(spark):
    df = spark.createDataFrame(subjects(), "id long, t string")
    return topic_space.term_space(df, "id", "t", ["the"])


def matrix(space):
    terms, entries = space
    out = np.zeros((60, terms.count()))
    for r in entries.collect():
        out[r.id, r.number] = r.weight
    return out


def test_terms_are_words_and_pairs(spark):
    df = spark.createDataFrame([("The cat, a cat SAT",), ("",), (None,), ("x",)], "t string")
    got = [r.x for r in df.select(topic_space.terms_of(F.col("t"), ["the"]).alias("x")).collect()]
    assert got == [["cat", "cat", "sat", "cat cat", "cat sat"], [], None, []]


def test_dictionary_is_numbered_in_order(space):
    rows = sorted(space[0].collect(), key=lambda r: r.number)
    assert [r.number for r in rows] == list(range(len(rows)))
    assert [r.term for r in rows] == sorted(r.term for r in rows)
    assert not any("rare" in r.term for r in rows)  # in one text only
    assert all(abs(r.idf - math.log(61 / (r.df + 1))) < 1e-12 for r in rows)


def test_entries_have_unit_length(space):
    assert np.allclose((matrix(space) ** 2).sum(axis=1), 1)


def test_reduction_spans_the_singular_directions(space):
    a = matrix(space)
    rows = topic_space.reduce(space[1], "id", dimensions=3, steps=6).collect()
    got = np.zeros((60, 3))
    for r in rows:
        got[r.id] = [r.x0, r.x1, r.x2]
    u, sizes, _ = np.linalg.svd(a, full_matrices=False)
    want = u[:, :3] * sizes[:3]
    assert np.allclose(np.abs((got * want).sum(axis=0)) / (want**2).sum(axis=0), 1, atol=1e-3)
    assert np.allclose(got.T @ got, np.diag(sizes[:3] ** 2), atol=1e-2)


def test_nearest_centre_by_hand(space):
    a = matrix(space)
    members = space[1].select("id").distinct().withColumn("cluster", F.col("id") % 4)
    centre = topic_space.centres(space[1], members, "id", "cluster")
    got = {r.id: (r.cluster, r.distance) for r in topic_space.nearest(space[1], centre, "id", "cluster").collect()}
    means = np.stack([a[np.arange(60) % 4 == k].mean(axis=0) for k in range(4)])
    apart = np.sqrt(((a[:, None] - means[None]) ** 2).sum(axis=2))
    for i in range(60):
        assert got[i][0] == apart[i].argmin() and abs(got[i][1] - apart[i].min()) < 1e-4


def test_sparse_k_means_separates_subjects(space):
    got = topic_space.k_means(space[1], "id", 6).collect()
    own = defaultdict(Counter)
    for r in got:
        own[r.cluster][r.id % 3] += 1
    assert len(got) == 60 and sum(max(c.values()) for c in own.values()) >= 54


# --- density ----------------------------------------------------------------------------------
NAMES = ["x0", "x1", "x2"]


def blobs(n=600, seed=1):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(4, 3)) * 6
    rows = [(i, *map(float, at[i % 4] + rng.normal(size=3) * (0.3 + 0.2 * (i % 4)))) for i in range(n)]
    rows += [(n + i, *map(float, rng.uniform(-15, 15, 3))) for i in range(n // 10)]
    rows += [(2 * n + i, 1.0, 1.0, 1.0) for i in range(30)]  # copies of one place
    return rows


def test_neighbours_are_mostly_the_nearest(spark):
    rows = blobs(1500)
    points, _ = density.distinct_points(spark.createDataFrame(rows, "id long, x0 double, x1 double, x2 double"), "id", NAMES)
    found = defaultdict(set)
    for r in density.neighbours(points, NAMES, 10).collect():
        found[r.a].add(r.b)
    own = {r.point: np.array([r.x0, r.x1, r.x2]) for r in points.collect()}
    ids = sorted(own)
    x = np.stack([own[i] for i in ids])
    hits = 0
    for k, i in enumerate(ids):
        near = np.argsort(((x - x[k]) ** 2).sum(axis=1), kind="stable")
        hits += len({ids[j] for j in near if j != k and len(near)} & found[i] & {ids[j] for j in [j for j in near if j != k][:10]})
    assert hits >= 0.9 * 10 * len(ids) and all(len(v) <= 10 for v in found.values())


def plain_clusters(weights, edges, cuts, min_size):
    """{point: cluster number or -1}: the hierarchy of components by union of sets, branches chosen by recursion."""
    levels = []
    for cut in cuts:
        root = {p: p for p in weights}

        def top(p, root=root):
            while root[p] != p:
                p = root[p]
            return p

        for a, b, w in edges:
            if w <= cut:
                ra, rb = sorted((top(a), top(b)))
                root[rb] = ra
        groups = defaultdict(set)
        for p in weights:
            groups[top(p)].add(p)
        levels.append([g for g in groups.values() if sum(weights[p] for p in g) >= min_size])
    dense = [1 / c for c in cuts] + [0.0]

    def size(g):
        return sum(weights[p] for p in g)

    def branch(level, g):
        """(sum of the branch that ends here, best of what is below it, its clusters)."""
        mass = size(g) * (dense[level] - dense[level + 1])
        parts = [branch(level - 1, h) for h in levels[level - 1] if h <= g] if level else []
        if len(parts) == 1:
            chain, below, chosen = parts[0]
            return mass + chain, below, chosen
        best = [(chain, [h]) if chain >= below else (below, chosen) for (chain, below, chosen), h in
                zip(parts, [h for h in (levels[level - 1] if level else []) if h <= g])]
        return mass, sum(b for b, _ in best), [h for _, c in best for h in c]

    out = []
    for g in levels[-1]:
        chain, below, chosen = branch(len(cuts) - 1, g)
        whole = size(g) == sum(weights.values())
        out += [g] if chain >= below and not whole else chosen
    return out


def test_clusters_equal_the_plain_version(spark):
    rows = spark.createDataFrame(blobs(), "id long, x0 double, x1 double, x2 double").repartition(3)
    points, members = density.distinct_points(rows, "id", NAMES)
    near = density.neighbours(points, NAMES, 10)
    edges = density.reachability(points, near, 10)
    cuts = density.thresholds(edges)
    weights = {r.point: r.n for r in points.collect()}
    # core and reachability distances
    own = defaultdict(list)
    for r in near.collect():
        own[r.a].append((r.d, r.b, r.n_b))
    core = {}
    for a, listed in own.items():
        total, core[a] = weights[a], max(d for d, _, _ in listed)
        if total >= 10:
            core[a] = 0.0
            continue
        for d, _, n in sorted(listed):
            total += n
            if total >= 10:
                core[a] = d
                break
    want = {}
    for a, listed in own.items():
        for d, b, _ in listed:
            want[min(a, b), max(a, b)] = max(d, core[a], core[b])
    got = {(r.lo, r.hi): r.w for r in edges.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    # clusters
    chosen = plain_clusters(weights, [(a, b, w) for (a, b), w in want.items()], cuts, 15)
    chosen = sorted(chosen, key=lambda g: -sum(weights[p] for p in g))
    found = density.clusters(rows, "id", NAMES)
    topic = {r.id: r.topic for r in found.collect()}
    point = {r.id: r.point for r in members.collect()}
    sizes = Counter(t for t in topic.values() if t >= 0)
    assert len(topic) == 690 and [sizes[k] for k in range(len(sizes))] == [sum(weights[p] for p in g) for g in chosen]
    groups = {frozenset(i for i in topic if point[i] in g) for g in chosen}
    assert groups == {frozenset(i for i in topic if topic[i] == k) for k in sizes}
    assert len(chosen) >= 4
    scored = found.agg(F.min("topic_probability").alias("lo"), F.max("topic_probability").alias("hi")).first()
    assert scored.lo == 0.0 and scored.hi == 1.0


def test_no_points_and_one_place(spark):
    schema = "id long, x0 double, x1 double, x2 double"
    assert density.clusters(spark.createDataFrame([], schema), "id", NAMES).collect() == []
    same = density.clusters(spark.createDataFrame([(i, 1.0, 2.0, 3.0) for i in range(40)], schema), "id", NAMES)
    assert {r.topic for r in same.collect()} == {-1}


# --- dictionary index -------------------------------------------------------------------------
def test_filters_never_miss(spark):
    values = spark.range(5000).select(F.concat(F.lit("v"), "id").alias("v"))
    bloom = membership.filters(values, {"v": F.col("v")})["v"]
    asked = spark.range(20000).select(F.concat(F.lit("v"), "id").alias("v"), (F.col("id") < 5000).alias("own"))
    passed = asked.filter(membership.may_contain(bloom, F.col("v"))).groupBy("own").count().collect()
    counts = {r.own: r["count"] for r in passed}
    assert counts[True] == 5000 and counts.get(False, 0) < 600


def test_large_dictionary(spark):
    rng = random.Random(8)
    names = [f"name{k} part{k % 700}" if k % 3 else f"single{k}" for k in range(100_000)]
    texts = []
    for i in range(200):
        own = [f"word{rng.randrange(50)}" for _ in range(30)]
        own[rng.randrange(30)] = rng.choice(names).upper()
        own[rng.randrange(30)] = "name5 part6"  # first word and second word of different entries
        texts.append((i, " ".join(own) + rng.choice(["", ".", "!", " " + rng.choice(names) + ","])))
    texts += [(900, None), (901, ""), (902, "...")]
    df = spark.createDataFrame(texts, "id long, t string")
    entries = spark.createDataFrame([(n,) for n in names], "entry string")
    got = joins.dictionary_match(df, "t", entries, "entry")
    known = set(names)
    want = set()
    for i, text in texts:
        words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
        low = (text or "").lower()
        want |= {(i, w) for w in words if w in known}
        want |= {(i, f"{a} {b}") for a, b in zip(words, words[1:]) if f"{a} {b}" in known and f"{a} {b}" in low}
    assert sorted(map(tuple, got.select("id", "entry").collect())) == sorted(want)


# --- languages --------------------------------------------------------------------------------
def test_language_model_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) >= 40")
    model = languages.fit(docs.filter("doc_id % 5 <> 0"), "text", "lang")
    found = languages.identify(docs.filter("doc_id % 5 = 0"), model, "text")
    right, n = found.agg(F.count_if(F.col("lang") == F.col("language")), F.count("*")).first()
    assert n > 100 and right >= 0.97 * n


def test_language_model_by_hand_and_more_scripts(spark):
    rows = [("aa", "abab aba"), ("bb", "baba bab bab"), ("ru", "привет мир как дела"), ("el", "καλημέρα κόσμε"), ("ja", "こんにちは世界")]
    train = spark.createDataFrame(rows, "l string, t string")
    model = languages.fit(train, "t", "l")
    assert list(model) == ["aa", "bb", "el", "ja", "ru"]
    grams = Counter()
    for word in "abab aba".split():
        codes = [ord(c) for c in f" {word} "]
        grams.update((a * 961 + b * 31 + c) % 4096 for a, b, c in zip(codes, codes[1:], codes[2:]))
    total = sum(grams.values())
    assert all(abs(x - math.log((grams[g] + 1) / (total + 4096))) < 1e-12 for g, x in enumerate(model["aa"]))
    asked = [("привет, привет, мир", "ru"), ("κόσμε κόσμε 123", "el"), ("世界こんにちは世界 ok?", "ja"), ("12345 67890 !!", "und"), (None, "und"),
             ("short", "und"), ("http://x.io/привет", "und")]
    df = spark.createDataFrame(asked, "t string, want string")
    assert all(r.want == r.language for r in languages.identify(df, model, "t").collect())
    assert {r.language for r in languages.identify(df, {}, "t").collect()} == {"und"}


def test_terms_are_counted_without_a_shuffle(spark):
    """Terms of a text are counted in its row; no exchange carries them, and repeated keys are one text."""
    df = spark.createDataFrame([(1, "b a b a b"), (2, None), (3, ""), (4, "aa bb")], "id long, t string")
    counts = topic_space.term_counts(df, "id", "t", [])
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    twice = spark.createDataFrame([(1, "aa bb aa"), (1, "aa"), (None, "aa"), (None, "bb"), (2, "bb")], "id long, t string")
    got = sorted((r.id or 0, r.term, r.tf) for r in topic_space.term_counts(twice, "id", "t", []).collect())
    assert got == [(0, "aa", 1), (0, "bb", 1), (1, "aa", 3), (1, "aa bb", 1), (1, "bb", 1), (1, "bb aa", 1), (2, "bb", 1)]


def test_dictionary_leaves_the_entries_unwritten(spark, monkeypatch):
    purposes, write = [], topic_space.written
    monkeypatch.setattr(topic_space, "written", lambda df, purpose, *a: purposes.append(purpose) or write(df, purpose, *a))
    terms, entries = topic_space.term_space(spark.createDataFrame(subjects(), "id long, t string"), "id", "t", ["the"])
    assert terms.count() and set(purposes) == {"repeated-keys", "sorted-terms", "dictionary"}


def test_reduction_is_the_same_in_many_tasks(space):
    """A step sends columns of texts, not of entries, and each task holds the entries of its own terms."""
    texts = topic_space.packed(space[1], "id")
    one = {r.id: list(r)[1:] for r in topic_space.reduce_packed(texts, "id", 3).collect()}
    many = {r.id: list(r)[1:] for r in topic_space.reduce_packed(texts, "id", 3, held=50).collect()}
    assert len(one) == 60 and all(np.allclose(one[k], many[k]) for k in one)
