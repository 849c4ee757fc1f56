"""Every operator against a plain version, on given documents and on awkward rows."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glosa.llm import (
    bpe_codec, chat_formatting, common, decontamination, lm_scoring, quality_classifier, quality_rules, secrets, simhash,
    substring_dedup, text_stats, token_counts, trigrams,
)
from tests.llm import brute
from tests.llm.conftest import PASSAGE, SF

MULTI = common.tokenizer_path("byte_bpe_multi_50k.tiktoken")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def bag(rows):
    return sorted(rows, key=repr)


@pytest.fixture(params=["documents", "edge", "empty"])
def docs(request, documents, edge):
    return {"documents": documents, "edge": edge, "empty": edge.limit(0)}[request.param]


def test_substring_dedup(docs):
    got = substring_dedup.repeats(docs, keep_text=True).collect()
    assert bag((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == bag(brute.kept_words(pairs(docs)))
    for r in got:
        assert sum(s.after - s.first for s in r.spans) == r.n_removed and brute.sha(r.kept) == r.kept_sha256


def test_substring_dedup_any_width_and_partitions(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 90)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width, n in ((5, "3"), (6, "7"), (20, "1")):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = substring_dedup.repeats(df, width).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert bag(map(tuple, got)) == bag(brute.kept_words(rows, width))


def test_quality_rules(docs, labels):
    got = quality_rules.judge(docs, labels).collect()
    want = [(d, *brute.base_stats(t)) for d, t in pairs(docs)]
    assert bag((r.doc_id, *(r[n] for n in text_stats.BASE)) for r in got) == bag(want)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_rules_agree_with_labels(documents, labels):
    verdict = {r.doc_id: r for r in quality_rules.judge(documents, labels).collect()}
    own = [(r.quality, verdict[r.doc_id]) for r in labels.collect()]
    assert all(v.kept for q, v in own if q == 1 and not v.base_failed)
    assert sum(v.kept for q, v in own if q == 0) == 0


def test_quality_rules_find_junk_without_symbols(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    verdict = {r.doc_id: r for r in quality_rules.judge(docs, labels).select("doc_id", "base_failed", "kept").collect()}
    own = [(r.quality, verdict[r.doc_id]) for r in labels.collect() if not verdict[r.doc_id].base_failed]
    bad, good = ([v.kept for q, v in own if q == quality] for quality in (0, 1))
    assert len(bad) > 250 and not any(bad)
    assert sum(not kept for kept in good) <= quality_rules.MAX_FALSE * len(good)


def test_quality_rules_hold_for_rows_without_a_label(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    shown = labels.filter("doc_id % 2 = 0")
    verdict = {r.doc_id: r for r in quality_rules.judge(docs, shown).select("doc_id", "base_failed", "kept").collect()}
    held = [(r.quality, verdict[r.doc_id]) for r in labels.filter("doc_id % 2 = 1").collect()]
    bad, good = ([v.kept for q, v in held if q == quality and not v.base_failed] for quality in (0, 1))
    assert sum(bad) <= 0.02 * len(bad) and sum(not kept for kept in good) <= 0.002 * len(good)


def test_forest_depth_and_calibration():
    x = np.concatenate([np.random.default_rng(1).uniform(size=(300, 2)), np.full((6, 2), 5.0)])
    forest = quality_rules.grow(x[:300])
    score = forest.score(x)
    assert score[300:].min() > score[:300].max()
    limit = quality_rules.calibrate(score[:300], score[300:])
    assert score[:300].max() < limit < score[300:].min()
    assert quality_rules.calibrate(np.ones(3), np.array([])) == np.inf
    walk = [slow_score(forest, row) for row in x[[0, 1, 2, 303]]]
    assert np.allclose(walk, score[[0, 1, 2, 303]])


def slow_score(forest, row):
    """One row through all trees: at each node it is isolated with a probability, or goes on to a child."""

    def length(t, node, depth):
        outside = sum(max(a - v, 0) + max(v - b, 0) for v, a, b in zip(row, forest.low[t, node], forest.high[t, node]))
        extent = sum(forest.high[t, node] - forest.low[t, node])
        cut_off = outside / (outside + extent) if outside else 0.0
        f = forest.feature[t, node]
        if f < 0:
            below = forest.length[t, node]
        else:
            below = length(t, forest.left[t, node] + (row[f] >= forest.split[t, node]), depth + 1)
        return cut_off * depth + (1 - cut_off) * below

    trees = len(forest.feature)
    return 2 ** (-sum(length(t, 0, 0) for t in range(trees)) / trees / forest.norm)


def test_path_length_is_the_mean_over_random_cuts():
    """The expectation of one node: cuts of the box with the row, drawn at random, isolate it first as often."""
    rng = np.random.default_rng(5)
    x, row = rng.uniform(size=(40, 2)), np.array([1.7, 0.5])
    forest = quality_rules.grow(x, trees=1, rows=40)
    low, high = np.minimum(x.min(axis=0), row), np.maximum(x.max(axis=0), row)
    extent = high - low
    hits = 0
    for _ in range(4000):
        f = rng.choice(2, p=extent / extent.sum())
        cut = rng.uniform(low[f], high[f])
        hits += bool((x[:, f] < cut).all() and row[f] >= cut) or bool((x[:, f] >= cut).all() and row[f] < cut)
    outside = np.maximum(row - forest.high[0, 0], 0).sum() + np.maximum(forest.low[0, 0] - row, 0).sum()
    share = outside / (outside + (forest.high[0, 0] - forest.low[0, 0]).sum())
    assert abs(hits / 4000 - share) < 0.03


def test_kept_follows_a_plain_forest(documents, labels):
    """Verdicts of the query, row by row, from the statistics, the ranks and a walk through the trees."""
    forest = quality_rules.fit(documents, labels)
    verdict = {r.doc_id: r for r in quality_rules.judge(documents, labels).collect()}
    for doc_id, text in pairs(documents):
        features = np.array([text_stats.measure(text)[1]], np.float32)
        row = quality_rules.rule_statistics(features)[0]
        own = []
        for value, column in zip(row, forest.known.T.tolist()):
            below, upto = sum(c < value for c in column), sum(c <= value for c in column)
            beyond = min(value - column[0], 0) + max(value - column[-1], 0)
            own.append((below + upto) / (2 * len(column)) + beyond / max(column[-1] - column[0], 0.02))
        score = slow_score(forest, own)
        assert abs(score - verdict[doc_id].anomaly) < 1e-9
        assert verdict[doc_id].kept == (not verdict[doc_id].base_failed and score <= forest.threshold)


def test_scores_vary_inside_the_range_of_good_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    kept = quality_rules.judge(docs, labels).filter("kept").select("anomaly").collect()
    assert len({round(r.anomaly, 9) for r in kept}) > 0.5 * len(kept)


def test_rules_without_labels(edge, labels):
    got = quality_rules.judge(edge, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in got)


def test_lm_scoring(docs):
    got = lm_scoring.score_documents(docs).collect()
    assert bag((r.doc_id, r.n_tokens) for r in got) == bag((d, len(brute.SPACE_WORD.findall(t or ""))) for d, t in pairs(docs))
    for r in got:
        assert (r.log_prob == 0 and r.mean_log_prob is None) if not r.n_tokens else r.log_prob < 0


def test_lm_is_a_masked_distribution(documents):
    words, line = lm_scoring.fit(documents)
    w = lm_scoring.from_line(line)
    context = np.array([[1, 2, 3, 4]])
    every = np.arange(lm_scoring.SIDE**2)
    total = np.exp(lm_scoring.log_probs(w, np.repeat(context, len(every), 0), every)).sum()
    assert abs(total - 1) < 1e-3
    number = lm_scoring.Numbers({x: i for i, x in enumerate(words)})
    text = documents.first().text
    tokens, places, _ = lm_scoring.padded([text], number)
    slow = 0.0
    for i in places:  # one token at a time, by hand
        around = [tokens[i - 2], tokens[i - 1], tokens[i + 1], tokens[i + 2]]
        slow += float(lm_scoring.log_probs(w, np.array([around]), tokens[[i]])[0])
    found = documents.limit(1).select(lm_scoring.scores(documents.text, words, line).alias("s")).first().s
    assert found.n_tokens == len(places) and abs(found.log_prob - slow) < 1e-2 * len(places)


def test_lm_gradients():
    rng = np.random.default_rng(1)
    w = {n: v.astype(np.float64) for n, v in lm_scoring.start_weights(np.ones(lm_scoring.SIDE**2)).items()}
    w["first"] += rng.normal(0, 0.3, w["first"].shape)
    w["second"] += rng.normal(0, 0.3, w["second"].shape)
    context, target = rng.integers(0, 4096, (8, 4)), rng.integers(0, 4096, 8)
    grads = {n: np.zeros(v.shape) for n, v in w.items()}
    for name, (rows, g) in lm_scoring.gradients(w, context, target).items():
        grads[name][rows] += g
    spots = {"embed": (context[0, 0], 1), "mix": (3, 2), "first": (1, 5), "second_bias": (target[0] // 64, 3)}
    for name, spot in spots.items():
        losses = []
        for step in (1e-5, -1e-5):
            w[name][spot] += step
            losses.append(-lm_scoring.log_probs(w, context, target).mean())
            w[name][spot] -= step
        assert abs((losses[0] - losses[1]) / 2e-5 - grads[name][spot]) < 1e-5


def plain_log_prob(w, words, counts, text):
    """Sum of log P(word | both sides), with loops and math alone."""
    import math

    side, buckets, reach = lm_scoring.SIDE, lm_scoring.BUCKETS, lm_scoring.REACH
    number = {x: i for i, x in enumerate(words)}

    def of(word):
        return number.get(word, lm_scoring.WORDS + lm_scoring.zlib.crc32(word) % buckets)

    shared = {}
    for word, n in counts.items():
        if word not in number:
            shared[of(word)] = shared.get(of(word), 0) + n
    own = (text or "").encode().split()
    tokens = [of(x) for x in own]
    total = 0.0
    for i, target in enumerate(tokens):
        around = [i + k for k in range(-reach, reach + 1) if k]
        x = [v for k in around for v in w["embed"][tokens[k] if 0 <= k < len(tokens) else lm_scoring.PAD]]
        h = [math.tanh(sum(a * b for a, b in zip(x, column)) + c) for column, c in zip(w["mix"].T, w["mix_bias"])]
        for matrix, bias, row in (
            (w["first"], w["first_bias"], target // side), (w["second"], w["second_bias"][target // side], target % side)
        ):
            out = [sum(a * b for a, b in zip(h, column)) + c for column, c in zip(matrix.T, bias)]
            total += out[row] - math.log(sum(map(math.exp, out)))
        if own[i] not in number:
            total += math.log(counts[own[i]] / shared[target])
    return total


@pytest.mark.parametrize("scale", [0.3, 8.0])
def test_lm_query_agrees_with_plain_python(spark, edge, monkeypatch, scale):
    """Scores of the whole job from given weights; large weights take the shifted exponentials."""
    rng = np.random.default_rng(3)
    w = {n: rng.normal(0, scale, s).astype(np.float32) for n, s in lm_scoring.SHAPES.items()}
    assert lm_scoring.small_outputs(w) == (scale < 1)
    monkeypatch.setattr(lm_scoring, "train", lambda rows, number: lm_scoring.to_line(w))
    monkeypatch.setattr(lm_scoring, "WORDS", 40)  # the others share buckets
    monkeypatch.setattr(lm_scoring, "BUCKETS", lm_scoring.SIDE**2 - 40)
    rows = [(d, t) for d, t in pairs(edge) if len(t or "") < 2000]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts = Counter(x for _, t in rows for x in (t or "").encode().split())
    words = sorted(counts, key=lambda x: (-counts[x], x))[:40]
    want = [(d, plain_log_prob(w, words, counts, t)) for d, t in rows]
    got = [(r.doc_id, r.log_prob) for r in lm_scoring.score_documents(df, 5).collect()]
    order = lambda r: (repr(r[0]), r[1])
    for (a, x), (b, y) in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert a == b and abs(x - y) < 1e-3 * (1 + abs(y))


def test_lm_beats_word_counts_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learnt, held = docs.filter("doc_id % 5 <> 0").repartition(4), docs.filter("doc_id % 5 = 0")
    words, line = lm_scoring.fit(learnt)
    _, number = lm_scoring.vocabulary(learnt)
    start = lm_scoring.to_line(lm_scoring.start_weights(number))
    both = [held.select(lm_scoring.scores(held.text, words, x).alias("s")).agg(F.sum("s.log_prob")).first()[0] for x in (line, start)]
    assert both[0] > both[1]


def test_training_lowers_the_loss(spark):
    cycle = ["red", "green", "blue", "gold"] * 41
    rows = [(i, " ".join(cycle[i % 4 : i % 4 + 160])) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    words, line = lm_scoring.fit(df)
    _, number = lm_scoring.vocabulary(df)
    trained = df.select(lm_scoring.scores(df.text, words, line).alias("s")).first().s.log_prob
    plain = df.select(lm_scoring.scores(df.text, words, lm_scoring.to_line(lm_scoring.start_weights(number))).alias("s")).first().s
    assert trained > 0.8 * plain.log_prob  # far less negative than from counts alone


@pytest.mark.parametrize("rounds", [1, 2, 3, lm_scoring.ROUNDS])
def test_lm_rounds_train_on_every_position(rounds):
    texts = ["one", "", "a b c d e f g h i j k l m n o p q r s t", None, "x y z"]
    _, places, owner = lm_scoring.padded(texts, lm_scoring.Numbers())
    trained = [lm_scoring.targets(places, owner, turn, rounds) for turn in range(rounds)]
    assert sorted(np.concatenate(trained).tolist()) == places.tolist()


def test_lm_training_reaches_every_position(spark):
    cycle = " ".join(["zero", "one", "two", "three", "four", "five", "six", "seven"] * 20)
    df = spark.createDataFrame([(i, cycle) for i in range(600)], "doc_id long, text string").coalesce(1)
    words, line = lm_scoring.fit(df)
    _, number = lm_scoring.vocabulary(df)
    tokens, places, _ = lm_scoring.padded([cycle], lm_scoring.Numbers({x: i for i, x in enumerate(words)}))
    at = places[16:24]  # each word once, well inside the text
    weights = lm_scoring.from_line(line), lm_scoring.start_weights(number)
    after, before = (lm_scoring.log_probs(w, lm_scoring.windows(tokens, at), tokens[at]) for w in weights)
    assert (after > before + 1).all()


@pytest.mark.parametrize("most", [0, 40, lm_scoring.HOT])
def test_lm_words_of_a_bucket_score_by_their_counts(spark, monkeypatch, most):
    monkeypatch.setattr(lm_scoring.train, "__defaults__", (0,))  # start weights: the context says nothing
    own = " ".join(f"common{i}" for i in range(lm_scoring.WORDS))
    tail = [(f"tail{i}", 1 + i % 7) for i in range(300)]
    texts = [own] * 9 + [w for w, n in tail for _ in range(n)] + ["common1 tail3 tail6 tail3"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    count = dict(tail) | {"tail3": 1 + 3 + 2, "tail6": 7 + 1}
    of, buckets = lambda w: lm_scoring.zlib.crc32(w.encode()) % lm_scoring.BUCKETS, np.zeros(lm_scoring.BUCKETS)
    for w, n in count.items():
        buckets[of(w)] += n
    words, number = lm_scoring.vocabulary(df)
    assert len(words) == lm_scoring.WORDS and (number[lm_scoring.WORDS :] == 1 + buckets).all()
    line = lm_scoring.to_line(lm_scoring.start_weights(number))
    plain = {r.doc_id: r.s.log_prob for r in df.select("doc_id", lm_scoring.scores(df.text, words, line).alias("s")).collect()}
    got = {r.doc_id: r for r in lm_scoring.score_documents(df, most).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        inside = sum(np.log(count[w] / buckets[of(w)]) for w in text.split() if w in count)
        assert got[i].n_tokens == len(text.split()) and abs(got[i].log_prob - plain[i] - inside) < 1e-4 * got[i].n_tokens


def test_bpe_codec(docs):
    import tiktoken

    own = tiktoken.Encoding("t", pat_str=bpe_codec.public_pattern(), mergeable_ranks=bpe_codec.read_ranks(MULTI), special_tokens={})
    want = []
    for d, t in pairs(docs):
        ids = own.encode_ordinary(t or "")
        want.append((d, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(t or "")))
    got = bpe_codec.with_digests(docs, MULTI).collect()
    assert bag(map(tuple, got)) == bag(want)


def test_bpe_arrays_and_odd_strings(spark):
    import tiktoken

    own = tiktoken.Encoding("t", pat_str=bpe_codec.public_pattern(), mergeable_ranks=bpe_codec.read_ranks(MULTI), special_tokens={})
    rng = random.Random(5)
    alphabet = [chr(c) for c in range(1, 0x2100)] + list(" \n't sre") * 300
    texts = ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(300)] + ["ab" * 1500, " " * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coded = df.select("doc_id", bpe_codec.encode(df.text, MULTI).alias("ids"))
    got = coded.select("doc_id", "ids", bpe_codec.decode(coded.ids, MULTI).alias("raw")).collect()
    for r in got:
        assert list(r.ids) == own.encode_ordinary(texts[r.doc_id]) and bytes(r.raw).decode() == texts[r.doc_id]


def test_long_words_in_rounds(monkeypatch):
    import tiktoken

    monkeypatch.setattr(bpe_codec, "ROUND_ROWS", 1)  # 64 contractions per query
    codec = bpe_codec.Codec(MULTI, bpe_codec.public_pattern())
    own = tiktoken.Encoding("t", pat_str=bpe_codec.public_pattern(), mergeable_ranks=codec.ranks, special_tokens={})
    text = "".join(random.Random(2).choice("etaoinsh") for _ in range(1200))
    assert codec.encode([text])[0][1].tolist() == own.encode_ordinary(text)


def test_secret_scan(docs):
    got = secrets.report(docs).collect()
    names = [r.kind for r in secrets.RULES]
    seen = bag((r.doc_id, [(s.start, names[s.kind], s.end) for s in r.spans_ if s.kind < 3]) for r in got)
    want = bag((d, [(a, brute.RULES[k][0], b) for a, k, b in brute.secret_spans(t)]) for d, t in pairs(docs))
    assert seen == want


def test_further_rules_and_redaction(spark):
    texts = [
        "x -----BEGIN RSA PRIVATE KEY----- y", "ghp_" + "a1B2" * 10, "xoxb-123456789012", "eyJab.eyJcd.ef-g", "plain text",
        "\U0001f600 token=abcdefgh12345678 " + "0f" * 20, None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = {r.doc_id: [secrets.RULES[s.kind].kind for s in r.spans_] for r in secrets.report(df).collect()}
    assert kinds == {0: ["private"], 1: ["forge"], 2: ["chat"], 3: ["bearer"], 4: [], 5: ["assign", "hex"], 6: []}
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert clean[5] == "\U0001f600 [REDACTED] [REDACTED]" and clean[0] == "x [REDACTED] y" and clean[6] is None


def test_trigram_queries_hold_for_every_match():
    for rule in secrets.RULES:
        assert (frozenset() in trigrams.trigram_query(rule.pattern)) == (rule.kind == "hex")
    assert trigrams.trigram_query("ab(cd|ef)g?") == frozenset({frozenset({"abc", "bcd"}), frozenset({"abe", "bef"})})
    assert trigrams.trigram_query("a[0-9]+b") == trigrams.ANYTHING
    assert trigrams.trigram_query("abc.*def") == frozenset({frozenset({"abc", "def"})})


def test_secret_scan_is_native(documents):
    plan = secrets.report(documents)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def component_ids(rows):
    label = brute.linked([f for _, f in rows])
    least = {}
    for d, f in rows:
        if d is not None:
            least[label[f]] = min(d, least.get(label[f], d))
    return bag((d, f"{f:016x}", least.get(label[f])) for d, f in rows)


def test_simhash(docs):
    got = simhash.near_duplicates(docs).collect()
    assert bag(map(tuple, got)) == component_ids([(d, brute.fingerprint(t)) for d, t in pairs(docs)])


@pytest.mark.parametrize("bits", [1, 2])
def test_simhash_links_random_fingerprints(spark, bits):
    rng = random.Random(7)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    prints = {0, 1, 1 << 63, (1 << 64) - 1}
    for s in seeds:
        for _ in range(15):
            prints.add(s)
            for _ in range(rng.randint(1, 2)):
                s ^= 1 << rng.randrange(64)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    distinct = spark.createDataFrame(signed, "fp long")
    found = simhash.components(simhash.links(distinct, bits)).collect()
    label = {r.node % (1 << 64): r.label for r in found}
    want = brute.linked(prints, bits)
    groups = {}
    for p in prints:
        groups.setdefault(want[p], set()).add(label.get(p, ("alone", p)))
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


def test_keep_first(edge):
    kept = simhash.keep_first(edge)
    assert kept.columns == edge.columns
    rows, have = pairs(edge), pairs(kept)
    label = brute.linked([brute.fingerprint(t) for _, t in rows])
    groups = {}
    for d, t in rows:
        groups.setdefault(label[brute.fingerprint(t)], []).append(d)
    want = [min((d for d in ids if d is not None), default=None) for ids in groups.values()]
    assert bag(d for d, _ in have) == bag(want)


def test_quality_classifier(edge, documents, labels):
    got = quality_classifier.classify(documents, labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert held and sum(p == t for p, t in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    odd = quality_classifier.classify(edge, labels).collect()
    assert len(odd) == edge.count() and not any(r.held_out for r in odd if r.doc_id is None)
    assert {r.score for r in quality_classifier.classify(edge, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.classify(edge.limit(0), labels).collect() == []


def test_trees_by_hand():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3)).astype(np.float32)
    y = (x[:, 0] + (x[:, 1] > 0.3) > 0.5).astype(float)
    trees = quality_classifier.boost(x, y)
    score = trees.score(x)
    assert ((score > 0.5) == y).mean() > 0.97
    margin = trees.start
    for t in range(len(trees.feature)):
        node = 0
        while node < trees.feature.shape[1]:
            node = 2 * node + 1 + (x[5, trees.feature[t, node]] > trees.cut[t, node])
        margin += trees.leaf[t, node - trees.feature.shape[1]]
    assert abs(1 / (1 + np.exp(-margin)) - score[5]) < 1e-9


@pytest.mark.parametrize("most", [200_000, 300])
def test_decontamination(docs, benchmark_table, most):
    items = [(r.item_id, r.text) for r in benchmark_table.collect()]
    got = decontamination.find(docs, benchmark_table, most).collect()
    want = brute.contamination(pairs(docs), items)
    assert bag((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got) == bag(want)
    assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got)


def test_decontamination_odd_items(spark, edge):
    items = [(1, None), (2, ""), (None, "two WORDS"), (3, PASSAGE), (3, PASSAGE), (4, "same row here"), (5, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find(edge, bench).collect()
    assert bag((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got) == bag(brute.contamination(pairs(edge), items))
    spans = pairs(decontamination.decontaminate(edge, bench, "spans"))
    assert (6, "") in spans and (8, "x  y") in spans and (1, None) in spans
    kept = decontamination.decontaminate(edge, bench)
    assert kept.columns == edge.columns and 6 not in {d for d, _ in pairs(kept)}
    assert decontamination.decontaminate(edge, bench.limit(0)).count() == edge.count()


def test_token_counts(docs):
    from tokenizers import Tokenizer

    path = common.tokenizer_path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    want = []
    for d, t in pairs(docs):
        n = len(own.encode(t or "", add_special_tokens=False).ids)
        want.append((d, len((t or "").encode()), n, n > 512))
    assert bag(map(tuple, token_counts.with_token_counts(docs, path).collect())) == bag(want)


CHAT = "conv_id long, turn long, role string, text string, key string, path string, leaf string"


def chats(spark, rows):
    return spark.createDataFrame([(*r, "taken", "taken", "taken") for r in rows], CHAT)


ODD_CHATS = [
    (1, 0, "user", "hi [INST] \\ </s> <"), (1, 1, "assistant", "a\nb"), (2, 0, "user", "hi [INST] \\ </s> <"),
    (2, 1, "assistant", "other"), (3, 0, "user", "hi [INST] \\ </s> <"), (4, 0, None, None), (5, None, "assistant", ""),
    (None, 0, "x [/INST] y", "z"), (6, 1, "user", "tie"), (6, 1, "user", "tie"), (6, 1, "assistant", "tie \U0001f600"),
    (7, 0, "user", "hi [INST] \\ </s> <"), (7, 1, "assistant", "a\nb"), (7, 2, "user", "more " * 400),
]


@pytest.mark.parametrize("case", ["odd", "given", "empty"])
def test_chat_formatting(spark, case):
    given = spark.read.parquet(f"{SF}/conversations.parquet")
    df = {"odd": chats(spark, ODD_CHATS), "given": given, "empty": chats(spark, [])}[case]
    path = common.tokenizer_path("byte_bpe_50k.tiktoken")
    nodes, members = chat_formatting.format_chats(df, path)
    got = {r.conv_id: r for r in chat_formatting.digests(nodes, members, path).collect()}
    whole = {}
    for r in df.collect():
        whole.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    assert got.keys() == whole.keys()
    for conv, turns in whole.items():
        turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        loss = "".join(t for _, role, t in turns if role == "assistant")
        r = got[conv]
        assert r.turns_sha256 == brute.sha("".join(f"{role}\n{t}\n" for _, role, t in turns))
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(loss), brute.sha(loss))
    check_stream(nodes.collect(), members.collect(), whole)


def check_stream(nodes, members, whole):
    """Each shared turn is there once, depth first; ancestors are exactly the turns before."""
    nodes.sort(key=lambda n: n.offset)
    at = 0
    by_key = {bytes(n["key"]): n for n in nodes}
    assert len(by_key) == len(nodes)
    stack = []
    for n in nodes:
        assert n.offset == at and len(stack) >= n.depth
        at += len(n.tokens)
        del stack[n.depth :]
        seen = sorted(i for o, k in stack for i in range(o, o + k))
        assert [i for a in n.ancestors for i in range(a.start, a.end)] == seen
        assert list(n.position_ids) == list(range(len(seen), len(seen) + len(n.tokens)))
        stack.append((n.offset, len(n.tokens)))
    prefixes = {tuple(t[1:] for t in sorted(ts, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))[: k + 1])
                for ts in whole.values() for k in range(len(ts))}
    assert len(prefixes) == len(nodes)
    assert all(bytes(m.leaf) in by_key for m in members)


def test_chat_ranges_share_open_ancestors(spark):
    rng = random.Random(9)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 5)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice("ab")))
    path = common.tokenizer_path("byte_bpe_50k.tiktoken")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    nodes, members = chat_formatting.format_chats(chats(spark, rows), path)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    whole = {}
    for c, t, role, text in rows:
        whole.setdefault(c, []).append((t, role, text))
    check_stream(nodes.collect(), members.collect(), whole)


def test_rules_are_fitted_on_every_labelled_row(spark, monkeypatch):
    """Ranks, trees and threshold have all rows, more than are held as ranks: one row that no sample has shows in all."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(3000, 3)), 2)
    x[1234] = 50.0
    rows = spark.createDataFrame([(int(h), [float(v) for v in r]) for h, r in enumerate(x)], "hash long, x array<double>")
    whole = quality_rules.order_statistics(rows, len(x), 3)
    assert np.array_equal(whole, np.sort(x, axis=0))
    held = quality_rules.order_statistics(rows, len(x), 3, ranks=101)
    assert np.array_equal(held, np.sort(x, axis=0)[np.arange(101) * 2999 // 100])
    forest = quality_rules.grow_on(rows, len(x), 3, trees=4)
    assert max(forest.high[t, 0].max() for t in range(4)) == 50.0
    assert np.array_equal(forest.low[:, 0], np.array([x[t::4].min(axis=0) for t in range(4)]))
    scores = np.round(rng.uniform(size=3000), 3)
    label = rng.integers(0, 2, 3000)
    table = spark.createDataFrame([(int(a), float(b)) for a, b in zip(label, scores)], "label int, score double")
    assert quality_rules.calibrated(table, 0.01) == quality_rules.calibrate(scores[label == 1], scores[label == 0], 0.01)


def test_lm_outputs_exist_for_one_block_at_a_time(monkeypatch):
    rng = np.random.default_rng(5)
    w = {n: rng.normal(0, 0.3, s).astype(np.float32) for n, s in lm_scoring.SHAPES.items()}
    bodies = [rng.integers(0, lm_scoring.PAD, 10_000).astype(np.int16).tobytes() for _ in range(3)]
    laid = lm_scoring.decoded(bodies)
    lm_scoring.totals(w, *laid, 3)
    tracemalloc.start()
    count, total = lm_scoring.totals(w, *laid, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5_000_000 and count.tolist() == [10_000] * 3
    at, tokens = laid[1][:100], laid[0]
    context, target = lm_scoring.windows(tokens, at), tokens[at]
    whole, some = lm_scoring.log_probs(w, context, target), lm_scoring.gradients(w, context, target)
    monkeypatch.setattr(lm_scoring, "BLOCK", 7)
    assert np.allclose(lm_scoring.totals(w, *laid, 3)[1][0], total[0], rtol=1e-5)
    assert np.allclose(lm_scoring.log_probs(w, context[:1], target[:1]), whole[:1], rtol=1e-5)
    for name, (rows, g) in lm_scoring.gradients(w, context, target).items():
        assert np.array_equal(rows, some[name][0]) if name == "embed" else rows == some[name][0]
        assert np.allclose(g, some[name][1], rtol=1e-4, atol=1e-7), name
