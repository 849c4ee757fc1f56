"""Periodic runs, filter audit and packing against plain versions."""

import itertools
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glosa.llm import common, filter_audit, packing, periodic_runs
from tests.llm import brute
from tests.llm.test_operators import bag, docs, pairs  # noqa: F401  (docs is a fixture)

WORDS = common.tokenizer_path("word_bpe_49k.json")


# --- periodic runs ----------------------------------------------------------------------------
def plain_runs(words):
    """[(start, end, period)] by comparing the words at every distance."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(12, 2 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((s, e, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_result(doc_id, text):
    words = brute.SPACE_WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {k for s, e, p in runs for k in range(s + p, e)}
    best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    longest = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{e - s},{p}\n" for s, e, p in runs)
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    return (doc_id, len(runs), *longest, brute.sha(listed), brute.sha(kept))


def short(rows):
    """Rows that the quadratic version can take."""
    return [(d, t) for d, t in rows if len((t or "").split()) <= 2500]


def test_periodic_runs(docs):  # noqa: F811
    some = short(pairs(docs))
    got = periodic_runs.find_runs(docs).collect()
    assert len(got) == docs.count()
    want = Counter(plain_result(d, t) for d, t in some)
    assert not want - Counter(map(tuple, got))


def word_sequence(rng):
    """Random, constant, periodic, Fibonacci, patched and Thue-Morse words."""
    kind, n = rng.randrange(6), rng.choice([0, 1, 12, 20, 60, 150, 400])
    out = [0]
    if kind == 0:
        return [rng.choice([0, 1]) for _ in range(n)]
    if kind == 1:
        return [0] * n
    if kind == 2:
        return ([rng.randrange(3) for _ in range(rng.randint(1, 30))] * n)[:n]
    if kind == 3:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    while len(out) < n:
        if kind == 4:
            out += [rng.randrange(5) for _ in range(rng.randint(1, 12))] * rng.choice([1, 2, 3, 5])
        else:
            out += [1 - x for x in out]
    return out[:n]


@pytest.mark.parametrize("ways", [(periodic_runs.Hashes, periodic_runs.Ranks), (periodic_runs.Ranks,)])
def test_runs_of_word_sequences(ways):
    rng = random.Random(7)
    for _ in range(120):
        own = [word_sequence(rng) for _ in range(rng.randint(1, 6))]
        sizes = [len(d) for d in own]
        words, doc, ends = np.array(sum(own, []), np.int64), np.repeat(np.arange(len(own)), sizes), np.cumsum(sizes)
        want = [(s + e - n, x + e - n, p) for d, n, e in zip(own, sizes, ends) for s, x, p in plain_runs(d)]
        assert sorted(map(tuple, periodic_runs.group_runs(words, doc, ends, ways).tolist())) == sorted(want)


def test_colliding_hashes_are_noticed():
    class Blind(periodic_runs.Hashes):
        def equal(self, a, b, width):
            return np.ones(len(a), bool)

    words = np.array([0, 1, 2, 3] * 5 + [7, 8, 9, 0, 1, 2, 5])
    got = periodic_runs.group_runs(words, np.zeros(len(words), np.int64), np.array([len(words)]), (Blind, periodic_runs.Ranks))
    assert got.tolist() == [[0, 20, 4]]


def test_grammar_derives_its_words():
    """Rules never leave a pair of one document twice, and every use of a rule has the words of its first one."""
    rng = random.Random(2)
    words = np.array([rng.randrange(4) for _ in range(600)])
    grammar = periodic_runs.Grammar(words, np.repeat([0, 1], 300))
    for rule, at in zip(grammar.used_rule, grammar.used_at):
        a, size = grammar.rule_at[rule], grammar.rule_end[rule] - grammar.rule_at[rule]
        assert (words[a : a + size] == words[at : at + size]).all()
    assert (np.bincount(grammar.used_rule) >= 2).all()


def test_long_texts_have_their_runs(spark):
    line = " ".join(f"w{k}" for k in range(3000))
    rows = [(9, " ".join([line] * 300)), (11, "same " * 400_000)]  # 5 MB and 2 MB
    got = {r.doc_id: r for r in periodic_runs.find_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[9].n_runs, got[9].start, got[9].length, got[9].period) == (1, 0, 900_000, 3000)
    assert (got[11].n_runs, got[11].length, got[11].period, got[11].exponent_milli) == (1, 400_000, 1, 400_000_000)
    assert got[9].collapsed_sha256 == brute.sha(line) and got[11].collapsed_sha256 == brute.sha("same")


# --- filter audit -----------------------------------------------------------------------------
def plain_audit(rows, labels):
    """rows: [(doc_id, text, source)], labels: [(doc_id, quality, toxic)]."""
    first, good, toxic = {}, set(), set()
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    for d, q, x in labels:
        good |= {d} if q == 1 and d is not None else set()
        toxic |= {d} if x == 1 and d is not None else set()
    failed, parts = [], {}
    for d, t, source in rows:
        t = t or ""
        words = brute.SPACE_WORD.findall(t)
        rules = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t),
            "E": d is not None and d > first[t],
        }
        failed.append((d, {f for f, bad in rules.items() if bad}))
        parts.setdefault(source or "", []).append(failed[-1])
    out = []
    for part, own in parts.items():
        total = Counter()
        for order in itertools.permutations("ABCDE"):
            for _, bad in own:
                total.update(next(([f] for f in order if f in bad), []))
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order):
                before = set(order[:step])
                here = [d for d, bad in own if f in bad and not bad & before]
                out.append((
                    part, "".join(order), step + 1, sum(not bad & (before | {f}) for _, bad in own), len(here),
                    sum(f in bad and bool(bad & before) for _, bad in own), sum(bad == {f} for _, bad in own),
                    sum(d in good for d in here), sum(d in toxic for d in here), total[f],
                ))
    return out


def check_audit(spark, df, labels, path, bytes_a_batch=None):
    df.write.parquet(path)
    report = filter_audit.all_orders(filter_audit.counters(spark, path, labels, bytes_a_batch))
    rows = [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]
    want = plain_audit(rows, [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    assert bag(map(tuple, report.collect())) == bag(want)


def test_filter_audit(spark, docs, labels, tmp_path):  # noqa: F811
    check_audit(spark, docs, labels, f"{tmp_path}/documents.parquet")


def test_smaller_ids_retract(spark, tmp_path):
    """Every batch brings smaller ids of the same texts, in other parts and with other labels."""
    rng = random.Random(4)
    texts = ["", None, "word " * 60, " ".join(f"w{k}" for k in range(60)), "A B # c", "long " + "x y z " * 30]
    rows = [(d if rng.random() < 0.95 else None, rng.choice(texts), rng.choice(["a", "b", None])) for d in range(200, 0, -1)]
    rows += [(5, texts[3], "a"), (5, texts[3], "b"), (5, texts[3], "b")]
    marks = [(d, rng.randrange(2), rng.randrange(2)) for d in range(1, 200, 3)] + [(1, 1, 1), (1, 0, 0), (None, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartitionByRange(6, F.col("doc_id").desc())
    for name in ("mask", "part", "good", "digest", "low"):
        df = df.withColumn(name, F.lit("taken"))
    check_audit(spark, df, labels, f"{tmp_path}/documents.parquet", 1)


def test_audit_leaves_settings_alone(spark, documents, labels, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    documents.limit(20).write.parquet(f"{tmp_path}/d.parquet")
    filter_audit.counters(spark, f"{tmp_path}/d.parquet", labels)
    assert spark.conf.get(key) == before


# --- packing ----------------------------------------------------------------------------------
def library_pieces(rows, capacity):
    from tokenizers import Tokenizer

    tokenizer, out = Tokenizer.from_file(WORDS), []
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            out.append((d, k, start, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    return out


def check_packed(got, capacity):
    """Every sequence is filled from 0 on without a gap and not beyond its capacity; their number is good."""
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in held.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= capacity
    return len(held)


@pytest.mark.parametrize("capacity", [packing.CAPACITY, 40])
def test_best_fit_packing(docs, capacity):  # noqa: F811
    got = packing.packed(docs, WORDS, capacity).collect()
    assert bag(tuple(r[:5]) for r in got) == bag(library_pieces(pairs(docs), capacity))
    used = check_packed(got, capacity)
    assert used <= 1.05 * sum(r.length for r in got) / capacity + 1


def test_ids_of_words_are_those_of_the_text():
    from tokenizers import Tokenizer

    rng, tokenizer = random.Random(1), Tokenizer.from_file(WORDS)
    marks = ["é", "́", "İ", "ΑΣ", "\xa0", " ", "\x1c", "\x85", "\t", "\n", " ", "<|endoftext|>", "'LL", "ǅ", "１", "x" * 50, "가", "가"]
    for _ in range(300):
        text = "".join(rng.choice(marks) for _ in range(rng.randint(0, 12)))
        ids = np.frombuffer(packing.WordIds(WORDS)(text) if _ % 50 == 0 else packing.word_ids(WORDS)(text), "<u4").tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def fewest(lengths, capacity):
    """The least number of bins, by trying all."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def put(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[k] <= capacity and bins[b] not in bins[:b]:
                put(k + 1, [*bins[:b], bins[b] + lengths[k], *bins[b + 1 :]])
        put(k + 1, [*bins, lengths[k]])

    put(0, [])
    return best[0]


def test_plans_are_whole_and_close_to_the_fewest():
    rng, over = random.Random(6), 0
    for _ in range(150):
        capacity = rng.choice([10, 20, 33])
        lengths = [rng.randint(1, capacity - 1) for _ in range(rng.randint(1, 11))]
        plan = packing.Plan(dict(Counter(lengths)), capacity)
        fill, taken = Counter(), Counter()
        for length, _, copies, bins, first, offset in sorted(plan.rows, key=lambda r: r[5]):
            taken[length] += copies * bins
            for b in range(first, first + bins):
                assert fill[b] == offset
                fill[b] += copies * length
        assert taken == Counter(lengths) and len(fill) == plan.bins and max(fill.values()) <= capacity
        over += plan.bins - fewest(lengths, capacity)
    assert over <= 8  # in 150 plans


def test_plan_of_many_pieces_is_short():
    counts = {length: 10**9 // length for length in range(1, packing.CAPACITY)}
    plan = packing.Plan(counts)
    total = sum(length * n for length, n in counts.items())
    assert plan.bins <= 1.01 * total / packing.CAPACITY and len(plan.rows) < 20 * packing.CAPACITY


def test_long_text_is_cut_into_whole_sequences(spark):
    rows = [(1, "word " * 1_000_000), (2, "x" * 200_000)]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), WORDS).collect()
    assert bag(tuple(r[:5]) for r in got) == bag(library_pieces(rows, packing.CAPACITY))
    check_packed(got, packing.CAPACITY)
