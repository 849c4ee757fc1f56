"""Periodic runs of words by grammar compression.

A run is a stretch of words that repeats with its smallest period q, at least twice and over at least twelve
words, and that no neighbouring word prolongs.  The word numbers of many documents are compressed side by side:
Re-Pair replaces repeated pairs of a document by nonterminals, the most frequent first.  One round replaces every
pair that is more frequent than the pairs it overlaps with, so the number of rounds is small; rounds go on until
no pair of a document is left twice.  What is left of a document is joined by a balanced tree of pairs.

Each run lies whole in a lowest node of this derivation and crosses the boundary of that node's two children.
So the runs that cross a boundary are computed once for each nonterminal, inside its expansion: a run that holds
six equal words at distance q has three of them next to the boundary, on one side at least, so the other places
of these two triples are the only candidates; how far each reaches comes from prefix hashes.  The findings are
moved to all positions at which the nonterminal is derived, and intervals of one period that overlap are merged.
The result is compared with the words themselves; should hashes have collided, exact ranks replace them.

Defined results: a null or empty text has no words and no run; documents are independent, so ties and repeated
rows give equal results; a null doc_id is never turned into a planted repetition; an empty table gives an empty
result and further columns are not read.  A long text is compressed whole, in one task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosa.llm import common

#: Contract: words and periods that a run has at the least.
LEAST_WORDS, LEAST_PERIODS = 12, 2
#: Words of documents that are compressed side by side; a longer document is compressed alone.
GROUP_WORDS = 300_000
#: Candidates whose reach is computed at once.
CANDIDATES = 500_000
#: Words on one side of a boundary that a run of ``LEAST_WORDS`` shares with its next period at the least.
SEED_WORDS = 3


def planted(doc_id: str | None, n: int) -> np.ndarray | None:
    """Numbers of the original words after the contract's planted repetition; None where there is none."""
    h = zlib.crc32(doc_id.encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


# --- Re-Pair ----------------------------------------------------------------------------------
class Grammar:
    """Rules and start sequences of several documents; positions are those in the joined words.

    ``rule_at``, ``rule_cut`` and ``rule_end`` are first position, boundary and end of a rule's first occurrence;
    ``used_rule`` and ``used_at`` list all of its derived positions.  ``start_at`` are the first positions of the
    symbols that are left, by position, and ``start_doc`` their documents.
    """

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        self.rules = 0
        found: list[tuple[np.ndarray, ...]] = []
        used: list[tuple[np.ndarray, np.ndarray]] = []
        done: list[tuple[np.ndarray, np.ndarray]] = []
        symbol, at, size = words.astype(np.int64), np.arange(len(words)), np.ones(len(words), np.int64)
        symbols = int(words.max()) + 1 if len(words) else 0
        while len(symbol):
            chosen, pair = self.choose(symbol, doc, symbols)
            busy = np.zeros(int(doc[-1]) + 1, bool)
            busy[doc[chosen]] = True
            rest = ~busy[doc]
            done.append((at[rest], doc[rest]))
            if not len(chosen):
                break
            # one rule for each pair that was chosen, in the order of first occurrence
            names, first = np.unique(pair, return_index=True)
            rule = np.searchsorted(names, pair)
            head = chosen[first]
            found.append((at[head], at[head] + size[head], at[head] + size[head] + size[head + 1]))
            used.append((self.rules + rule, at[chosen]))
            symbol[chosen] = symbols + rule
            size[chosen] += size[chosen + 1]
            stay = busy[doc]
            stay[chosen + 1] = False
            symbol, at, size, doc = symbol[stay], at[stay], size[stay], doc[stay]
            self.rules += len(names)
            symbols += len(names)
        none = np.empty(0, np.int64)
        self.rule_at, self.rule_cut, self.rule_end = map(np.concatenate, zip(*found)) if found else (none,) * 3
        self.used_rule, self.used_at = map(np.concatenate, zip(*used)) if used else (none,) * 2
        self.start_at, self.start_doc = map(np.concatenate, zip(*done)) if done else (none,) * 2
        order = np.argsort(self.start_at)
        self.start_at, self.start_doc = self.start_at[order], self.start_doc[order]

    @staticmethod
    def choose(symbol: np.ndarray, doc: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs to replace in this round, and the number of the pair at each."""
        left, right = symbol[:-1], symbol[1:]
        same = doc[:-1] == doc[1:]
        twin = same & (left == right)
        if twin.any():  # of x x x, every second pair
            n = np.arange(len(twin))
            begins = np.maximum.accumulate(np.where(twin, -1, n))
            same &= ~(twin & ((n - begins) % 2 == 0))
        place = np.flatnonzero(same)
        code = (doc[place].astype(np.int64) * symbols + left[place]) * symbols + right[place]
        pair, _ = pd.factorize(code)
        count = np.bincount(pair) if len(pair) else np.empty(0, np.int64)
        weight = np.zeros(len(symbol) + 1, np.int64)  # of the pair at place i, at i + 1
        often = count[pair] > 1
        place, pair = place[often], pair[often]
        # equally frequent pairs win in a shuffled order, as an order by place would choose one pair of many in a row
        draw = np.random.default_rng(len(count)).permutation(len(count))
        weight[place + 1] = count[pair] * (len(symbol) + 1) + draw[pair]
        wins = (weight[place + 1] > weight[place]) & (weight[place + 1] > weight[np.minimum(place + 2, len(symbol))])
        place, pair = place[wins], pair[wins]
        if len(pair):
            again = np.bincount(pair)[pair] > 1
            place, pair = place[again], pair[again]
        return place, pair

    def tree(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first position, boundary, end) of the nodes that join the start sequences in balanced trees."""
        if not len(self.start_at):
            return (np.empty(0, np.int64),) * 3
        new = np.flatnonzero(np.diff(self.start_doc, prepend=-1))
        low, high = new, np.append(new[1:], len(self.start_at))
        edge = np.append(self.start_at, 0)  # end of the symbols before place i, for the inner places
        last = ends[self.start_doc[low]]
        out = []
        while len(low):
            inner = high - low >= 2
            low, high, last = low[inner], high[inner], last[inner]
            middle = (low + high) // 2
            out.append((edge[low], edge[middle], last))
            low, high, last = np.append(low, middle), np.append(middle, high), np.append(edge[middle], last)
        return tuple(map(np.concatenate, zip(*out)))


# --- how far two places agree -----------------------------------------------------------------
class Hashes:
    """Sums of scrambled words times powers, modulo 2^64; equal stretches always have equal hashes."""

    def __init__(self, words: np.ndarray):
        n, base = len(words), np.uint64(0x9E3779B97F4A7C15)
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base)]), dtype=np.uint64)
        values = common.mix(words.astype(np.uint64) + np.uint64(1)) * self.power[:-1]
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])

    def equal(self, a: np.ndarray, b: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Whether ``width`` words from a and from b (a <= b) agree."""
        return (self.sums[a + width] - self.sums[a]) * self.power[b - a] == self.sums[b + width] - self.sums[b]


class Ranks:
    """Exact ranks of all stretches of a power of two words; takes their place should hashes collide."""

    def __init__(self, words: np.ndarray):
        self.levels, n = [pd.factorize(words)[0].astype(np.int64)], len(words)
        while (1 << len(self.levels)) <= n:
            half, last = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(pd.factorize(last[: len(last) - half] * (n + 1) + last[half:])[0].astype(np.int64))

    def equal(self, a: np.ndarray, b: np.ndarray, width: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        for k, level in enumerate(self.levels):
            own = np.flatnonzero((width >> k) == 1)
            shift = width[own] - (1 << k)
            for move in (0, shift):
                out[own] &= level[a[own] + move] == level[b[own] + move]
        return out


def reach(equal, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """Words that agree from a and b on, or before them, up to ``most``."""
    low, high = np.zeros(len(a), np.int64), np.maximum(most, 0)
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_] + 1) // 2
        move = middle if back else 0
        good = equal(a[open_] - move, b[open_] - move, middle)
        low[open_[good]] = middle[good]
        high[open_[~good]] = middle[~good] - 1
    return low


# --- runs -------------------------------------------------------------------------------------
class Seeds:
    """All places of the words' triples, by triple and position; triples of two documents differ."""

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        n, kinds = len(words), np.int64(words.max()) + 1 if len(words) else 1
        inside = np.flatnonzero(doc[: max(0, n - 2)] == doc[2:])
        pairs, _ = pd.factorize((doc[inside].astype(np.int64) * kinds + words[inside]) * kinds + words[inside + 1])
        triple, _ = pd.factorize(pairs.astype(np.int64) * kinds + words[inside + 2])
        self.width = np.int64(n + 1)
        self.triple = np.full(n + 1, -1, np.int64)
        repeated = np.bincount(triple)[triple] > 1 if len(triple) else np.empty(0, bool)
        self.triple[inside[repeated]] = triple[repeated]
        self.keys = np.sort(triple[repeated] * self.width + inside[repeated])

    def ranges(self, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of ``keys`` with the triple at ``place`` from ``low`` on and ending by ``high``."""
        usable = (place >= low) & (place + SEED_WORDS <= high)
        triple = self.triple[np.where(usable, place, 0)]
        usable &= triple >= 0
        begin = np.searchsorted(self.keys, triple * self.width + low)
        end = np.searchsorted(self.keys, triple * self.width + high - SEED_WORDS, "right")
        return begin, np.where(usable, end, begin)


def crossing(seeds: Seeds, equal, low: np.ndarray, cut: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Rows (node, start, end, period): the runs inside [low, high) that cross or touch the boundary ``cut``."""
    wide = np.flatnonzero(high - low >= LEAST_WORDS)
    found = [np.empty((0, 4), np.int64)]
    for before in (0, SEED_WORDS):
        place = cut[wide] - before
        begin, end = seeds.ranges(place, low[wide], high[wide])
        some = np.flatnonzero(end - begin > 1)  # one is the place itself
        total = np.cumsum(end[some] - begin[some])
        blocks = np.unique(np.searchsorted(total, np.arange(0, int(total[-1]) + CANDIDATES, CANDIDATES), "right")) if len(some) else []
        for a, b in zip(blocks, [*blocks[1:], len(some)]):
            if a == b:
                continue
            own = some[a:b]
            count = end[own] - begin[own]
            node = np.repeat(wide[own], count)
            nth = np.arange(len(node)) - np.repeat(np.cumsum(count) - count, count)
            other = seeds.keys[np.repeat(begin[own], count) + nth] % seeds.width + before
            here = cut[node]
            differs = other != here
            node, other, here = node[differs], other[differs], here[differs]
            first, second = np.minimum(here, other), np.maximum(here, other)
            start = first - reach(equal, first, second, first - low[node], True)
            stop = second + reach(equal, first, second, high[node] - second, False)
            period = second - first
            good = stop - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
            found.append(smallest(np.stack([node, start, stop, period], axis=1)[good]))
    return smallest(np.concatenate(found))


def smallest(rows: np.ndarray) -> np.ndarray:
    """Of rows that share all but the period, the one with the smallest: the others have multiples of it."""
    rows = rows[np.lexsort(rows.T[::-1])]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :-1] != rows[:-1, :-1]).any(axis=1)
    return rows[new]


def merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of the maximal runs, ordered: overlapping intervals of one period are one run."""
    if not len(start):
        return np.empty((0, 3), np.int64)
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    width = int(end.max()) + 1
    upto = np.maximum.accumulate(period * width + end)
    new = np.ones(len(start), bool)
    new[1:] = (period[1:] != period[:-1]) | (start[1:] > upto[:-1] % width - period[1:])
    first = np.flatnonzero(new)
    return smallest(np.stack([start[first], np.maximum.reduceat(end, first), period[first]], axis=1))


def holds(runs: np.ndarray, words: np.ndarray, doc: np.ndarray) -> bool:
    """Whether the words themselves have these runs, and none of them can be prolonged."""
    start, end, period = runs.T
    count = end - period - start
    place = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
    if (words[place] != words[place + np.repeat(period, count)]).any():
        return False
    for edge, near, far in ((start > 0, start - 1, start - 1 + period), (end < len(words), end, end - period)):
        near, far = near[edge], far[edge]
        if ((words[near] == words[far]) & (doc[near] == doc[far])).any():
            return False
    return True


def group_runs(words: np.ndarray, doc: np.ndarray, ends: np.ndarray, ways=(Hashes, Ranks)) -> np.ndarray:
    """Rows (start, end, period) of all runs; ``doc`` numbers the documents of the words, ``ends`` are theirs."""
    grammar, seeds = Grammar(words, doc), Seeds(words, doc)
    for way in ways:
        equal = way(words).equal
        rules = crossing(seeds, equal, grammar.rule_at, grammar.rule_cut, grammar.rule_end)
        order = np.argsort(grammar.used_rule, kind="stable")
        used_at, used_rule = grammar.used_at[order], grammar.used_rule[order]
        begin, end = np.searchsorted(used_rule, rules[:, 0]), np.searchsorted(used_rule, rules[:, 0], "right")
        count = end - begin
        row = np.repeat(np.arange(len(rules)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        shift = used_at[np.repeat(begin, count) + nth] - grammar.rule_at[rules[row, 0]]
        top = crossing(seeds, equal, *grammar.tree(ends))
        runs = merged(
            np.concatenate([rules[row, 1] + shift, top[:, 1]]), np.concatenate([rules[row, 2] + shift, top[:, 2]]),
            np.concatenate([rules[row, 3], top[:, 3]]),
        )
        if holds(runs, words, doc):
            return runs
    raise AssertionError("exact ranks gave a run that the words do not have")


# --- documents --------------------------------------------------------------------------------
def summary(words: list[bytes], at: np.ndarray | None, runs: np.ndarray) -> tuple:
    """The result's columns for one document; ``runs`` are (start, end, period) in its own numbers, ordered."""
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs.tolist())
    best = max(runs.tolist(), key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
    longest = (None,) * 4
    if best:
        length = best[1] - best[0]
        longest = (best[0], length, best[2], 1000 * length // best[2])
    kept = words if at is None else [words[k] for k in at.tolist()]
    if best:
        change = np.zeros(len(kept) + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 1], -1)
        kept = [kept[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    digest = [hashlib.sha256(x).hexdigest() for x in (listed.encode(), b" ".join(kept))]
    return (len(runs), *longest, *digest)


def several(docs: list[tuple[str | None, list[bytes]]]) -> list[tuple]:
    """``summary`` of several documents that are compressed side by side."""
    places = [planted(d, len(w)) for d, w in docs]
    sizes = np.array([len(w) for _, w in docs], np.int64)
    ends = np.cumsum(sizes)
    flat = np.empty(int(ends[-1]), object)
    flat[:] = [w for _, words in docs for w in words]
    numbers = pd.factorize(flat)[0].astype(np.int64)
    starts = ends - sizes
    for k, at in enumerate(places):
        if at is not None:
            numbers[starts[k] : ends[k]] = numbers[starts[k] + at]
    doc = np.repeat(np.arange(len(docs)), sizes)
    runs = group_runs(numbers, doc, ends)
    cuts = np.searchsorted(runs[:, 0], np.append(starts, ends[-1]))
    shifts = np.array([1, 1, 0])
    out = []
    for k, (_, words) in enumerate(docs):
        own = runs[cuts[k] : cuts[k + 1]] - starts[k] * shifts
        out.append(summary(words, places[k], own[np.lexsort((own[:, 2], own[:, 0]))]))
    return out


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli"]


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id with the number of runs, the longest run and the digests of all runs and of the collapsed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            group: list[tuple[str | None, list[bytes]]] = []
            n = 0
            for doc_id, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = common.space_words(text)
                if group and n + len(words) > GROUP_WORDS:
                    rows += several(group)
                    group, n = [], 0
                group.append((doc_id, words))
                n += len(words)
            if group:
                rows += several(group)
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.string()) for c in columns[5:])],
                names=["doc_id", *COLUMNS, "runs_sha256", "collapsed_sha256"],
            )

    slim = docs.select("doc_id", F.col("doc_id").cast("string").alias("decimal_"), F.col("text").cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    numbers = ", ".join(f"{c} long" for c in COLUMNS)
    return slim.mapInArrow(run, f"doc_id {kind}, {numbers}, runs_sha256 string, collapsed_sha256 string")


@common.query("op11_periodic_runs")
def op11_periodic_runs(spark, sf_dir):
    return find_runs(common.table(spark, sf_dir, "documents"))
