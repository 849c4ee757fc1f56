"""Secret scans through a trigram inverted index, with DataFrame functions only.

Each rule's pattern gives a Boolean trigram query (``trigrams``).  The index holds one posting (trigram,
document key) for every trigram of any query that a text contains; it is written as a table.  Postings of a
key are intersected with OR over alternatives of AND over trigrams, in one aggregation whose partial results
are merged before the shuffle.  Candidates are joined back to the documents by key and verified with the
pattern itself, rule by rule; rules without mandatory trigrams (long hexadecimal runs) scan every text.

Places come from ``split`` and ``regexp_extract_all``: what lies between matches and the matches themselves
add up to starts and ends in code points.

Defined results: a null or empty text has no spans; the key is a hash of id and text, so equal rows share
candidates and a collision only adds a text to verify; repeated rows are each reported; further columns are
kept by ``redact`` and never read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosa.llm import common
from glosa.llm.trigrams import trigram_query
from glosa.session import compute_once, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def any_case(word: str) -> str:
    """The ASCII word with either case for each letter."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(any_case, ("password", "passwd", "secret", "token")), any_case("api") + "_?" + any_case("key")])
_VALUE = r"[A-Za-z0-9+/_.=-]+"

#: Fixed rules of the contract.  A hexadecimal match is a whole run, so its least length can stand inside.
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?({_VALUE})""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Further kinds.
MORE = (
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("bearer", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
RULES = BASE + MORE
#: Trigrams in one 64-bit mask.
MASK = 60


def key() -> Column:
    return F.xxhash64("doc_id", "text")


def postings(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """The index: (trigram number, key) for each of the ``wanted`` trigrams that a text contains."""
    low = compute_once(docs.select(key().alias("key"), "text"), {"low": F.lower("text")}).select("key", "low")
    numbered = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for i, t in enumerate(wanted)])
    found = F.transform(F.filter(numbered, lambda p: F.contains(F.col("low"), p["t"])), lambda p: p["i"])
    return low.select("key", F.explode(found).alias("trigram"))


def candidates(index: DataFrame, queries: list, wanted: list[str]) -> DataFrame:
    """(key, rules): a bit for each rule whose query the key's trigrams fulfil."""
    number = {t: i for i, t in enumerate(wanted)}
    masks = range(-(-len(wanted) // MASK))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("trigram") % MASK)
    part = F.floor(F.col("trigram") / MASK)
    found = index.groupBy("key").agg(
        *[F.coalesce(F.bit_or(F.when(part == m, bit)), F.lit(0).cast("long")).alias(f"m{m}") for m in masks]
    )

    def all_of(grams) -> Column:
        out = F.lit(True)
        for m in masks:
            need = sum(1 << number[t] % MASK for t in grams if number[t] // MASK == m)
            if need:
                out = out & (F.col(f"m{m}").bitwiseAND(F.lit(need)) == need)
        return out

    bits = [
        F.when(reduce(lambda a, b: a | b, [all_of(g) for g in sorted(q, key=sorted)]), F.lit(1 << r)).otherwise(0)
        for r, q in queries
    ]
    rules = reduce(lambda a, b: a.bitwiseOR(b), [b.cast("long") for b in bits])
    return found.select("key", rules.alias("rules")).filter("rules <> 0")


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end) of the rule's matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    rows = F.arrays_zip(
        F.transform(found, F.length).alias("size"), F.transform(group, F.length).alias("own"),
        F.transform(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found)), F.length).alias("gap"),
    )
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def step(state, row):
        start = state["at"] + row["gap"]
        end = start + row["size"]
        span = F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end"))
        kept = F.when(row["own"] >= rule.least, F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct(end.alias("at"), kept.alias("out"))

    begin = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    spans = F.aggregate(rows, begin, step, lambda state: state["out"])
    return F.when(F.rlike(text, F.lit(rule.pattern)), spans).otherwise(empty)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` as ``row_`` with ``spans_``: (start, kind, end) sorted, kind a place in ``rules``."""
    queries = [(r, trigram_query(rule.pattern)) for r, rule in enumerate(rules)]
    full = {r for r, q in queries if frozenset() in q}  # nothing mandatory
    indexed = [(r, q) for r, q in queries if r not in full]
    wanted = sorted({t for _, q in indexed for grams in q for t in grams})
    texts = docs.select("doc_id", common.text_or_empty().alias("text"))
    rows = common.packed(docs).select(
        F.xxhash64(common.field("doc_id"), F.coalesce(common.field("text"), F.lit(""))).alias("key"), "row_"
    )
    if indexed:
        index = written(postings(texts, wanted), "trigram-index")
        rows = rows.join(candidates(index, indexed, wanted), "key", "left")
    else:
        rows = rows.withColumn("rules", F.lit(0).cast("long"))
    text = F.coalesce(common.field("text"), F.lit(""))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found = []
    for r, rule in enumerate(rules):
        spans = spans_of(text, rule, r)
        chosen = F.coalesce(F.col("rules"), F.lit(0)).bitwiseAND(F.lit(1 << r)) != 0
        found.append(spans if r in full else F.when(chosen, spans).otherwise(empty))
    return rows.select("row_", F.array_sort(F.concat(*found)).alias("spans_"))


def lines(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    texts = F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"]))
    return F.array_join(texts, ",")


def of_kinds(spans: Column, kinds: range) -> Column:
    return F.filter(spans, lambda s: (s["kind"] >= kinds.start) & (s["kind"] < kinds.stop))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[REDACTED]") -> DataFrame:
    """The table with every span replaced by ``mark``; overlapping spans share one mark."""
    text = common.field("text")

    def step(state, s):
        fresh = s["start"] >= state["at"]
        piece = F.substr(text, state["at"] + 1, s["start"] - state["at"])
        out = F.when(fresh, F.concat(state["out"], piece, F.lit(mark))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(
        F.col("spans_"), begin, step, lambda state: F.concat(state["out"], F.substr(text, state["at"] + 1))
    )
    rows = scan(docs, rules)
    new = F.when(F.size("spans_") > 0, clean).otherwise(text)
    return rows.withColumn("row_", F.col("row_").withField("text", new)).select("row_.*")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and ``spans_`` for every document."""
    return scan(docs, rules).select(common.field("doc_id").alias("doc_id"), "spans_")


def _sql() -> str:
    def spans(r: int, rule: Rule) -> str:
        pattern = rule.pattern.replace("'", "''")
        return f"""SELECT row, {r} AS kind, start, start + len(found[i]) AS stop FROM (
            SELECT row, i, found, own, list_sum(list_transform(gaps[1:i], lambda g: len(g)))
              + coalesce(list_sum(list_transform(found[1:i-1], lambda m: len(m))), 0) AS start
            FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (
              SELECT row, regexp_extract_all(text, '{pattern}', 0) AS found, regexp_extract_all(text, '{pattern}', {rule.group}) AS own,
                string_split_regex(text, '{pattern}') AS gaps FROM docs WHERE regexp_matches(text, '{pattern}')))
            ) WHERE len(own[i]) >= {rule.least}"""

    kinds = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
    every = " UNION ALL ".join(spans(r, rule) for r, rule in enumerate(RULES))
    line = f"{kinds}[kind + 1] || ':' || start::BIGINT || ':' || stop::BIGINT"
    return f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({every}),
joined AS (SELECT row, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS k, count(*) FILTER (kind = 2) AS h,
  string_agg({line}, ',' ORDER BY start, kind) FILTER (kind < {len(BASE)}) AS base,
  string_agg({line}, ',' ORDER BY start, kind) AS line FROM spans GROUP BY row)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(line, '') AS spans
FROM docs LEFT JOIN joined USING (row)
"""


@common.query("op6_secret_scan", _sql())
def op6_secret_scan(spark, sf_dir):
    spans, base = F.col("spans_"), range(len(BASE))
    counts = [F.size(of_kinds(spans, range(k, k + 1))).cast("long").alias(f"n_{BASE[k].kind}") for k in base]
    return report(common.table(spark, sf_dir, "documents")).select(
        "doc_id", *counts, F.sha2(lines(of_kinds(spans, base)), 256).alias("base_sha256"), lines(spans).alias("spans")
    )
