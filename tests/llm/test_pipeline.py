"""The pipeline against a plain version, its stages on awkward rows, and the statements of the queries."""

import math
import weakref

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glosa.llm import bpe_codec, catalog, common, quality_rules, secrets
from glosa.llm.pretokens import public_pattern
from tests.llm import brute
from tests.llm.conftest import SF


def cell(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in "documents benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = catalog.queries()[name](spark, SF)
    cursor = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(result.columns)
    rows = result.select(*names).collect()
    assert sorted(tuple(map(cell, r)) for r in rows) == sorted(tuple(map(cell, r)) for r in cursor.fetchall())


def test_all_queries_are_there():
    assert {int(n[2:].split("_")[0]) for n in catalog.queries()} == set(range(1, 14))


def test_pipeline_against_plain_version(spark, documents, labels, benchmark_table):
    judged = quality_rules.judge(documents, labels).filter("kept").select("doc_id").collect()
    good = {r.doc_id for r in judged}  # the forest itself is tested by hand elsewhere
    rows = [(r.doc_id, r.text) for r in documents.collect() if r.doc_id in good]
    prints = {d: brute.fingerprint(t) for d, t in rows}
    label = brute.linked(prints.values())
    first = {}
    for d, f in prints.items():
        first[label[f]] = min(d, first.get(label[f], d))
    rows = [(d, t) for d, t in rows if d in set(first.values())]
    items = [(r.item_id, r.text) for r in benchmark_table.collect()]
    dirty = {d for d, n, hit, _ in brute.contamination(rows, items) if hit and 20 * hit >= n}
    rows = [(d, t) for d, t in rows if d not in dirty]
    import tiktoken

    path = common.tokenizer_path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("t", pat_str=bpe_codec.public_pattern(), mergeable_ranks=bpe_codec.read_ranks(path), special_tokens={})
    want = {}
    for d, t in rows:
        out, at = "", 0
        for start, _, end in brute.secret_spans(t):
            if start >= at:
                out += t[at:start] + "[REDACTED]"
            at = max(at, end)
        want[d] = own.encode_ordinary(out + t[at:])
    got = {r.doc_id: list(r.token_ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("rows", ["edge", "empty"])
def test_stages_on_awkward_rows(spark, edge, rows):
    docs = edge if rows == "edge" else edge.limit(0)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
            assert out.schema.simpleString() == docs.schema.simpleString(), name
        assert (out.count() > 0) == (rows == "edge"), name


def test_redacted_lengths_and_marks(spark, edge):
    out = corpus_pipeline.without_secrets(spark, edge, SF)
    assert out.filter("text IS NOT NULL").filter(F.length("text") != F.col("n_chars")).count() == 0
    assert "[REDACTED]" in out.filter("doc_id = 10").first().text
    assert secrets.report(out).filter(F.size("spans_") > 0).count() == 0


def test_worker_keeps_the_tables_of_one_operator():
    own = bpe_codec.codec(common.tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_pattern())
    assert bpe_codec.codec(common.tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_pattern()) is own
    gone = weakref.ref(own)
    del own
    assert common.kept("another", list) == [] and gone() is None
    assert common.kept() is None and common.kept("another", lambda: [1]) == [1]
    common.kept()
