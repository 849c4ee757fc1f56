"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has a bit set where over half of the XXH64 hashes of its word shingles have it.  Every
distinct fingerprint emits itself and its 64 one-bit variants; two fingerprints that differ in two bits or
fewer meet in a variant that lies within one bit of both.  Variants are the shuffle key.  What meets in a
variant fits in a 64-bit mask of flipped bits and a flag, so a bucket is one fixed-width row with at most
65 members, however many documents there are.  A bucket gives star edges to one of its members, not all
pairs; edges are made distinct and checked by their bit distance.  Components of the distinct fingerprints
come from repeated minimum labels with pointer jumping over written tables.

Defined results: a null, empty or blank text has no words and fingerprint zero, linked like any other; a
text of fewer words than the shingle is one shingle; copies share a fingerprint and meet in one aggregation;
a null doc_id is never a component's smallest id unless there is no other; repeated rows give repeated
results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosa.llm import common
from glosa.session import written

#: Contract of the shingles.
SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: Hashes whose bits are counted at once, to bound memory on long texts.
BLOCK = 65_536


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint as a signed number."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(common.LOWER_TABLE).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    last = ends[-n:].tolist()
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, BLOCK):
        some = zip(first[at : at + BLOCK], last[at : at + BLOCK], strict=True)
        raw = b"".join([digest(line[a:b], SEED) for a, b in some])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int32)
    packed = np.packbits(2 * counts > n).tobytes()
    return int.from_bytes(packed, "big", signed=True)


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """Fingerprint of a text column."""

    @F.pandas_udf("long")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        common.kept()
        for batch in series:
            yield pd.Series([fingerprint(t, shingle) for t in batch], dtype="int64")

    return run(F.coalesce(text.cast("string"), F.lit("")))


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (a, b) whose closure links all fingerprints of ``distinct`` within ``max_bits`` (1 or 2)."""
    if max_bits not in (1, 2):
        raise ValueError("the ball of radius one covers distances 1 and 2")
    flips = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), k) for k in range(64)])
    emitted = distinct.select("fp", F.explode(flips).alias("flip"))
    met = emitted.select(F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"), "flip")
    buckets = met.groupBy("variant").agg(F.bit_or("flip").alias("flips"), F.max(F.col("flip") == 0).alias("centre"))
    crowded = buckets.filter(F.bit_count("flips") + F.col("centre").cast("int") >= 2)
    if max_bits == 1:
        crowded = crowded.filter("centre")
    bit = F.array(*[F.shiftleft(F.lit(1).cast("long"), k) for k in range(64)])
    around = F.transform(
        F.filter(bit, lambda b: F.col("flips").bitwiseAND(b) != 0), lambda b: F.col("variant").bitwiseXOR(b)
    )
    # the centre is a member where it was emitted; otherwise the first neighbour is the hub
    hub = F.when(F.col("centre"), F.col("variant")).otherwise(around[0])
    edges = crowded.select(hub.alias("a"), F.explode(around).alias("b")).filter("a <> b")
    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return ordered.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component, for the nodes of ``edges``.

    Each round takes the smallest label among a node's neighbours and then the label of that label.  Rounds
    are written tables, so a lost executor costs one round at most.
    """
    ways = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ways = written(ways, "links")
    labels = ways.groupBy("a").agg(F.min("b").alias("b"))
    labels = written(labels.select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = ways.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels.node == near.a).select("node", F.least("label", "near").alias("to"), "label")
        hooked = written(hooked, "hooks")
        onto = hooked.select(F.col("node").alias("to"), F.col("to").alias("next"))
        jumped = hooked.join(onto, "to").select("node", F.col("next").alias("label"), F.col("label").alias("before"))
        jumped = written(jumped, "labels")
        labels = jumped.select("node", "label")
        if jumped.filter("label <> before").isEmpty():
            return labels


def grouped(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, label, component_id) of every distinct fingerprint in ``prints`` (doc_id, fp)."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-prints")
    labels = components(links(distinct, max_bits))
    known = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    known = known.select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    smallest = known.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return written(known.join(smallest, "label").select("fp", "label", "component_id"), "components")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id for every document."""
    prints = written(docs.select("doc_id", fingerprints(F.col("text"), shingle).alias("fp")), "prints")
    out = prints.join(grouped(prints, max_bits), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each group of near copies, with all its columns: the smallest doc_id, nulls last.

    Rows that share this id too are told apart by the row number they got when the table was written.
    """
    rows = common.packed(docs).select(
        F.monotonically_increasing_id().alias("uid_"), fingerprints(common.field("text"), shingle).alias("fp"), "row_"
    )
    rows = written(rows, "printed")
    keys = rows.select("uid_", "fp", common.field("doc_id").alias("doc_id"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("uid_")))
    first = keys.groupBy("fp").agg(best.alias("best"))  # copies meet before the join
    groups = grouped(keys.select("doc_id", "fp"), max_bits)
    winners = first.join(groups, "fp").groupBy("label").agg(F.min("best").alias("best")).select(F.col("best.uid_"))
    return rows.join(winners, "uid_", "left_semi").select("row_.*")


@common.query("op7_simhash")
def op7_simhash(spark, sf_dir):
    return near_duplicates(common.table(spark, sf_dir, "documents"))
