"""Exact substring deduplication with fixed-block anchors.

Words of every text are laid out in reference blocks: block k of a document is its words [kB, kB + B).  Any
repeat of ``window`` words (2B - 1 or more) covers a whole block of its earlier place, and the window of B
words at the same offset of its later place has the block's hash.  So every rolling window of B words probes
the index of blocks, and hits are extended to all windows of ``window`` words that hold them; equal ones are
found by a 96-bit hash, the earliest place stays, and overlapping windows merge into maximal repeats.

How the rows move.  Documents are packed, compressed, into chunks that are ranges of doc_id, so (chunk,
place in chunk) is the order of places.  A chunk is read three times from the same exchange:
1. it sends its distinct B-word hashes, five bytes each, in one block of bytes per hash range, with two flags
   (at a block of the grid; twice or more here).  Each range answers with a bit per hash: a hash seen twice or
   more, at least once on the grid, is an anchor.
2. windows around anchors are candidates; their distinct 96-bit hashes go to hash ranges, and each range
   answers with a bit per hash: set unless this chunk is the first to have it.
3. the answers mark the words to remove.
However frequent a passage is, a chunk sends each of its windows once; no pairs are formed.

Defined results: a null, empty or blank text has no words and nothing to remove; a null doc_id sorts before
all others; rows that share a doc_id are documents of their own, in the order of their texts; an empty table
gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosa.llm import common
from glosa.llm.pretokens import Memo

#: Contract: words of a window.
WINDOW = 20
#: Chunks for each shuffle partition; a task holds one chunk at a time.
CHUNKS = 2
#: Bytes of text that a packing task gathers before it writes.
PACK_BYTES = 32_000_000
MEMO_LIMIT = 400_000

_memo = None


def word_hashes(words: list[bytes]) -> np.ndarray:
    """(words, 2) 64-bit hashes."""
    global _memo
    if _memo is None:
        import xxhash

        _memo = Memo(xxhash.xxh3_128_digest, MEMO_LIMIT)
    return np.frombuffer(b"".join(map(_memo.__getitem__, words)), np.uint64).reshape(-1, 2)


def bounds_of(docs: DataFrame, chunks: int) -> np.ndarray:
    """chunks - 1 ids that cut the table into ranges of about as many rows."""
    if chunks < 2:
        return np.empty(0, np.int64)
    shares = [k / chunks for k in range(1, chunks)]
    ids = F.percentile_approx(F.col("doc_id").cast("long"), shares, max(10_000, 20 * chunks))
    return np.unique(np.array(docs.agg(ids.alias("ids")).first().ids or [], np.int64))


def pack(docs: DataFrame, bounds: np.ndarray) -> DataFrame:
    """(chunk, pack): the documents of a task by chunk, compressed."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        def rows(held):
            press = zstandard.ZstdCompressor(level=3)
            packs = [press.compress(pickle.dumps(d, protocol=5)) for d in held.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(packs, pa.binary())], ["chunk", "pack"])

        held: dict[int, list] = {}
        size = 0
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            chunks = np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right")
            for chunk, doc, text in zip(chunks.tolist(), ids.to_pylist(), texts, strict=True):
                value = text.as_py()
                held.setdefault(0 if doc is None else chunk, []).append((doc, value))
                size += len(value or "")
                if size > PACK_BYTES:
                    yield rows(held)
                    held, size = {}, 0
        if held:
            yield rows(held)

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ids.mapInArrow(run, "chunk int, pack binary")


class Chunk:
    """Words of a chunk's documents, one after another."""

    def __init__(self, packs, block: int, window: int):
        import zstandard

        docs = [d for p in packs for d in pickle.loads(zstandard.decompress(p))]
        docs.sort(key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
        self.docs, self.block, self.window = docs, block, window
        # words are not kept: as objects they would take several times the texts
        hashed = [word_hashes(common.space_words(text)) for _, text in docs]
        lengths = np.fromiter(map(len, hashed), np.int64, len(docs))
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.hashes = np.concatenate([*hashed, np.empty((0, 2), np.uint64)])
        n = len(self.hashes)
        place = np.arange(n) - np.repeat(self.starts[:-1], lengths)
        left = np.repeat(lengths, lengths) - place
        self.fits = left >= window
        self.anchor_at = np.flatnonzero(left >= block)
        values = common.rolling(self.hashes[:, 0], block)[self.anchor_at]
        self.anchors, self.anchor_of, count = np.unique(values, return_inverse=True, return_counts=True)
        self.on_grid = np.zeros(len(self.anchors), bool)
        self.on_grid[self.anchor_of[place[self.anchor_at] % block == 0]] = True
        self.twice = count > 1

    def candidates(self, is_anchor: np.ndarray) -> None:
        """Windows that hold an anchor, and the distinct ones among them in the order of their hashes."""
        hit = np.zeros(len(self.hashes) + 1, np.int64)
        hit[self.anchor_at] = is_anchor[self.anchor_of]
        before = np.concatenate([[0], np.cumsum(hit)])
        at = np.flatnonzero(self.fits)
        reach = self.window - self.block + 1
        self.at = at[before[at + reach] > before[at]]
        one, two = (common.rolling(self.hashes[:, k], self.window)[self.at] for k in (0, 1))
        order = np.lexsort((two, one))  # stable: places of equal windows stay in order
        one, two = one[order], two[order]
        new = np.ones(len(order), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        self.order, self.group, self.first_here = order, np.cumsum(new) - 1, new
        self.one, self.two = one[new], two[new].astype(np.uint32)

    def removed(self, seen_before: np.ndarray) -> np.ndarray:
        """Mask of the words that a repeated window covers."""
        repeated = self.at[self.order[~self.first_here | seen_before[self.group]]]
        edge = np.zeros(len(self.hashes) + 1, np.int64)
        np.add.at(edge, repeated, 1)
        np.add.at(edge, repeated + self.window, -1)
        return np.cumsum(edge)[:-1] > 0


def ranges(values: np.ndarray, count: int) -> np.ndarray:
    """Where each of ``count`` equal hash ranges begins and ends in sorted 64-bit values."""
    edges = (np.arange(1, count, dtype=object) * (1 << 64) // count).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(values, edges), [len(values)]])


def message(rows):
    """(bucket, chunk, body) as an Arrow table."""
    import pyarrow as pa

    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    kinds = (pa.int32(), pa.int32(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "chunk", "body"])


MESSAGE = "bucket int, chunk int, body binary"


def five_bytes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def from_five_bytes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def answers(bodies, sizes: list[int], flags: np.ndarray, chunks):
    """One row of bits for each sender."""
    ends = np.cumsum(sizes)
    for chunk, bucket, end, size in zip(chunks, bodies, ends, sizes, strict=True):
        own = flags[end - size : end]
        if own.any():
            yield bucket, chunk, np.packbits(own).tobytes()


def spread_bits(answer, at: np.ndarray) -> np.ndarray:
    """Flags of all distinct hashes of a chunk from the answers of the hash ranges."""
    out = np.zeros(int(at[-1]), bool)
    for bucket, body in zip(answer["bucket"].to_pylist(), answer["body"].to_pylist(), strict=True):
        low, high = at[bucket], at[bucket + 1]
        out[low:high] = np.unpackbits(np.frombuffer(body, np.uint8), count=int(high - low))
    return out


def repeats(docs: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """Per document: n_words, n_removed, kept_sha256, spans of removed words and (``keep_text``) the kept words."""
    block = (window + 1) // 2
    n = common.parts(docs.sparkSession)
    bounds = bounds_of(docs, CHUNKS * n)
    packs = pack(docs, bounds).repartition(n, "chunk")

    def ask_anchors(table):
        c = Chunk(table["pack"].to_pylist(), block, window)
        at, chunk = ranges(c.anchors, n), table["chunk"][0].as_py()
        values = (c.anchors << np.uint64(2)) & np.uint64(0xFFFFFFFFFF)  # 38 bits of the hash and two flags
        values = values | c.on_grid.astype(np.uint64) | (c.twice.astype(np.uint64) << np.uint64(1))
        return message([(b, chunk, five_bytes(values[at[b] : at[b + 1]])) for b in range(n) if at[b + 1] > at[b]])

    def find_anchors(table):
        bodies = [from_five_bytes(b) for b in table["body"].to_pylist()]
        values = np.concatenate(bodies)
        keys = values >> np.uint64(2)
        order = np.argsort(keys, kind="stable")
        new = np.ones(len(keys), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        first = np.flatnonzero(new)
        grid = np.maximum.reduceat(values[order] & np.uint64(1), first) > 0
        many = np.add.reduceat(1 + ((values[order] >> np.uint64(1)) & np.uint64(1)), first) > 1
        flags = np.empty(len(keys), bool)
        flags[order] = (grid & many)[np.cumsum(new) - 1]
        return message(answers(table["bucket"].to_pylist(), [len(b) for b in bodies], flags, table["chunk"].to_pylist()))

    def ask_windows(table, anchors):
        if not table.num_rows:
            return message([])
        c = Chunk(table["pack"].to_pylist(), block, window)
        c.candidates(spread_bits(anchors, ranges(c.anchors, n)))
        at, chunk = ranges(c.one, n), table["chunk"][0].as_py()
        cuts = [(b, at[b], at[b + 1]) for b in range(n) if at[b + 1] > at[b]]
        return message([(b, chunk, c.one[i:j].tobytes() + c.two[i:j].tobytes()) for b, i, j in cuts])

    def find_first(table):
        chunks, bodies = table["chunk"].to_pylist(), table["body"].to_pylist()
        sizes = [len(b) // 12 for b in bodies]
        one = np.concatenate([np.frombuffer(b, np.uint64, k) for b, k in zip(bodies, sizes, strict=True)])
        two = np.concatenate([np.frombuffer(b, np.uint32, k, 8 * k) for b, k in zip(bodies, sizes, strict=True)])
        order = np.lexsort((np.repeat(np.array(chunks), sizes), two, one))
        again = np.zeros(len(one), bool)
        again[1:] = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
        flags = np.empty(len(one), bool)
        flags[order] = again
        return message(answers(table["bucket"].to_pylist(), sizes, flags, chunks))

    def cut(table, answer):
        import pyarrow as pa
        import pyarrow.compute as pc

        if not table.num_rows:
            return pa.Table.from_pylist([], schema)
        c = Chunk(table["pack"].to_pylist(), block, window)
        anchors = answer.filter(pc.equal(answer["step"], 1))
        c.candidates(spread_bits(anchors, ranges(c.anchors, n)))
        firsts = answer.filter(pc.equal(answer["step"], 2))
        gone = c.removed(spread_bits(firsts, ranges(c.one, n)))
        rows = []
        for k, (doc, value) in enumerate(c.docs):
            mask = gone[c.starts[k] : c.starts[k + 1]]
            words = common.space_words(value)
            spans: list[dict] = []
            if mask.any():
                change = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))).tolist()
                spans = [{"first": a, "after": b} for a, b in zip(change[::2], change[1::2], strict=True)]
                words = [w for w, g in zip(words, mask.tolist(), strict=True) if not g]
            kept = b" ".join(words)
            text = kept.decode("utf-8", "surrogatepass") if keep_text else None
            rows.append((doc, len(mask), len(mask) - len(words), hashlib.sha256(kept).hexdigest(), spans, text))
        columns = list(zip(*rows, strict=True))
        return pa.table([pa.array(v, f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)

    import pyarrow as pa

    span = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                        ("kept_sha256", pa.string()), ("spans", span), ("kept", pa.string())])
    result = (
        "doc_id long, n_words long, n_removed long, kept_sha256 string, "
        "spans array<struct<first: long, after: long>>, kept string"
    )
    by_chunk = packs.groupBy("chunk")
    asked = by_chunk.applyInArrow(ask_anchors, MESSAGE)
    anchors = asked.groupBy("bucket").applyInArrow(find_anchors, MESSAGE)
    windows = by_chunk.cogroup(anchors.groupBy("chunk")).applyInArrow(ask_windows, MESSAGE)
    firsts = windows.groupBy("bucket").applyInArrow(find_first, MESSAGE)
    both = anchors.withColumn("step", F.lit(1)).unionByName(firsts.withColumn("step", F.lit(2)))
    out = by_chunk.cogroup(both.groupBy("chunk")).applyInArrow(cut, result)
    return out if keep_text else out.drop("kept")


SQL = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text NULLS FIRST) AS row, doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), windows AS (
  SELECT row, i, array_to_string(words[i : i + {WINDOW - 1}], ' ') AS line
  FROM (SELECT row, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM d WHERE len(words) >= {WINDOW})
), later AS (
  SELECT row, i FROM windows QUALIFY row_number() OVER (PARTITION BY line ORDER BY row, i) > 1
), gone AS (
  SELECT DISTINCT row, unnest(range(i, i + {WINDOW})) AS p FROM later
), kept AS (
  SELECT row, string_agg(word, ' ' ORDER BY p) AS line, count(*) AS n
  FROM (SELECT row, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM d) ANTI JOIN gone USING (row, p) GROUP BY row
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(line, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (row)
"""


@common.query("op1_substring_dedup", SQL)
def op1_substring_dedup(spark, sf_dir):
    return repeats(common.table(spark, sf_dir, "documents")).drop("spans")
