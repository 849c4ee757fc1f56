"""Chat formatting as a prefix tree: turns that conversations share from the start are emitted once.

A turn becomes ``[INST] role [/INST] text </s>``; backslash, ``[`` and ``<`` inside a role or a text are escaped
by a backslash, so the control strings occur only where the template puts them.  A tree node is a turn with
all turns before it; its key is a chained hash.  Equal conversations are merged first.  Then the distinct ones
are range-partitioned and sorted by their paths of keys: a conversation emits the nodes that it does not
share with the one before it, which is depth-first order.  Tokens before a range and the open ancestors at its
start come from one small summary per range, folded in order on the driver (offsets only, no texts).

Every node gets its offset in the emitted stream, position ids that go on from its parent, the token span
under the loss mask (the text of assistant turns) and the intervals of the stream that its tokens may attend
to besides themselves: its ancestors, neighbouring intervals merged.

Defined results: null texts and roles are empty; turns are ordered by number (null first), then role, then
text, so ties and repeated rows have one order; rows without conv_id are one conversation; an empty table
gives no rows; further columns are not read.  A conversation is one record: its turns are held together.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosa.llm import common
from glosa.llm.pretokens import public_pattern
from glosa.session import written

OPEN, MIDDLE, CLOSE = "[INST] ", " [/INST] ", " </s>"
ESCAPED = "\\[<"
_BODY = r"((?:[^\\\[<]|\\.)*)"
_TURN = re.compile(re.escape(OPEN) + _BODY + re.escape(MIDDLE) + _BODY + re.escape(CLOSE), re.DOTALL)
KEY = 16  # bytes of a node key


def escape(text: str) -> str:
    return re.sub(r"([\\\[<])", r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


@functools.lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    import tiktoken

    from glosa.llm.bpe_codec import read_ranks

    return tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def node_key(parent: bytes, role: str, text: str) -> bytes:
    body = f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")
    return hashlib.blake2b(parent + body, digest_size=KEY).digest()


def tokens_of(role: str, text: str, own) -> tuple[list[int], int, int]:
    """Token ids of a turn and the span of them under the loss mask; pieces are encoded apart."""
    head, body, tail = (own.encode_ordinary(s) for s in (OPEN + escape(role) + MIDDLE, escape(text), CLOSE))
    first = len(head)
    return head + body + tail, first, first + len(body) if role == "assistant" else first


def paths(turns: Column) -> Column:
    """Concatenated node keys of a conversation's turns."""

    @F.pandas_udf("binary")
    def run(series: pd.Series) -> pd.Series:
        out = []
        for own in series:
            key, path = b"", []
            for t in own:
                key = node_key(key, t["role"], t["text"])
                path.append(key)
            out.append(b"".join(path))
        return pd.Series(out, dtype=object)

    return run(turns)


def gathered(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) with the turns in order."""
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"), common.text_or_empty("role").alias("role"),
        common.text_or_empty("text").alias("text"),
    )
    return conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def shared(a: bytes, b: bytes) -> int:
    """Nodes at the start of two paths that are the same."""
    n = min(len(a), len(b)) // KEY
    return next((k for k in range(n) if a[k * KEY : (k + 1) * KEY] != b[k * KEY : (k + 1) * KEY]), n)


def coded(turns: Column, vocabulary: str, pattern: str) -> Column:
    """Struct of a conversation's token ids, one turn after another, and per turn their number and loss span."""

    @F.pandas_udf("ids binary, lengths array<int>, low array<int>, high array<int>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = encoding(vocabulary, pattern)
        for batch in series:
            rows = []
            for conversation in batch:
                parts = [tokens_of(t["role"], t["text"], own) for t in conversation]
                ids = np.concatenate([np.array(p[0], np.int32) for p in parts])
                rows.append((ids.tobytes(), [len(p[0]) for p in parts], [p[1] for p in parts], [p[2] for p in parts]))
            yield pd.DataFrame(rows, columns=["ids", "lengths", "low", "high"])

    return run(turns)


def walk(group: pd.DataFrame, before: bytes, stack: list[int], offset: int) -> Iterator[tuple]:
    """Nodes that sorted conversations emit: (row, depth, offset, position, ancestors).

    ``before`` is the path of the conversation before the first one and ``stack`` the offsets of its nodes.
    """
    stack, lengths = list(stack), []
    for row, (path, own) in enumerate(zip(group["path"], group["lengths"], strict=True)):
        kept = shared(before, path)
        if len(lengths) < kept:  # ancestors that an earlier range emitted
            lengths = [int(n) for n in own[:kept]]
        del stack[kept:], lengths[kept:]
        for depth in range(kept, len(own)):
            ancestors: list[list[int]] = []
            for start, length in zip(stack, lengths, strict=True):
                if ancestors and ancestors[-1][1] == start:
                    ancestors[-1][1] += length
                else:
                    ancestors.append([start, start + length])
            yield row, depth, offset, sum(lengths), ancestors
            stack.append(offset)
            lengths.append(int(own[depth]))
            offset += lengths[-1]
        before = path


NODES = (
    "key binary, depth int, offset long, position long, tokens array<int>, loss_from int, loss_to int, "
    "ancestors array<struct<start: long, end: long>>"
)


def tree(distinct: DataFrame, vocabulary: str, pattern: str | None = None) -> DataFrame:
    """The emitted nodes of distinct conversations (path, turns), one row each, with position ids."""
    pattern, n = pattern or public_pattern(), common.parts(distinct.sparkSession)
    tokens = distinct.select("path", coded(F.col("turns"), vocabulary, pattern).alias("coded")).select("path", "coded.*")
    ranged = written(tokens.repartitionByRange(n, "path").withColumn("range", F.spark_partition_id()), "chat-ranges")

    def summary(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("path", ignore_index=True)
        first, last = group["path"].iloc[0], group["path"].iloc[-1]
        open_at: dict[int, int] = {}
        total = 0
        for row, depth, offset, _, _ in walk(group, b"", [], 0):
            open_at[depth], total = offset, offset + int(group["lengths"].iloc[row][depth])
        ends = [open_at[d] for d in range(len(last) // KEY)]
        lead = [int(n) for n in group["lengths"].iloc[0]]
        return pd.DataFrame([(int(group["range"].iloc[0]), first, last, lead, ends, total)], columns=columns)

    columns = ["range", "first", "last", "lead", "ends", "total"]
    kinds = "range int, first binary, last binary, lead array<long>, ends array<long>, total long"
    lengths = ranged.select("range", "path", "lengths")  # no texts
    ways = sorted(lengths.groupBy("range").applyInPandas(summary, kinds).collect(), key=lambda r: r["first"])
    starts: dict[int, tuple[bytes, list[int], int]] = {}
    before, stack, offset = b"", [], 0
    for r in ways:
        k = shared(before, r["first"])
        starts[r["range"]] = before[: k * KEY], stack[:k], offset
        saved = sum(r["lead"][:k])  # tokens that the summary counted although they were emitted before
        kept = min(k, shared(r["first"], r["last"]))
        stack = stack[:kept] + [offset + at - saved for at in r["ends"][kept:]]
        offset += r["total"] - saved
        before = bytes(r["last"])

    def emit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("path", ignore_index=True)
        out, at = [], [np.concatenate([[0], np.cumsum(n)]) for n in group["lengths"]]
        for row, depth, offset, position, ancestors in walk(group, *starts[int(group["range"].iloc[0])]):
            g = group.iloc[row]
            ids = np.frombuffer(g["ids"], np.int32)[at[row][depth] : at[row][depth + 1]]
            spans = [{"start": s, "end": e} for s, e in ancestors]
            key = g["path"][depth * KEY : (depth + 1) * KEY]
            out.append((key, depth, offset, position, ids, g["low"][depth], g["high"][depth], spans))
        names = ["key", "depth", "offset", "position", "tokens", "loss_from", "loss_to", "ancestors"]
        return pd.DataFrame(out, columns=names)

    nodes = ranged.groupBy("range").applyInPandas(emit, NODES)
    return nodes.withColumn("position_ids", F.sequence(F.col("position"), F.col("position") + F.size("tokens") - 1))


def read_back(tokens: Column, low: Column, high: Column, vocabulary: str, pattern: str) -> Column:
    """Struct of the formatted turn, its role and text, and the unescaped text under the loss mask."""

    @F.pandas_udf("formatted string, role string, text string, loss string")
    def run(series: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        own = encoding(vocabulary, pattern)
        for all_tokens, lows, highs in series:
            rows = []
            for ids, a, b in zip(all_tokens, lows, highs, strict=True):
                ids = [int(i) for i in ids]
                formatted = own.decode_bytes(ids).decode("utf-8", "surrogatepass")
                role, text = _TURN.fullmatch(formatted).groups()
                loss = own.decode_bytes(ids[a:b]).decode("utf-8", "surrogatepass")
                rows.append((formatted, unescape(role), unescape(text), unescape(loss)))
            yield pd.DataFrame(rows, columns=["formatted", "role", "text", "loss"])

    return run(tokens, low, high)


def format_chats(conversations: DataFrame, vocabulary: str, pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(emitted nodes, members): members has conv_id, leaf and the path of each conversation; both written."""
    pattern = pattern or public_pattern()
    whole = gathered(conversations)
    whole = whole.withColumn("path", paths(F.col("turns"))).withColumn("leaf", F.expr(f"substring(path, -{KEY}, {KEY})"))
    whole = written(whole, "chats")
    distinct = whole.groupBy("path").agg(F.min("turns").alias("turns"))
    nodes = written(tree(distinct, vocabulary, pattern), "chat-nodes")
    return nodes, whole.select("conv_id", "leaf", "path")


def digests(nodes: DataFrame, members: DataFrame, vocabulary: str, pattern: str | None = None) -> DataFrame:
    """Per conversation what its nodes in the emitted stream say."""
    pattern = pattern or public_pattern()
    turn = read_back(F.col("tokens"), F.col("loss_from"), F.col("loss_to"), vocabulary, pattern)
    turns = nodes.select("key", turn.alias("turn")).select("key", "turn.*")
    leaves = members.groupBy("leaf").agg(F.min("path").alias("path"))
    at = F.sequence(F.lit(0), (F.length("path") / KEY - 1).cast("int"))
    key = F.substring(F.col("path"), F.col("depth") * KEY + 1, F.lit(KEY))
    steps = written(leaves.select("leaf", "path", F.explode(at).alias("depth")).select("leaf", "depth", key.alias("key")), "chat-steps")
    rows = steps.join(written(turns, "chat-turns"), "key")
    parts = F.array_sort(F.collect_list(F.struct("depth", "formatted", "role", "text", "loss")))
    whole = rows.groupBy("leaf").agg(parts.alias("parts"))

    def joined(piece) -> Column:
        return F.array_join(F.transform("parts", piece), "")

    said = whole.select(
        "leaf", F.size("parts").cast("long").alias("n_turns"),
        F.sha2(joined(lambda p: F.concat(p["role"], F.lit("\n"), p["text"], F.lit("\n"))), 256).alias("turns_sha256"),
        F.length(joined(lambda p: p["loss"])).cast("long").alias("loss_chars"),
        F.sha2(joined(lambda p: p["loss"]), 256).alias("loss_sha256"),
        F.length(joined(lambda p: p["formatted"])).cast("long").alias("formatted_chars"),
    )
    return members.select("conv_id", "leaf").join(written(said, "chat-digests"), "leaf").drop("leaf")


#: The conversation of the contract that looks like the template itself.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]

_SQL_ESCAPED = " + ".join(f"len({{0}}) - len(replace({{0}}, '{c}', ''))" for c in ESCAPED)
SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(OPEN + MIDDLE + CLOSE)} + len(role) + len(text) + {_SQL_ESCAPED.format("role")} + {_SQL_ESCAPED.format("text")})::BIGINT
    AS formatted_chars
FROM rows GROUP BY conv_id
"""


@common.query("op2_chat_formatting", SQL)
def op2_chat_formatting(spark, sf_dir):
    given = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    vocabulary = common.tokenizer_path("byte_bpe_50k.tiktoken")
    nodes, members = format_chats(given.unionByName(probe), vocabulary)
    return digests(nodes, members, vocabulary)
