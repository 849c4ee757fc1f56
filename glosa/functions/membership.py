"""Bloom filters as binary literals: which values may be in a large table, asked inside a row.

A filter has one byte for each slot and two slots for each value.  Its size follows the number of values up to a
fixed most, beyond which it only lets more strangers pass, so whoever asks has to verify what passes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots for each value, and slots of the largest filter (bytes on the driver and in the plan).
SLOTS_A_VALUE, LEAST_SLOTS, MOST_SLOTS = 16, 1 << 10, 1 << 22
_SET = b"\x01"


def _slots(value: Column, size: int) -> list[Column]:
    """Zero-based slots of a value."""
    digest = F.xxhash64(value)
    return [F.pmod(h, F.lit(size)).cast("int") for h in (digest, F.shiftright(digest, 32))]


def filters(df: DataFrame, values: dict[str, Column]) -> dict[str, bytes]:
    """One filter for each named column of values, from one pass over the rows after they have been counted."""
    size = LEAST_SLOTS
    while size < min(MOST_SLOTS, SLOTS_A_VALUE * df.count()):
        size *= 2
    slots = [F.struct(F.lit(k).alias("k"), s.alias("s")) for k, v in enumerate(values.values()) for s in _slots(v, size)]
    rows = df.select(F.inline(F.array(*slots)))
    bit = F.expr("shiftleft(1L, s % 64)")
    words = rows.groupBy("k", F.expr("s div 64").alias("at")).agg(F.bit_or(bit).alias("bits")).collect()  # at most size / 64 each
    out = {}
    for k, name in enumerate(values):
        packed = np.zeros(size // 64, np.int64)
        for r in words:
            if r.k == k:
                packed[r["at"]] = r.bits
        out[name] = np.unpackbits(packed.astype("<i8").view(np.uint8), bitorder="little").tobytes()
    return out


def may_contain(bloom: bytes, value: Column) -> Column:
    """Whether the value may be among those of the filter; never false for one that is."""
    hits = [F.substring(F.lit(bloom), s + 1, F.lit(1)) == F.lit(_SET) for s in _slots(value, len(bloom))]
    return hits[0] & hits[1]
