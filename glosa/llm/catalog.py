"""All queries of this package and their check statements."""

from __future__ import annotations

from glosa.llm import (  # noqa: F401  (importing registers)
    bpe_codec,
    chat_formatting,
    common,
    decontamination,
    filter_audit,
    lm_scoring,
    packing,
    periodic_runs,
    quality_classifier,
    quality_rules,
    secrets,
    simhash,
    substring_dedup,
    token_counts,
)


def queries() -> dict:
    return dict(common.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(common.ORACLES)
