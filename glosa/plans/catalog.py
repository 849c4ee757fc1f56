"""All registered queries."""

from __future__ import annotations

from glosa.plans import culture_queries, geo_queries, learn_queries, registry, source_queries, stats_queries, text_queries  # noqa: F401

FLAGSHIP = "E1_geographic_analysis"


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
