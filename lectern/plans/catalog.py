"""All queries of the engine by name, with the SQL that checks them."""

from __future__ import annotations

from lectern.plans import answers, ingest, records, registry, search, storage, texts

__all__ = ["FLAGSHIP", "answers", "ingest", "oracle_sql", "queries", "records", "search", "storage", "texts"]

FLAGSHIP = search.rank_metrics


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
