"""The queries of this repository over the shared test tables, each with its SQL."""

from __future__ import annotations


def all_queries() -> dict:
    from catalog import documents, geometry, logs, registry

    return {**geometry.QUERIES, **documents.QUERIES, **registry.QUERIES, **logs.QUERIES}
