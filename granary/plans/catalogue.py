"""All registered queries: importing this module registers them."""

from granary.plans import chunk_queries, content_queries, derive_queries, graph_queries, namespace_queries, registry, selection_queries, source_queries, stats_queries, stream_queries  # noqa: F401

QUERIES, ORACLE_SQL = registry.QUERIES, registry.ORACLE_SQL
