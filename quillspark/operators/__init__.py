"""DataFrame operators: deduplication, search, extraction, enrichment, snapshots, reports, operations."""
