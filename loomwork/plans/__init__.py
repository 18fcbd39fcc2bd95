"""Plan-level helpers: lineage cuts, derived views and the query registry."""
