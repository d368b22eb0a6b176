"""Plan helpers: lineage cuts and sessions."""
