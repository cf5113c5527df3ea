"""lodestack.sources."""
