"""lodestack.queries."""
