"""lodestack.streaming."""
