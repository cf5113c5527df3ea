"""lodestack.functions."""
