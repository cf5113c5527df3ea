"""lodestack.operators."""
