"""lodestack.plans."""
