"""operators of the engine (see README)."""
