"""sources of the engine (see README)."""
