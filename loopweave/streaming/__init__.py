"""streaming of the engine (see README)."""
