"""plans of the engine (see README)."""
