"""chunking of the engine."""
