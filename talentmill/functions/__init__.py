"""Column-level building blocks: vocabularies, text rules, vectors, numbers."""
