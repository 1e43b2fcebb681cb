"""Structured Streaming forms of the fold and of sorties."""
