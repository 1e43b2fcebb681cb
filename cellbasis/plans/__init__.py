"""Composite programs and the registered queries."""
