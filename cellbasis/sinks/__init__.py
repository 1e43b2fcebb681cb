"""Sinks: bands, record, images, styles."""
