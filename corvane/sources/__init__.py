"""Readers, parsers and importers."""
