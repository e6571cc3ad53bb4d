"""Readers and writers for landed payloads, tables, sketches, pairs and summaries."""
