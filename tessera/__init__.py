"""Structured state at scale on PySpark: typed tables, dynamic documents, hashes, deltas, schemas and framed streams."""
