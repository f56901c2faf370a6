"""Training-data operators: filtering, deduplication, scoring, privacy and packing of text tables.

Nothing outside this folder imports it.
"""
