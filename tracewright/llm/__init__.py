"""Training-data operators: packing, token files, deduplication, scoring, scans and filters.

Nothing else in the library imports this subpackage.
"""
