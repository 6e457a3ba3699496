"""Training-data operators: tokenisation, packing, scanning, filtering, dedup, search and extraction.

Nothing else in the library imports this subpackage.
"""
