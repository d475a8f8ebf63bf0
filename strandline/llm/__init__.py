"""Training-data operators: classifiers, tokens, packing, deduplication, scans, fixity and search.

Nothing else in the library imports this subpackage.
"""
