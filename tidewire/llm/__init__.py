"""Training-data operators: deduplication, packing, mixing, filters, classifiers, search.

Nothing else in the library imports this subpackage.
"""
