"""Training-data operators: language, duplicates, filtering, packing and sharding of text tables.

Nothing else in the package imports this subpackage; it can be removed as a whole.
"""
