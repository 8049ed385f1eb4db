"""Training-data operators: tokenizing, sharding, quality, toxicity, duplicates and extraction.

Nothing else in the package imports this subpackage.
"""
