"""Training-data operators: deduplication, packing, tokenised output, filtering and labelling.

Nothing outside this subpackage imports it.
"""
