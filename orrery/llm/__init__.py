"""Training-data operators: deduplication, mixing, packing, search, quality and language models.

Nothing outside this subpackage imports it. Each operator module has a general function over DataFrames;
queries.py derives the registered opN_ results from them.
"""
