"""Training-data operators: tokenizing, privacy, deduplication, filtering, packing.

Nothing outside this subpackage imports it.  Every operator is a function from
DataFrames to a DataFrame; ``queries`` holds the thin ``opN_<name>`` queries.
"""
