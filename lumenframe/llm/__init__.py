"""Operators for large-scale training-data pipelines.

Each module holds one operator with a general interface; ``queries`` holds the
thin registered queries and ``sql`` their DuckDB twins.
"""
