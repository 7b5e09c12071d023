"""Training-data operators: deduplication, filtering, mixing and packing of
document corpora. Nothing else in the library imports this subpackage.

One module per operator; ``queries`` binds each to the driver's tables and
``sql`` holds the DuckDB statements of those that SQL can express.
"""
