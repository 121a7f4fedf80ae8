"""Training-data operators: each module is one operator over Spark DataFrames.

Nothing outside this subpackage imports it.  Shared plumbing is in ``common``.
"""
