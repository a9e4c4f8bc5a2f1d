"""Training-data operators: search, filters, classifiers, deduplication and mixing.

Nothing outside this subpackage imports it.  Each ``opN`` module holds one
operator with a general interface; ``queries`` holds the thin queries and SQL.
"""
