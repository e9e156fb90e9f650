"""Training-data operators: dedup, filtering, scoring, search and mixing over document tables.

Nothing outside this subpackage imports it.
"""
