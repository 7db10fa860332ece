"""Operators of a large-scale training-data pipeline over documents and pages.

Nothing else in the library imports this subpackage; its queries and SQL are
in :mod:`recentlake.llm.queries`.
"""
