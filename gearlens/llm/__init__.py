"""Operators of a training-data pipeline over document, page and conversation tables.

Every module holds one operator with its registered query (``QUERIES``) and,
where SQL can express it, the DuckDB statement for the same rows (``ORACLE``).
"""
