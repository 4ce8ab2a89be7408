"""Operators for large text corpora: tokens, duplicates, quality, secrets.

Nothing outside this subpackage imports it. ``queries.QUERIES`` and
``queries.ORACLE_SQL`` are the registered entry points.
"""
