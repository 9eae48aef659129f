"""Operators of a training-data pipeline, their queries and SQL.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its
queries only when it is there.
"""
