"""Registered queries: each module pairs a Spark query on the fixture tables with its DuckDB oracle."""
