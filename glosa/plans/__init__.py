"""Named queries: each module pairs a Spark plan with the equivalent DuckDB statement."""
