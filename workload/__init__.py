"""The registered queries, the views they read, and their DuckDB counterparts."""
