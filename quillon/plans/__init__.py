"""Settings, and the registered queries with their DuckDB counterparts."""
