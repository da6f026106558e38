"""Independent ANSI SQL for each registered query, for cross-checking in DuckDB."""
