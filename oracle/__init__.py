"""Reference SQL for the correctness check: one DuckDB query per registered query, over the driver's tables."""
