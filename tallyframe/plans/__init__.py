"""Named queries over the fixture tables and their DuckDB oracle SQL."""
