"""Column -> Column scalar functions (no Python UDFs)."""
