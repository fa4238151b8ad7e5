"""Table schemas, fixture tables, readers and writers."""
