"""Named queries over the driver's tables, each with an equivalent statement for DuckDB."""
