"""The given tables read as journey inputs, the registered queries and their DuckDB equivalents."""
