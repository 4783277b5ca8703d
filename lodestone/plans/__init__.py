"""Named queries over the test tables, each with its DuckDB equivalent where SQL has one."""
