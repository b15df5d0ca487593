"""DuckDB twins of the Spark queries, written independently of them."""
