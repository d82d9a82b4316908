"""Column-level rules, all built from native Spark expressions."""
