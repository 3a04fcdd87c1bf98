"""Column expressions: geometry, style and text rules, all native Spark SQL."""
