"""Entity risk-signal analytics as Spark DataFrame, SQL and streaming transformations."""
