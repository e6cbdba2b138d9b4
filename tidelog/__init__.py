"""Event-log analytics on Spark: logs as DataFrames, declarative operators, Catalyst underneath."""
