"""Communication-log analytics on Spark."""
