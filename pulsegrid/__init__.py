"""Event anomaly and incident analytics on Spark."""
