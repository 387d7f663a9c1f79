"""Number-distribution analytics on Spark."""
