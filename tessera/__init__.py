"""Feature-coding analytics on Spark."""
