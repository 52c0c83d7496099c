"""Market time-series research jobs and training-data preparation on Spark."""
