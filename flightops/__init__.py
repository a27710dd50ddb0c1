"""Flight-operations analytics on Spark: ingestion, lifecycle, journeys, history, streams."""
