"""The fast clock as Structured Streaming jobs."""
