"""Work queue and incremental parsing as Structured Streaming jobs."""
