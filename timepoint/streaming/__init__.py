"""The same results incrementally, on Structured Streaming."""
