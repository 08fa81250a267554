"""The same jobs under Structured Streaming."""
