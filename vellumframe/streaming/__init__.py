"""Event streams: batch operators and Structured Streaming forms."""
