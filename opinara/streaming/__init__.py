"""The batch column functions on Structured Streaming frames."""
