"""The statistics plans under Structured Streaming."""
