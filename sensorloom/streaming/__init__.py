"""The batch operators driven by Structured Streaming."""
