"""Agent-security analytics as Spark DataFrame operators, in batch and in Structured Streaming."""
