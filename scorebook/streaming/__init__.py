"""Structured Streaming forms of the load job and of the running scores."""
