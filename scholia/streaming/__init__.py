"""Structured Streaming over the job event feed."""
